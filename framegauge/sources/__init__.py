from framegauge.sources.files import SUPPORTED_FORMATS, dataset_schema, load_dataset

__all__ = ["SUPPORTED_FORMATS", "dataset_schema", "load_dataset"]
