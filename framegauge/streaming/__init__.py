from framegauge.streaming.timeseries import streaming_time_series

__all__ = ["streaming_time_series"]
