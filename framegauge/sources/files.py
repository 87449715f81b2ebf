"""CSV and Parquet datasets as lazy DataFrames."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framegauge.schema import SchemaClasses, classify

SUPPORTED_FORMATS = [".csv", ".parquet"]


def load_dataset(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read a ``.csv`` or ``.parquet`` file, directory or glob.

    Without ``schema`` a CSV is read one extra time to infer its types; pass a
    schema for large inputs.  ``multi_line`` allows line breaks inside quoted
    fields but stops Spark from splitting a file, so it is off by default.
    """
    path = str(path)
    if not _exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUPPORTED_FORMATS:
        raise ValueError(
            f"Unsupported format '{suffix}'. Supported formats: {SUPPORTED_FORMATS}"
        )
    if suffix == ".parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if schema is None:
        schema = _infer_csv_schema(spark, path, multi_line)
    return _csv_reader(spark, multi_line).schema(schema).csv(path)


def dataset_schema(spark: SparkSession, path: str) -> SchemaClasses:
    """Column names by type class; for Parquet only footers are read."""
    return classify(load_dataset(spark, path))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop_path)
    return matches is not None and len(matches) > 0


def _csv_reader(spark: SparkSession, multi_line: bool):
    # Without column pruning a row with too many or too few fields is noticed
    # whichever columns a query reads.
    return spark.read.options(
        header=True,
        mode="FAILFAST",
        escape='"',
        multiLine=multi_line,
        columnPruning=False,
        enforceSchema=False,
    )


def _infer_csv_schema(spark: SparkSession, path: str, multi_line: bool) -> T.StructType:
    with _zoneless_timestamps(spark):
        inferred = _csv_reader(spark, multi_line).option("inferSchema", True).csv(path).schema
    return T.StructType(
        [
            T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType)
            for f in inferred.fields
        ]
    )


@contextmanager
def _zoneless_timestamps(spark: SparkSession) -> Iterator[None]:
    """Infer date-times without a zone as TIMESTAMP_NTZ, as Parquet gives them."""
    key = "spark.sql.timestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_NTZ")
    try:
        yield
    finally:
        spark.conf.set(key, before)
