"""The fixed-unit time series on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.aggregates import (
    aggregate_column,
    require_aggregation,
    require_metric_type,
)
from framegauge.functions.buckets import parse_frequency
from framegauge.schema import TEMPORAL, col, data_type, require, type_class


def streaming_time_series(
    stream: DataFrame,
    *,
    datetime_column: str,
    frequency: str = "1d",
    metric: str | None = None,
    agg: str = "count",
    watermark: str = "1 hour",
) -> DataFrame:
    """Tumbling buckets in append mode; a bucket is final once the watermark passes it.

    The bucket start is a TIMESTAMP because watermarks need one.  Calendar units
    have no fixed length to wait for, and a median would keep every value of a
    bucket as state, so both are refused.
    """
    require(stream, [datetime_column, *([metric] if metric is not None else [])])
    if type_class(data_type(stream, datetime_column)) != TEMPORAL:
        raise ValueError(f"Time analysis requires a Date or Datetime column: '{datetime_column}'")
    require_aggregation(agg, metric)
    require_metric_type(stream, metric, agg)
    every = parse_frequency(frequency)
    if every.months is not None:
        raise ValueError(f"A stream needs a fixed-length frequency, not '{frequency}'.")
    if agg == "median":
        raise ValueError("The median of a bucket is not available on a stream.")
    offset = "4 days" if every.unit == "w" else None
    timed = stream.withColumn(datetime_column, col(datetime_column).cast(T.TimestampType()))
    window = F.window(col(datetime_column), every.interval, startTime=offset)
    counted = (
        timed.withWatermark(datetime_column, watermark)
        .groupBy(window.alias("bucket"))
        .agg(aggregate_column(timed, metric, agg))
    )
    return counted.select(
        F.col("bucket.start").alias(datetime_column),
        *[col(c) for c in counted.columns if c != "bucket"],
    )
