"""Aggregation over tumbling time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framegauge.functions.aggregates import (
    aggregate_column,
    require_aggregation,
    require_metric_type,
)
from framegauge.functions.buckets import bucket_start, parse_frequency, required
from framegauge.functions.quantiles import grouped_median
from framegauge.names import exact_names
from framegauge.schema import TEMPORAL, col, data_type, require, type_class


@exact_names("datetime_column", "metric")
def time_series(
    df: DataFrame,
    *,
    datetime_column: str,
    frequency: str = "1d",
    metric: str | None = None,
    agg: str = "count",
    on_null: str = "error",
) -> DataFrame:
    """One row per non-empty bucket, sorted by bucket start.

    The bucket start keeps the name and type of the datetime column.  Null
    datetimes fail the job; ``on_null="drop"`` leaves them out.
    """
    bucketed = bucketed_rows(
        df,
        datetime_column=datetime_column,
        frequency=frequency,
        metric=metric,
        agg=agg,
        on_null=on_null,
    )
    if agg == "median":
        series = grouped_median(bucketed, [datetime_column], metric)
    else:
        series = bucketed.groupBy(col(datetime_column)).agg(aggregate_column(bucketed, metric, agg))
    return series.orderBy(col(datetime_column))


def bucketed_rows(
    df: DataFrame,
    *,
    datetime_column: str,
    frequency: str,
    metric: str | None,
    agg: str,
    on_null: str = "error",
) -> DataFrame:
    """The rows a time series needs, with the datetime replaced by its bucket."""
    require(df, [datetime_column, *([metric] if metric is not None else [])])
    dtype = data_type(df, datetime_column)
    if type_class(dtype) != TEMPORAL:
        raise ValueError(f"Time analysis requires a Date or Datetime column: '{datetime_column}'")
    require_aggregation(agg, metric)
    require_metric_type(df, metric, agg)
    if metric == datetime_column:
        raise ValueError(f"Output column '{metric}' is also the datetime column.")
    if on_null not in ("error", "drop"):
        raise ValueError(f"Unsupported on_null '{on_null}'. Choose from: drop, error")
    every = parse_frequency(frequency)
    moment = col(datetime_column)
    if on_null == "drop":
        df = df.where(moment.isNotNull())
    else:
        moment = required(moment, datetime_column)
    return df.select(
        bucket_start(moment, dtype, every).alias(datetime_column),
        *([col(metric)] if metric is not None else []),
    )
