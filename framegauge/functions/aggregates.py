"""The seven aggregations as column expressions.

Rules kept: nulls are skipped, the sum of nothing is 0, ``min``/``max`` ignore
NaN unless there is nothing else, ``std`` divides by n - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.schema import NUMERIC, col, data_type, is_floating, type_class

AGGREGATIONS = ("count", "max", "mean", "median", "min", "std", "sum")
_NUMERIC_ONLY = ("mean", "median", "std", "sum")


def require_aggregation(agg: str, metric: str | None) -> None:
    if agg not in AGGREGATIONS:
        raise ValueError(f"Unsupported aggregation '{agg}'. Choose from: {', '.join(AGGREGATIONS)}")
    if metric is None and agg != "count":
        raise ValueError("A metric is required for aggregations other than count.")


def require_metric_type(df: DataFrame, metric: str | None, agg: str) -> None:
    if metric is not None and agg in _NUMERIC_ONLY:
        if type_class(data_type(df, metric)) != NUMERIC:
            raise ValueError(f"Aggregation '{agg}' requires a numeric metric: '{metric}'")


def largest(column: Column, dtype: T.DataType) -> Column:
    """``max`` that returns NaN only where every value is NaN."""
    if not is_floating(dtype):
        return F.max(column)
    return F.coalesce(F.max(F.when(~F.isnan(column), column)), F.max(column))


def smallest(column: Column) -> Column:
    """``min``; NaN sorts last in Spark, so it needs no special case."""
    return F.min(column)


def total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def aggregate_column(df: DataFrame, metric: str | None, agg: str) -> Column:
    """The expression for one aggregation, named after the metric."""
    if metric is None:
        return F.count(F.lit(1)).alias("row_count")
    value, dtype = col(metric), data_type(df, metric)
    expressions = {
        "count": lambda: F.count(value),
        "sum": lambda: total(value),
        "mean": lambda: F.avg(value),
        "median": lambda: F.median(value),
        "min": lambda: smallest(value),
        "max": lambda: largest(value, dtype),
        "std": lambda: F.stddev_samp(value),
    }
    return expressions[agg]().alias(metric)
