"""Grouped and global aggregation, value counts and top groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegauge.functions.aggregates import (
    AGGREGATIONS,
    aggregate_column,
    require_aggregation,
    require_metric_type,
)
from framegauge.functions.quantiles import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    grouped_median,
    linear_quantiles,
    rankable_counts,
)
from framegauge.names import exact_names
from framegauge.operators.distinct import ColumnValues
from framegauge.schema import (
    MISSING_COLUMN,
    NUMERIC,
    col,
    data_type,
    free_names,
    require,
    type_class,
)
from framegauge.sources.positions import first_rows, has_row_index
from framegauge.storage import pinned

_SUMMARY_OPERATIONS = [agg for agg in AGGREGATIONS if agg != "std"]
# Bits of a position that number the row in its file; the rest number the file.
_ROW_BITS = 40


@exact_names("group_by", "metric")
def aggregate(
    df: DataFrame,
    *,
    group_by: Sequence[str] | None,
    metric: str | None,
    agg: str,
    preserve_order: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Aggregate ``metric`` per group, or over the whole dataset.

    The result has the key columns and one column named after the metric
    (``row_count`` without a metric).  ``preserve_order`` sorts the groups by
    first appearance in the source files; it needs a direct read of Parquet or CSV.
    ``position`` also names a column with the place of the first row: files are
    numbered by path, rows within a file from 0, and a file's rows begin at 2^40
    times its number.
    """
    keys = list(group_by or [])
    require(df, [*([metric] if metric is not None else []), *keys])
    require_aggregation(agg, metric)
    require_metric_type(df, metric, agg)
    output = metric if metric is not None else "row_count"
    if output in keys:
        raise ValueError(f"Output column '{output}' is also a grouping column.")
    if not keys:
        return _global(df, metric, agg)
    if position is not None and position in [*keys, output]:
        raise ValueError(f"Pass another position; '{position}' is a column of the result.")
    if agg == "median":
        result = grouped_median(df, keys, metric)
    else:
        result = df.groupBy(*[col(k) for k in keys]).agg(aggregate_column(df, metric, agg))
    if not preserve_order and position is None:
        return result
    return _by_first_appearance(df, result, keys, position)


def _global(df: DataFrame, metric: str | None, agg: str) -> DataFrame:
    if agg != "median":
        return df.agg(aggregate_column(df, metric, agg))
    valid, nans = rankable_counts(df, [metric])
    median = linear_quantiles(df, [0.5], valid, nans)[metric][0]
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias(metric))


def _by_first_appearance(
    df: DataFrame, result: DataFrame, keys: Sequence[str], position: str | None
) -> DataFrame:
    """``result`` sorted by the first row of each group, all of it by hash aggregation.

    The least row number of a group in each file is one bigint.  Only these few rows
    meet the table of files.
    """
    *names, first_row = free_names(df, *[f"k{i}" for i in range(len(keys))], "first")
    in_files = first_rows(df, [col(k) for k in keys], names)
    paths = df.select(F.col("_metadata.file_path").alias("path")) if has_row_index(df) else in_files.select("path")
    first = (
        in_files.join(_numbered_files(paths), "path")
        .groupBy(*names)
        .agg(F.min(F.shiftleft("file", _ROW_BITS) + F.col("row")).alias(first_row))
    )
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    kept = [col(c) for c in result.columns]
    place = [] if position is None else [F.col(first_row).alias(position)]
    return result.join(first, same).orderBy(first_row).select(*kept, *place)


def _numbered_files(paths: DataFrame) -> DataFrame:
    """``path, file``: one row for each file, numbered by path; sent around if it is small."""
    number = F.row_number().over(Window.orderBy("path")) - 1
    # A row a file: what the driver that lists the files holds anyway.
    files = pinned(paths.distinct().select("path", number.cast("bigint").alias("file")))
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path") + 16), F.lit(0))).first()
    small = count <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return F.broadcast(files) if small else files


@exact_names("group_by", "metric")
def top_groups(
    df: DataFrame,
    *,
    group_by: Sequence[str],
    metric: str | None,
    agg: str,
    direction: str = "desc",
    limit: int | None = None,
) -> DataFrame:
    """Aggregate, then rank the groups by the aggregate; ties go by key."""
    return ranked(aggregate(df, group_by=group_by, metric=metric, agg=agg), group_by, direction, limit)


def ranked(
    result: DataFrame, keys: Sequence[str], direction: str | None, limit: int | None
) -> DataFrame:
    """Sort an aggregate by its last column and keep the first ``limit`` groups."""
    if direction not in (None, "asc", "desc"):
        raise ValueError(f"Unsupported sort direction '{direction}'. Choose from: asc, desc")
    if direction is not None:
        measure = col(result.columns[-1])
        by_measure = measure.desc_nulls_last() if direction == "desc" else measure.asc_nulls_last()
        result = result.orderBy(by_measure, *[col(k).asc_nulls_first() for k in keys])
    return result if limit is None else result.limit(limit)


@exact_names("group_by", "metric")
def grouped_summary(
    df: DataFrame, group_by: str, metric: str, operation: str = "mean"
) -> DataFrame:
    """One key, one numeric metric, sorted by key with the null key first.

    Unlike :func:`aggregate`, ``count`` counts rows whose metric is null too.
    """
    require(df, [group_by], MISSING_COLUMN, KeyError)
    require(df, [metric], MISSING_COLUMN, KeyError)
    if type_class(data_type(df, metric)) != NUMERIC:
        raise TypeError(f"Metric '{metric}' is not numeric.")
    if operation not in _SUMMARY_OPERATIONS:
        raise ValueError(
            f"Unsupported operation '{operation}'. Choose from {_SUMMARY_OPERATIONS}."
        )
    output = f"{metric}_{operation}"
    if operation == "median":
        values = df.select(col(group_by), col(metric).alias(output))
        summary = grouped_median(values, [group_by], output)
    else:
        counted = None if operation == "count" else metric
        summary = df.groupBy(col(group_by)).agg(aggregate_column(df, counted, operation).alias(output))
    return summary.orderBy(col(group_by).asc_nulls_first())


@exact_names("column")
def value_counts(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most frequent values, null included; ties go by value, nulls first."""
    require(df, [column], MISSING_COLUMN, KeyError)
    if column == "count":
        raise ValueError("Rename the column 'count' first; the result uses that name.")
    top = ColumnValues(df, column).top(limit)
    return top.select(F.col("v").alias(column), F.col("copies").alias("count"))
