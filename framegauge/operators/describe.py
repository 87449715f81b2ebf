"""Descriptive statistics of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.aggregates import largest, smallest
from framegauge.functions.histogram import RankedHistogram
from framegauge.functions.quantiles import (
    HELD_VALUES,
    fits_in_one_task,
    nan_count,
    one_row_per_column,
    valid_value,
)
from framegauge.names import exact_names
from framegauge.operators.distinct import distinct_counts
from framegauge.schema import (
    MISSING_COLUMN,
    NUMERIC,
    col,
    data_type,
    require,
    select_numeric,
    type_class,
)

_PROBABILITIES = [0.25, 0.5, 0.75, 0.95]
_SCHEMA = (
    "column string, count bigint, missing bigint, mean double, median double, std double, "
    "min double, p25 double, p50 double, p75 double, p95 double, max double, unique bigint"
)


@exact_names("columns", texts=["column"])
def describe(
    df: DataFrame, columns: Sequence[str] | None = None, *, held_values: int = HELD_VALUES
) -> DataFrame:
    """One row of statistics per numeric column.

    A column without values keeps only ``count`` and ``missing``.
    """
    chosen = select_numeric(df, columns, "Descriptive statistics require")
    if not chosen:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    if len(set(chosen)) < len(chosen):  # a repeated column has a row for each time
        once = describe(df, list(dict.fromkeys(chosen)), held_values=held_values)
        asked = df.sparkSession.createDataFrame([(c,) for c in chosen], "column string")
        return F.broadcast(asked).join(once, "column").select(*once.columns)
    statistics = _statistics(df, chosen, held_values)
    if fits_in_one_task(df.count(), len(chosen), held_values):
        unique = distinct_counts(df, chosen, count_null=False)
        # One row per column on either side, so the table sent around is the schema.
        statistics = statistics.drop("unique_count").join(F.broadcast(unique), "column", "left")
    return statistics.select(
        "column", "count", "missing", "mean", "median", "std", "min",
        "p25", "p50", "p75", "p95", "max",
        F.when(F.col("count") > 0, F.col("unique_count")).alias("unique"),
    )


@exact_names("column", texts=["column"])
def describe_numeric(df: DataFrame, column: str, *, held_values: int = HELD_VALUES) -> DataFrame:
    """The short form for one column; an empty column keeps only ``count``."""
    require(df, [column], MISSING_COLUMN, KeyError)
    if type_class(data_type(df, column)) != NUMERIC:
        raise TypeError(f"Column '{column}' is not numeric.")
    return _statistics(df, [column], held_values).select(
        "column",
        "count",
        F.when(F.col("count") > 0, F.col("missing")).alias("missing"),
        "mean",
        "median",
        "std",
        "min",
        F.col("p25").alias("q25"),
        F.col("p75").alias("q75"),
        "max",
    )


def _statistics(df: DataFrame, columns: Sequence[str], held_values: int) -> DataFrame:
    measured = quantile_rows(
        df, columns, lambda c: _column_row(df, c), _PROBABILITIES, held_values
    )

    def percentile(i: int) -> Column:
        return F.when(F.col("nans") > 0, F.lit(math.nan)).otherwise(F.get("quantiles", F.lit(i)))

    return measured.select(
        F.col("name").alias("column"),
        "count",
        "missing",
        "mean",
        F.get("quantiles", F.lit(1)).alias("median"),
        "std",
        "min",
        percentile(0).alias("p25"),
        percentile(1).alias("p50"),
        percentile(2).alias("p75"),
        percentile(3).alias("p95"),
        "max",
        F.col("distinct").alias("unique_count"),
    )


def _column_row(df: DataFrame, name: str) -> list[Column]:
    value, dtype = col(name), data_type(df, name)
    return [
        F.count(value).alias("count"),
        F.count_if(value.isNull()).alias("missing"),
        F.avg(value).cast("double").alias("mean"),
        F.stddev_samp(value).alias("std"),
        smallest(value).cast("double").alias("min"),
        largest(value, dtype).cast("double").alias("max"),
    ]


def quantile_rows(
    df: DataFrame,
    columns: Sequence[str],
    measures: Callable[[str], list[Column]],
    probabilities: Sequence[float],
    held_values: int,
) -> DataFrame:
    """One row per column: ``name``, its measures, ``nans``, exact ``quantiles`` and ``distinct``.

    While all values fit in one task the quantiles are aggregates of the same
    pass and ``distinct`` is null.  Otherwise both come from one ranked histogram, and
    the rows, one per column, are completed on the driver.
    """
    numeric = [c for c in columns if type_class(data_type(df, c)) == NUMERIC]
    direct = fits_in_one_task(df.count(), len(numeric), held_values)
    unknown = F.lit(None).cast("bigint").alias("distinct")

    def row(name: str) -> Column:
        value, dtype = col(name), data_type(df, name)
        fields = [F.lit(name).alias("name"), *measures(name)]
        if name not in numeric:
            nothing = F.lit(None).cast("array<double>")
            return F.struct(*fields, _zero("valid"), _zero("nans"), nothing.alias("quantiles"), unknown)
        if direct:
            valid, quantiles = _zero("valid"), F.percentile(value, list(probabilities))
        else:
            valid = F.count_if(valid_value(value, dtype)).alias("valid")
            quantiles = F.lit(None).cast("array<double>")
        nans = nan_count(value, dtype).alias("nans")
        return F.struct(*fields, valid, nans, quantiles.alias("quantiles"), unknown)

    measured = one_row_per_column(df, columns, row)
    if direct:
        return measured
    ranked = RankedHistogram(df, numeric)
    found = ranked.linear_quantiles(probabilities)
    completed = [
        (*r[:-2], found.get(r["name"]), ranked.distinct.get(r["name"])) for r in measured.collect()
    ]
    return df.sparkSession.createDataFrame(completed, measured.schema)


def _zero(name: str) -> Column:
    return F.lit(0).cast("bigint").alias(name)
