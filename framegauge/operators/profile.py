"""Column profiles of any dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.aggregates import largest, smallest
from framegauge.functions.quantiles import HELD_VALUES
from framegauge.names import exact_names
from framegauge.operators.describe import quantile_rows
from framegauge.operators.distinct import DIRECT_ROWS, ColumnValues, duplicate_row_count
from framegauge.schema import NUMERIC, OTHER, TEMPORAL, col, columns_of, data_type, type_class

TOP_VALUES = 5


@exact_names(texts=["name"])
def profile_columns(
    df: DataFrame, *, held_values: int = HELD_VALUES, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """One row per column.

    ``min`` and ``max`` are text (ISO-8601 for date-times) so that columns of
    all types share a schema; ``mean`` and ``median`` are set for numeric
    columns and ``top_values`` for columns that are neither numeric nor dates.
    """
    values = {c: ColumnValues(df, c, direct_rows) for c in df.columns}
    unique = reduce(
        DataFrame.unionAll,
        [v.unique().select(F.lit(c).alias("name"), "unique_count") for c, v in values.items()],
    )
    # The joined tables have one row per column of the schema.
    profile = _statistics(df, held_values).join(F.broadcast(unique), "name")
    top = [_top_values(df, c, values[c]) for c in columns_of(df, OTHER)]
    if top:
        profile = profile.join(F.broadcast(reduce(DataFrame.unionAll, top)), "name", "left")
    else:
        profile = profile.withColumn("top_values", F.lit(None).cast(_TOP_TYPE))
    return profile.select(
        "name", "dtype", "null_count", "null_pct", "unique_count",
        "min", "max", "mean", "median", "top_values",
    )


_TOP_TYPE = "array<struct<value:string,count:bigint>>"


def _top_values(df: DataFrame, column: str, values: ColumnValues) -> DataFrame:
    # At most TOP_VALUES entries are listed here.
    entry = F.struct(
        (-F.col("copies")).alias("order"),
        value_text(F.col("v"), df, column).alias("value"),
        F.col("copies").alias("count"),
    )
    listed = values.top(TOP_VALUES).agg(F.sort_array(F.collect_list(entry)).alias("top"))
    return listed.select(
        F.lit(column).alias("name"),
        F.transform("top", lambda t: t.dropFields("order")).alias("top_values"),
    )


def value_text(value: Column, df: DataFrame, column: str) -> Column:
    """Text form of a value: ``None`` for null, ``True``/``False`` for booleans."""
    if isinstance(data_type(df, column), T.BooleanType):
        text = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def iso_text(value: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text with six fraction digits only where they are not zero."""
    if isinstance(dtype, T.DateType):
        return value.cast("string")
    zone = "xxx" if isinstance(dtype, T.TimestampType) else ""
    whole = F.date_format(value, f"yyyy-MM-dd'T'HH:mm:ss{zone}")
    exact = F.date_format(value, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
    return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(exact)


def _statistics(df: DataFrame, held_values: int) -> DataFrame:
    measured = quantile_rows(df, df.columns, lambda c: _column_row(df, c), [0.5], held_values)
    return measured.withColumn("median", F.get("quantiles", F.lit(0)))


def _column_row(df: DataFrame, name: str) -> list[Column]:
    value, dtype = col(name), data_type(df, name)
    kind = type_class(dtype)
    nulls, rows = F.count_if(value.isNull()), F.count(F.lit(1))
    low = high = F.lit(None).cast("string")
    mean = F.lit(None).cast("double")
    if kind == NUMERIC:
        low, high = smallest(value).cast("string"), largest(value, dtype).cast("string")
        mean = F.avg(value).cast("double")
    elif kind == TEMPORAL:
        low, high = iso_text(F.min(value), dtype), iso_text(F.max(value), dtype)
    percent = F.round(F.coalesce(F.try_divide(nulls * 100.0, rows), F.lit(0.0)), 4)
    return [
        F.lit(dtype.simpleString()).alias("dtype"),
        nulls.alias("null_count"),
        percent.alias("null_pct"),
        low.alias("min"),
        high.alias("max"),
        mean.alias("mean"),
    ]


@exact_names(texts=["name"])
def profile_table(df: DataFrame) -> DataFrame:
    """:func:`profile_columns` with the totals of :func:`profile_summary` on every row."""
    totals = profile_summary(df).first()
    kinds = {f.name: f.dataType for f in profile_summary(df).schema}
    return profile_columns(df).select(
        "*", *[F.lit(value).cast(kinds[name]).alias(name) for name, value in totals.asDict().items()]
    )


def profile_summary(df: DataFrame) -> DataFrame:
    """``row_count, column_count, duplicate_row_count`` in one row."""
    return duplicate_row_count(df).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), "duplicate_row_count"
    )
