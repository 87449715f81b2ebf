"""Exact distinct counts and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.names import exact_names
from framegauge.schema import col, order_key
from framegauge.storage import pinned

# Up to this many rows one shuffle of whole values is cheaper than two passes.
DIRECT_ROWS = 5_000_000
# Repeated hashes, of 8 bytes each, that may be sent to every executor.
BROADCAST_HASHES = 2_000_000
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_NARROW_COLUMNS = 3


class ColumnValues:
    """The value histogram of one column: distinct values and most frequent ones.

    Long values of large datasets are counted by hash first: a hash seen once is
    one distinct value, and only the values behind repeated hashes are compared
    and shuffled in full.  Both answers stay exact.
    """

    def __init__(self, df: DataFrame, column: str, direct_rows: int = DIRECT_ROWS):
        self._dtype = df.schema[column].dataType
        self._values = df.select(col(column).alias("v"))
        self._repeated: DataFrame | None = None
        if not isinstance(self._dtype, _FIXED_WIDTH) and column in _hash_columns(df):
            rows = df.count()
            if rows > direct_rows:
                self._count_hashes(rows)
        # Both answers read this one histogram, so its shuffle is planned once.
        counted = self._values if self._repeated is None else self._with_hash("left_semi")
        self._histogram = counted.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))

    def _with_hash(self, how: str) -> DataFrame:
        hashed = self._values.withColumn("h", F.xxhash64("v"))
        return hashed.join(F.broadcast(self._repeated), "h", how).select("v")

    def _count_hashes(self, rows: int) -> None:
        by_hash = self._values.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n"))
        repeated = pinned(by_hash.where(F.col("n") > 1))
        hashes, covered = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if hashes <= BROADCAST_HASHES:
            self._repeated = repeated.select("h")
            self._single_values = rows - covered

    def unique(self, count_null: bool = True) -> DataFrame:
        """One row ``unique_count``."""
        # Counting by "copies" keeps the histogram the same as in ``top``.
        counted = F.col("copies") > 0
        if not count_null:
            counted = counted & F.col("v").isNotNull()
        unique = self._histogram.agg(F.count_if(counted).alias("unique_count"))
        if self._repeated is None:
            return unique
        singles = self._single_values
        if not count_null:
            single_null = self._with_hash("left_anti").where("v is null").limit(1).count()
            singles -= single_null
        return unique.select((F.col("unique_count") + singles).alias("unique_count"))

    def top(self, limit: int) -> DataFrame:
        """At most ``limit`` rows ``v, copies``; ties go by value, nulls first."""
        value = order_key(F.col("v"), self._dtype).asc_nulls_first()
        order = [F.col("copies").desc(), value]
        top = self._histogram.orderBy(*order).limit(limit)
        if self._repeated is None:
            return top
        singles = self._with_hash("left_anti").orderBy(value).limit(limit)
        singles = singles.withColumn("copies", F.lit(1).cast("bigint"))
        return top.unionByName(singles).orderBy(*order).limit(limit)


@exact_names("columns", texts=["column"])
def distinct_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    count_null: bool = True,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``column, unique_count`` for each column; null is a value if ``count_null``.

    Each column is one branch that reads and shuffles that column alone, which
    avoids the row expansion Spark uses for several distinct counts at once.
    """
    chosen = df.columns if columns is None else list(columns)
    branches = [
        ColumnValues(df, c, direct_rows)
        .unique(count_null)
        .select(F.lit(c).alias("column"), "unique_count")
        for c in chosen
    ]
    return reduce(DataFrame.unionAll, branches)


@exact_names()
def duplicate_row_count(
    df: DataFrame, *, direct_rows: int = DIRECT_ROWS, rows: int | None = None
) -> DataFrame:
    """``row_count, duplicate_row_count``; extra copies count, nulls are equal.

    Large inputs with wide rows shuffle a row hash first.  Only rows whose hash
    occurs more than once can be copies, and those are compared in full.  ``rows``
    is the number of rows where the caller has counted them.
    """
    if _narrow(df) or (df.count() if rows is None else rows) <= direct_rows:
        return _count_copies(df)
    return _count_copies_by_hash(df)


def _narrow(df: DataFrame) -> bool:
    fields = df.schema.fields
    return len(fields) <= _NARROW_COLUMNS and all(
        isinstance(f.dataType, _FIXED_WIDTH) for f in fields
    )


def _count_copies(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    rows = F.coalesce(F.sum("__copies"), F.lit(0))
    return copies.agg(
        rows.alias("row_count"), (rows - F.count(F.lit(1))).alias("duplicate_row_count")
    )


def _hash_columns(df: DataFrame) -> list[str]:
    """Columns a hash can be taken of; leaving one out only adds suspects."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def _count_copies_by_hash(df: DataFrame) -> DataFrame:
    hashed = df.select("*", F.xxhash64(*[col(c) for c in _hash_columns(df)]).alias("__hash"))
    by_hash = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__rows"))
    suspects = pinned(by_hash.where(F.col("__rows") > 1).select("__hash"))
    if suspects.count() > BROADCAST_HASHES:
        # Too many repeated rows to send around; equal rows still combine
        # before the shuffle, so a hot row costs one record per task.
        return _count_copies(df)
    suspected = hashed.join(F.broadcast(suspects), "__hash", "left_semi").drop("__hash")
    return _count_copies(suspected).select(
        F.lit(df.count()).cast("bigint").alias("row_count"), "duplicate_row_count"
    )
