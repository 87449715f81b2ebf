"""The ranked histogram of numeric columns: one count of values, every rank and distinct count.

The values of all columns are counted in one shuffle, equal ones before it.  The counts
are dealt out by ranges of (column, value) and written, so a hot value is one row and no
partition is large.  Totals of the partitions, some numbers each, then tell which partition
holds a rank; running counts are taken in those partitions alone.  The data are read once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.schema import col, data_type, is_floating
from framegauge.storage import pinned


PARTS = 8  # ranges for each column, at least


def _ranked_type(dtype: T.DataType) -> str:
    """A type that orders values as their own does; columns of one such type share a table."""
    if is_floating(dtype):
        return "double"
    return dtype.simpleString() if isinstance(dtype, T.DecimalType) else "bigint"


class RankedHistogram:
    """``distinct``, ``valid`` and ``nans`` by column, and any rank; nulls take no part.

    NaN is one distinct value and has no rank.  A column without values has zeros.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        self.distinct = dict.fromkeys(columns, 0)
        self.valid = dict.fromkeys(columns, 0)
        self.nans = dict.fromkeys(columns, 0)
        self._slices: dict[str, list[tuple[int, int]]] = {name: [] for name in columns}
        if not self.columns:
            return
        kinds = list(dict.fromkeys(_ranked_type(data_type(df, name)) for name in columns))
        self._values = [f"v{k}" for k in range(len(kinds))]  # one of them is not null
        self._table = self._counted(df, kinds)
        is_nan = F.isnan(self._value())
        totals = self._table.groupBy("c", "part").agg(
            F.count(F.lit(1)).alias("values"),
            F.sum("n").alias("rows"),
            F.sum(F.when(is_nan, F.col("n")).otherwise(0)).alias("nans"),
        )
        # One row for each partition and column in it.
        for row in sorted(totals.collect(), key=lambda r: r.part):
            name = self.columns[row.c]
            self.distinct[name] += row["values"]
            self.valid[name] += row.rows - row.nans
            self.nans[name] += row.nans
            self._slices[name].append((row.part, row.rows))

    def _value(self) -> Column:
        return F.coalesce(*[F.col(v).cast("double") for v in self._values])

    def _counted(self, df: DataFrame, kinds: Sequence[str]) -> DataFrame:
        """``c``, a value, its count ``n`` and ``part``, whose order is that of (c, value)."""
        branches = []
        for number, name in enumerate(self.columns):
            own = _ranked_type(data_type(df, name))
            values = [
                (col(name) if kind == own else F.lit(None)).cast(kind).alias(v)
                for kind, v in zip(kinds, self._values)
            ]
            branches.append(df.where(col(name).isNotNull()).select(F.lit(number).alias("c"), *values))
        counted = reduce(DataFrame.unionAll, branches).groupBy("c", *self._values).agg(F.count(F.lit(1)).alias("n"))
        # So many parts that each is a small share of its column.
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS * len(self.columns))
        ranged = counted.repartitionByRange(parts, "c", *self._values)
        return pinned(ranged.withColumn("part", F.spark_partition_id()))

    def at_ranks(self, wanted: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
        """The values at ranks (from 0) below ``valid``, as doubles, by (column, rank)."""
        places = set()
        for name, ranks in wanted.items():
            for rank in ranks:
                before = 0
                for part, rows in self._slices[name]:
                    if rank < before + rows:
                        places.add((self.columns.index(name), part, rank - before, rank))
                        break
                    before += rows
        if not places:
            return {}
        schema = "c int, part int, place bigint, rank bigint"
        asked = F.broadcast(self._table.sparkSession.createDataFrame(sorted(places), schema))  # a few a column
        slices = self._table.join(asked.select("c", "part").distinct(), ["c", "part"], "left_semi")
        running = Window.partitionBy("c", "part").orderBy(*self._values)
        through = slices.withColumn("through", F.sum("n").over(running))
        hit = (F.col("place") < F.col("through")) & (F.col("place") >= F.col("through") - F.col("n"))
        rows = through.join(asked, ["c", "part"]).where(hit).select("c", "rank", self._value())
        return {(self.columns[c], rank): value for c, rank, value in rows.collect()}

    def linear_quantiles(self, probabilities: Sequence[float]) -> dict[str, list[float | None]]:
        """Quantiles with linear interpolation (R-7); a position among NaNs is NaN."""
        positions = {
            name: [(self.valid[name] + self.nans[name] - 1) * p for p in probabilities]
            for name in self.columns
            if self.valid[name] + self.nans[name]
        }
        found = self.at_ranks(
            {
                name: [r for h in own for r in (math.floor(h), math.ceil(h)) if r < self.valid[name]]
                for name, own in positions.items()
            }
        )

        def at(name: str, position: float) -> float:
            lower = found.get((name, math.floor(position)), math.nan)
            upper = found.get((name, math.ceil(position)), math.nan)
            share = position - math.floor(position)
            return lower if share == 0 or lower == upper else (1 - share) * lower + share * upper

        return {
            name: [at(name, h) for h in positions[name]] if name in positions else [None] * len(probabilities)
            for name in self.columns
        }
