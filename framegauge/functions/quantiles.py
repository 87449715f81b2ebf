"""Exact order statistics that stay bounded on any data size.

Spark's ``percentile`` and ``median`` keep every distinct value of a group in
one task.  That is the fastest plan while the group is small, so it is used
behind a count.  Larger inputs are narrowed first: an approximate sketch only
proposes split values, exact counts around the splits tell which open interval
holds the wanted rank, and the interval is narrowed again until few enough
values are left to select from exactly.  The sketch can be arbitrarily wrong
without harming the answer; it only decides how fast the interval shrinks.

Ranks are 0-based and count the values that are neither null nor NaN; NaN sorts
after every number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import localcontext
from functools import reduce
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.schema import col, data_type, is_floating
from framegauge.storage import pinned

# Values one aggregation row may hold in memory, over all of its quantiles.
HELD_VALUES = 500_000
# Rows of a dataset whose grouped medians need no look at the group sizes.
GROUPED_ROWS = 2_000_000
# Rows of one group whose median may be taken inside one task.
GROUP_VALUES = 100_000
# Largest helper table that is sent to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024

_SKETCH_ACCURACY = 10_000
_HALF_BAND = 2.0 / _SKETCH_ACCURACY
_GRID = 2_000
# Columns whose aggregates share one pass.  The passes of a job run side by
# side and read only their own columns, so the bytes read stay the same, while
# the generated code stays small enough for the JVM to compile well.
COLUMNS_PER_PASS = 4
_AGGREGATES_PER_JOB = 64


def valid_value(column: Column, dtype: T.DataType) -> Column:
    """True for values that take part in ranking."""
    present = column.isNotNull()
    return present & ~F.isnan(column) if is_floating(dtype) else present


def nan_count(column: Column, dtype: T.DataType) -> Column:
    if not is_floating(dtype):
        return F.lit(0).cast("long")
    return F.count(F.when(F.isnan(column), F.lit(1)))


def fits_in_one_task(rows: int, columns: int, held_values: int = HELD_VALUES) -> bool:
    return rows * max(columns, 1) <= held_values


# --- whole-dataset quantiles -------------------------------------------------


@dataclass
class _Slot:
    """One wanted rank and the open interval known to contain it."""

    column: str
    rank: int
    size: int
    below: int = 0
    low: Any = None
    high: Any = None
    answer: Any = None

    @property
    def local_rank(self) -> int:
        return self.rank - self.below

    @property
    def fraction(self) -> float:
        return (self.local_rank + 0.5) / self.size

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int],
    held_values: int = HELD_VALUES,
) -> dict[tuple[str, int], float]:
    """Exact values at the given ranks of each column.

    ``sizes`` gives the number of rankable values per column.  Every job is one
    aggregation over the needed columns whose result is a single row.
    """
    slots = [_Slot(c, r, sizes[c]) for c, wanted in ranks.items() for r in sorted(set(wanted))]
    if not slots:
        return {}
    per_slot = max(held_values // len(slots), 2)
    while True:
        wide = [s for s in slots if s.answer is None and s.size > per_slot]
        if not wide:
            break
        _narrow(df, wide)
    _select_exactly(df, [s for s in slots if s.answer is None])
    return {(s.column, s.rank): float(s.answer) for s in slots}


def _inside(df: DataFrame, column: str, low: Any, high: Any) -> Column:
    value, dtype = col(column), data_type(df, column)
    condition = valid_value(value, dtype)
    if low is not None:
        condition = condition & (value > F.lit(low).cast(dtype))
    if high is not None:
        condition = condition & (value < F.lit(high).cast(dtype))
    return condition


def _rows_inside(df: DataFrame, intervals: Sequence[tuple]) -> DataFrame:
    """Rows that lie in one of the intervals; the test reaches the file scan."""
    if any(low is None and high is None for _, low, high in intervals):
        return df
    return df.where(reduce(lambda a, b: a | b, [_inside(df, *i) for i in intervals]))


def passes(items: Sequence, size: int = COLUMNS_PER_PASS) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def one_row_per_column(
    df: DataFrame,
    columns: Sequence[str],
    row_of: Callable[[str], Column],
    size: int = COLUMNS_PER_PASS,
) -> DataFrame:
    """One row per column from structs of aggregates, ``size`` columns per pass."""
    frames = [
        df.agg(F.array(*[row_of(c) for c in chunk]).alias("rows")).select(F.inline("rows"))
        for chunk in passes(list(columns), size)
    ]
    return reduce(DataFrame.unionAll, frames)


def _collect_arrays(frames: Sequence[DataFrame]) -> list[Any]:
    """Run one-row frames with an array ``found`` as one job; join the arrays.

    Arrays of different types travel in columns of their own.
    """
    tagged = [
        f.select(F.lit(i).alias("part"), F.col("found").alias(f"found_{f.dtypes[0][1]}"))
        for i, f in enumerate(frames)
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    found: list[Any] = []
    for row in sorted(together.collect(), key=lambda r: r["part"]):
        found += next(v for v in row[1:] if v is not None)
    return found


def one_row(df: DataFrame, expressions: Sequence[Column]) -> list[Any]:
    """Evaluate global aggregates, a bounded number of them per job."""
    values: list[Any] = []
    for start in range(0, len(expressions), _AGGREGATES_PER_JOB):
        chunk = expressions[start : start + _AGGREGATES_PER_JOB]
        values.extend(df.agg(*[e.alias(f"a{i}") for i, e in enumerate(chunk)]).first())
    return values


def _bands(slots: Sequence[_Slot]) -> list[float]:
    """Sketch fractions on both sides of each slot, neighbours sharing a pair."""
    pairs: list[list[float]] = []
    for fraction in sorted(s.fraction for s in slots):
        low, high = max(fraction - _HALF_BAND, 0.0), min(fraction + _HALF_BAND, 1.0)
        if pairs and low <= pairs[-1][1]:
            pairs[-1][1] = high
        else:
            pairs.append([low, high])
    return [f for pair in pairs for f in pair]


def _narrow(df: DataFrame, slots: Sequence[_Slot]) -> None:
    by_interval: dict[tuple, list[_Slot]] = {}
    for slot in slots:
        by_interval.setdefault(slot.interval, []).append(slot)
    # Neighbours of one type can share the array that carries their sketches.
    intervals = sorted(by_interval, key=lambda i: _sketch_type(data_type(df, i[0])))
    splits = [
        [cut for cut in sorted(set(found)) if _strictly_inside(cut, interval)]
        for interval, found in zip(intervals, _sketch(df, by_interval, intervals))
    ]
    for i, interval in enumerate(intervals):
        if not splits[i]:
            splits[i] = _halves(df, interval)
    counts = _count_pieces(df, intervals, splits)
    for i, (interval, cuts) in enumerate(zip(intervals, splits)):
        pieces = [counts.get(_code(i, piece), 0) for piece in range(2 * len(cuts))]
        for slot in by_interval[interval]:
            _place(slot, cuts, pieces)


def _sketch(
    df: DataFrame, by_interval: Mapping[tuple, list[_Slot]], intervals: Sequence[tuple]
) -> list[list[Any]]:
    """Approximate values around the wanted ranks, in the type of each column."""

    def one_pass(chunk: Sequence[tuple]) -> DataFrame:
        kind = _sketch_type(data_type(df, chunk[0][0]))
        sketches = [
            F.percentile_approx(
                F.when(_inside(df, *i), col(i[0])), _bands(by_interval[i]), _SKETCH_ACCURACY
            ).cast(f"array<{kind}>")
            for i in chunk
        ]
        return _rows_inside(df, chunk).agg(F.array(*sketches).alias("found"))

    by_kind = groupby(intervals, key=lambda i: _sketch_type(data_type(df, i[0])))
    return _collect_arrays([one_pass(c) for _, same in by_kind for c in passes(list(same))])


def _sketch_type(dtype: T.DataType) -> str:
    """The widest type of its kind: values pass through it unchanged."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if is_floating(dtype) else dtype.simpleString()


def _strictly_inside(cut: Any, interval: tuple) -> bool:
    _, low, high = interval
    return (low is None or cut > low) and (high is None or cut < high)


def _halves(df: DataFrame, interval: tuple) -> list[Any]:
    """Splits for whole numbers and decimals that a sketch of doubles cannot tell apart."""
    inside = F.when(_inside(df, *interval), col(interval[0]))
    low, high = df.agg(F.min(inside), F.max(inside)).first()
    if isinstance(low, int):
        return sorted({low, (low + high) // 2, high})
    with localcontext(prec=60):
        return sorted({low, ((low + high) / 2).quantize(low), high})


# Pieces of an interval are numbered between, on, between, on, ... its splits.
_CODES_PER_INTERVAL = 100_000


def _code(interval: int, piece: int) -> int:
    return interval * _CODES_PER_INTERVAL + piece


def _count_pieces(
    df: DataFrame, intervals: Sequence[tuple], splits: Sequence[Sequence[Any]]
) -> dict[int, int]:
    """Exact row counts of every piece, as one small histogram."""

    def piece_of(i: int) -> Column:
        value, dtype = col(intervals[i][0]), data_type(df, intervals[i][0])
        code = F.when(~_inside(df, *intervals[i]), F.lit(None))
        for j, cut in enumerate(splits[i]):
            at = F.lit(cut).cast(dtype)
            code = code.when(value < at, _code(i, 2 * j)).when(value == at, _code(i, 2 * j + 1))
        return code.cast("long")

    def one_pass(chunk: Sequence[int]) -> DataFrame:
        rows = _rows_inside(df, [intervals[i] for i in chunk])
        codes = rows.select(F.explode(F.array(*[piece_of(i) for i in chunk])).alias("code"))
        return codes.where(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    counted = reduce(DataFrame.unionAll, [one_pass(c) for c in passes(range(len(intervals)))])
    return {row["code"]: row["n"] for row in counted.collect()}


def _place(slot: _Slot, cuts: Sequence[Any], pieces: Sequence[int]) -> None:
    """Move a slot into the piece between the splits that holds its rank."""
    low, passed = slot.low, 0
    for cut, between, on in zip(cuts, pieces[0::2], pieces[1::2]):
        if slot.rank - slot.below < passed + between:
            slot.low, slot.high = low, cut
            slot.below, slot.size = slot.below + passed, between
            return
        if slot.rank - slot.below < passed + between + on:
            slot.answer = cut
            return
        low, passed = cut, passed + between + on
    slot.low = low
    slot.below, slot.size = slot.below + passed, slot.size - passed


def _select_exactly(df: DataFrame, slots: Sequence[_Slot]) -> None:
    if not slots:
        return
    by_interval: dict[tuple, list[_Slot]] = {}
    for slot in slots:
        by_interval.setdefault(slot.interval, []).append(slot)

    def one_pass(chunk: Sequence[tuple]) -> DataFrame:
        values = _rows_inside(df, chunk).select(
            *[F.when(_inside(df, *i), col(i[0])).alias(f"v{n}") for n, i in enumerate(chunk)]
        )
        wanted = [
            F.expr(f"percentile_disc({s.fraction!r}D) WITHIN GROUP (ORDER BY v{n})").cast("double")
            for n, i in enumerate(chunk)
            for s in by_interval[i]
        ]
        return values.agg(F.array(*wanted).alias("found"))

    found = _collect_arrays([one_pass(chunk) for chunk in passes(list(by_interval))])
    for slot, answer in zip([s for same in by_interval.values() for s in same], found):
        slot.answer = answer


def linear_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    valid: Mapping[str, int],
    nans: Mapping[str, int],
    held_values: int = HELD_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation (R-7) of the columns in ``valid``."""
    positions = {
        c: [(valid[c] + nans[c] - 1) * p for p in probabilities]
        for c in valid
        if valid[c] + nans[c] > 0
    }
    wanted = {
        c: [r for h in hs for r in (math.floor(h), math.ceil(h)) if r < valid[c]]
        for c, hs in positions.items()
    }
    found = order_statistics(df, wanted, valid, held_values)

    def at(column: str, position: float) -> float:
        lower = found.get((column, math.floor(position)), math.nan)
        upper = found.get((column, math.ceil(position)), math.nan)
        share = position - math.floor(position)
        return lower if share == 0 or lower == upper else (1 - share) * lower + share * upper

    return {
        c: [at(c, h) for h in positions[c]] if c in positions else [None] * len(probabilities)
        for c in valid
    }


def nearest_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    valid: Mapping[str, int],
    nans: Mapping[str, int],
    held_values: int = HELD_VALUES,
) -> dict[str, list[float]]:
    """Quantiles at the nearest rank, halves rounded up, of non-empty columns."""
    wanted = {
        c: [math.floor((valid[c] + nans[c] - 1) * p + 0.5) for p in probabilities]
        for c in valid
        if valid[c] + nans[c] > 0
    }
    found = order_statistics(
        df, {c: [r for r in rs if r < valid[c]] for c, rs in wanted.items()}, valid, held_values
    )
    return {c: [found.get((c, r), math.nan) for r in rs] for c, rs in wanted.items()}


def rankable_counts(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Rankable values and NaNs per column, in one pass."""
    expressions = rankable_expressions(df, columns)
    found = one_row(df, expressions) if expressions else []
    return dict(zip(columns, found[0::2])), dict(zip(columns, found[1::2]))


def rankable_expressions(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """For each column the counts of its rankable values and of its NaNs."""
    expressions = []
    for c in columns:
        value, dtype = col(c), data_type(df, c)
        expressions += [F.count_if(valid_value(value, dtype)), nan_count(value, dtype)]
    return expressions


# --- medians per group -------------------------------------------------------


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    metric: str,
    *,
    held_values: int = GROUPED_ROWS,
    group_values: int = GROUP_VALUES,
) -> DataFrame:
    """Exact median of ``metric`` per group; result columns are keys and metric.

    Groups of more than ``group_values`` rows are narrowed as described above,
    so a key that holds a third of all rows never meets in one task.
    """
    rows = df.select(*[col(k) for k in keys], col(metric))
    if rows.count() <= held_values:
        return _direct_median(rows, keys, metric)

    value, dtype = col(metric), data_type(df, metric)
    names = [f"g{i}" for i in range(len(keys))]
    big = pinned(
        rows.groupBy(*[col(k).alias(n) for k, n in zip(keys, names)])
        .agg(
            F.count(value).alias("n"),
            F.count_if(valid_value(value, dtype)).alias("valid"),
        )
        .where(F.col("n") > group_values)
    )
    if big.isEmpty():
        return _direct_median(rows, keys, metric)
    small = _is_small(big, names)
    other_groups = rows.join(
        _sendable(big.select(*names), small), _same_group(keys, names), "left_anti"
    )
    return _direct_median(other_groups, keys, metric).unionByName(
        _narrowed_median(rows, keys, names, metric, big, small, group_values)
    )


def _direct_median(rows: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return rows.groupBy(*[col(k) for k in keys]).agg(F.median(col(metric)).alias(metric))


def _same_group(keys: Sequence[str], names: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    )


def _is_small(table: DataFrame, names: Sequence[str]) -> bool:
    """Measure whether a helper table may be sent to every executor."""
    rows, size = table.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct(*names)))), F.lit(0))
    ).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _sendable(table: DataFrame, small: bool) -> DataFrame:
    """Broadcast a table known to be small.

    Otherwise the join shuffles and adaptive execution splits the hot keys.
    """
    return F.broadcast(table) if small else table


def _narrowed_median(
    rows: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    metric: str,
    big: DataFrame,
    small: bool,
    group_values: int,
) -> DataFrame:
    """Medians of the groups in ``big``; ``small`` says that it may be broadcast.

    Every helper table made below has at most two rows per group of ``big``.
    """
    dtype = data_type(rows, metric)
    value = col(metric)
    slot = [*names, "rank"]
    n = F.col("n")
    middle = F.array_distinct(
        F.array(F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long"))
    )
    state = big.select(*names, F.col("valid").alias("size"), F.explode(middle).alias("rank")).select(
        *slot,
        "size",
        F.lit(0).cast("long").alias("below"),
        F.lit(None).cast(dtype).alias("low"),
        F.lit(None).cast(dtype).alias("high"),
        F.when(F.col("rank") >= F.col("size"), F.lit(math.nan)).cast("double").alias("answer"),
    )
    state = pinned(state)

    def members(intervals: DataFrame) -> DataFrame:
        """Rows of ``rows`` that lie inside the interval of their group."""
        inside = (
            valid_value(value, dtype)
            & (F.col("low").isNull() | (value > F.col("low")))
            & (F.col("high").isNull() | (value < F.col("high")))
        )
        return rows.join(_sendable(intervals, small), _same_group(keys, names)).where(inside)

    while True:
        undecided = F.col("answer").isNull() & (F.col("size") > group_values)
        wide = state.where(undecided)
        if wide.isEmpty():
            break
        state = pinned(state.where(~undecided).unionByName(_narrow_groups(wide, members, slot, value, dtype)))

    left = state.where(F.col("answer").isNull())
    histogram = (
        members(left)
        .groupBy(*slot, "below", value.alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # At most group_values rows share a slot here.
    seen = F.sum("copies").over(
        Window.partitionBy(*slot).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = F.col("rank") - F.col("below")
    selected = (
        histogram.withColumn("seen", seen)
        .where((F.col("seen") > local) & (F.col("seen") - F.col("copies") <= local))
        .select(*names, F.col("v").cast("double").alias("answer"))
    )
    decided = state.where(F.col("answer").isNotNull()).select(*names, "answer")
    return (
        selected.unionByName(decided)
        .groupBy(*names)
        .agg(F.avg("answer").alias(metric))
        .select(*[F.col(g).alias(k) for g, k in zip(names, keys)], col(metric))
    )


def _narrow_groups(wide: DataFrame, members, slot: list[str], value: Column, dtype) -> DataFrame:
    grid = [i / _GRID for i in range(_GRID + 1)]
    sketches = members(wide).groupBy(*slot).agg(
        F.percentile_approx(value, grid, _SKETCH_ACCURACY).alias("grid"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
    steps = (F.col("rank") - F.col("below") + 0.5) / F.col("size") * _GRID
    left_step = F.greatest(F.floor(steps).cast("int") - 1, F.lit(0))
    right_step = F.least(F.ceil(steps).cast("int") + 1, F.lit(_GRID))
    left, right = F.get("grid", left_step), F.get("grid", right_step)
    low, high = F.col("low"), F.col("high")
    # Whole numbers may be too close for a sketch of doubles; halve those.
    splitting = (low.isNull() | (left > low)) & (high.isNull() | (right < high))
    bounds = pinned(
        _by_slot(wide, sketches, slot).select(
            *wide.columns,
            F.when(splitting, left).otherwise(F.col("lowest")).alias("a"),
            F.when(splitting, right).otherwise(_middle(dtype)).alias("b"),
        )
    )
    a, b = F.col("a"), F.col("b")
    counts = (
        members(bounds)
        .groupBy(*slot)
        .agg(
            F.count_if(value < a).alias("under"),
            F.count_if(value == a).alias("at_a"),
            F.count_if((value > a) & (value < b)).alias("between"),
            F.count_if((value == b) & (a < b)).alias("at_b"),
        )
    )
    local = F.col("rank") - F.col("below")
    to_a = F.col("under") + F.col("at_a")
    to_mid = to_a + F.col("between")
    to_b = to_mid + F.col("at_b")

    def piece(before, on_a, middle, on_b, after) -> Column:
        return (
            F.when(local < F.col("under"), before)
            .when(local < to_a, on_a)
            .when(local < to_mid, middle)
            .when(local < to_b, on_b)
            .otherwise(after)
        )

    none = F.lit(None)
    size, below = F.col("size"), F.col("below")
    return _by_slot(bounds, counts, slot).select(
        *slot,
        piece(F.col("under"), size, F.col("between"), size, size - to_b).alias("size"),
        piece(below, below, below + to_a, below, below + to_b).alias("below"),
        piece(low, low, a, low, b).cast(dtype).alias("low"),
        piece(a, high, b, high, high).cast(dtype).alias("high"),
        piece(none, a, none, b, none).cast("double").alias("answer"),
    )


def _middle(dtype: T.DataType) -> Column:
    """A value between ``lowest`` and ``highest``; the sum of halves cannot overflow."""
    lowest, highest = F.col("lowest"), F.col("highest")
    if not isinstance(dtype, T.IntegralType):
        half = (lowest + (highest - lowest) / 2).cast(dtype)
        return F.least(highest, F.greatest(lowest, half))
    half = F.shiftright(lowest.cast("bigint"), 1) + F.shiftright(highest.cast("bigint"), 1)
    return F.greatest(lowest, half.cast(dtype))


def _by_slot(left: DataFrame, right: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Add the measures of ``right`` to ``left``; null group keys match."""
    renamed = right.select(
        *[F.col(c).alias(f"r_{c}") for c in slot],
        *[c for c in right.columns if c not in slot],
    )
    condition = reduce(
        lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in slot]
    )
    return left.join(renamed, condition).drop(*[f"r_{c}" for c in slot])
