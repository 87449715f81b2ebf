"""Pearson correlation.

A column that holds a null is undefined (NaN) against every column, itself
included; so is a constant column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.quantiles import one_row
from framegauge.names import exact_names
from framegauge.schema import col, select_numeric

# Up to this width the matrix is summed pair by pair.
_PAIRWISE_COLUMNS = 16
# A sum of squares that keeps this share of itself when moved has lost three digits at most.
_KEPT_SHARE = 1e-3


@exact_names("columns", texts=["column"])
def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, *, label: str = "column"
) -> DataFrame:
    """Square matrix: a label column, then one column per selected column."""
    chosen = select_numeric(df, columns, "Correlation requires")
    if label in chosen:
        raise ValueError(f"Pass another label; '{label}' is a selected column.")
    if not chosen:
        return df.sparkSession.createDataFrame([], f"{label} string")
    rows = [
        F.struct(
            F.lit(a).alias(label), *[F.col(_entry(i, j)).alias(b) for j, b in enumerate(chosen)]
        )
        for i, a in enumerate(chosen)
    ]
    return _entries(df, chosen).select(F.inline(F.array(*rows)))


@exact_names("columns", texts=["column_a", "column_b"])
def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same numbers as rows ``column_a, column_b, correlation``."""
    chosen = select_numeric(df, columns, "Correlation requires")
    if not chosen:
        return df.sparkSession.createDataFrame(
            [], "column_a string, column_b string, correlation double"
        )
    rows = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.col(_entry(i, j)).alias("correlation"),
        )
        for i, a in enumerate(chosen)
        for j, b in enumerate(chosen)
    ]
    return _entries(df, chosen).select(F.inline(F.array(*rows)))


def _entry(i: int, j: int) -> str:
    return f"r_{min(i, j)}_{max(i, j)}"


def _entries(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """One row with the upper triangle of the matrix."""
    if len(chosen) <= _PAIRWISE_COLUMNS:
        return _pairwise_entries(df, chosen)
    return _vector_entries(df, chosen)


def _usable(df: DataFrame, chosen: Sequence[str]) -> tuple[list[bool], list[float]]:
    """Which columns vary and lack nothing, and the mean of each."""
    values = [col(c).cast("double") for c in chosen]
    found = one_row(
        df,
        [
            measure
            for v in values
            for measure in (F.count_if(v.isNull()), F.min(v) < F.max(v), F.avg(v))
        ],
    )
    nulls, varies, means = found[0::3], found[1::3], found[2::3]
    usable = [not n and bool(v) and math.isfinite(m) for n, v, m in zip(nulls, varies, means)]
    return usable, means


def _pairwise_entries(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Sums of products around one row's values, moved to the means afterwards.

    One scan as a rule.  Where that row lies so far out that moving would cost digits,
    the sums are taken again around the means, which are known by then.
    """
    values = [col(c).cast("double") for c in chosen]
    row = df.select(*values).first()
    origin = [v if v is not None and math.isfinite(v) else 0.0 for v in row or [0.0] * len(chosen)]
    sums, means, exact = _moved_sums(df, values, origin)
    if not exact:
        sums, _, _ = _moved_sums(df, values, means)

    def value(i: int, j: int) -> float:
        if (i, j) not in sums:
            return math.nan
        if i == j:
            return 1.0
        ratio = sums[i, j] / math.sqrt(sums[i, i]) / math.sqrt(sums[j, j])
        return min(max(ratio, -1.0), 1.0)

    return _literal_row(df, len(chosen), value)


def _moved_sums(
    df: DataFrame, values: Sequence[Column], origin: Sequence[float]
) -> tuple[dict[tuple[int, int], float], list[float], bool]:
    """Sums of products around the means for pairs of usable columns, the means, and
    whether moving the sums from ``origin`` to the means kept their digits."""
    width = len(values)
    around = [v - F.lit(o) for v, o in zip(values, origin)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    found = one_row(
        df,
        [
            F.count(F.lit(1)),
            *[m for v in values for m in (F.count(v), F.min(v) < F.max(v))],
            *[F.sum(a) for a in around],
            *[F.sum(around[i] * around[j]) for i, j in pairs],
        ],
    )
    rows, states, left = found[0], found[1 : 1 + 2 * width], found[1 + 2 * width : 1 + 3 * width]
    products = dict(zip(pairs, found[1 + 3 * width :]))
    means = [o + s / rows if rows and s is not None and math.isfinite(s) else 0.0 for o, s in zip(origin, left)]
    used = {
        i
        for i, (count, varies) in enumerate(zip(states[0::2], states[1::2]))
        if rows and count == rows and varies and math.isfinite(left[i])
    }
    sums = {
        (i, j): products[i, j] - left[i] * left[j] / rows for i, j in pairs if i in used and j in used
    }
    return sums, means, all(sums[i, i] > _KEPT_SHARE * products[i, i] for i in used)


def _literal_row(df: DataFrame, width: int, value: Callable[[int, int], float]) -> DataFrame:
    return df.sparkSession.range(1).select(
        *[F.lit(value(i, j)).alias(_entry(i, j)) for i in range(width) for j in range(i, width)]
    )


def _vector_entries(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """For wide data: the state per task is one square matrix of the columns."""
    usable, means = _usable(df, chosen)
    around = [
        (col(c).cast("double") - F.lit(m) if u else F.lit(0.0)).alias(f"v{i}")
        for i, (c, u, m) in enumerate(zip(chosen, usable, means))
    ]
    centred = df.select(*around)
    assembled = VectorAssembler(
        inputCols=centred.columns, outputCol="v", handleInvalid="keep"
    ).transform(centred)
    found = Correlation.corr(assembled, "v").first()[0].toArray() if any(usable) else None

    def value(i: int, j: int) -> float:
        if not (usable[i] and usable[j]) or math.isnan(found[i, j]):
            return math.nan
        return 1.0 if i == j else float(min(max(found[i, j], -1.0), 1.0))

    return _literal_row(df, len(chosen), value)
