"""Statistical quality checks and configurable validity rules."""

from __future__ import annotations

from collections.abc import Container, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.quantiles import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    HELD_VALUES,
    nearest_quantiles,
    one_row,
    one_row_per_column,
    rankable_counts,
    rankable_expressions,
)
from framegauge.names import exact_names
from framegauge.operators.distinct import duplicate_row_count
from framegauge.schema import MISSING_IN_RULE, col, data_type, numeric_columns, order_key, require
from framegauge.sources.positions import with_place

# The texts of findings.
NEGATIVE_TEXT = "Negative values found in '{}', which is configured as non-negative."
ORDER_TEXT = "'{}' occurs after '{}' in some rows."
CATEGORY_TEXT = "Unexpected categorical values found in '{}'."
MAXIMUM_TEXT = "Values in '{}' exceed the configured maximum of {}."
DATE_RANGE_TEXT = "Dates in '{}' fall outside the configured range."
# The warnings of a report.
MISSING_WARNING = "Missing values detected in {} column(s)."
DUPLICATE_WARNING = "{} duplicate row(s) detected."
OUTLIER_WARNING = "Potential IQR outliers detected in {} numeric column(s)."

_MIN_VALUES_FOR_IQR = 4
# Columns per pass where each needs only one or two cheap counts.
_LIGHT_COLUMNS_PER_PASS = 24
_FINDING_SCHEMA = (
    "check string, severity string, target string, affected_rows bigint, "
    "affected_pct double, message string, examples array<string>"
)


# --- statistical checks ------------------------------------------------------


@exact_names(texts=["column"])
def null_counts(df: DataFrame, *, only_missing: bool = False) -> DataFrame:
    """``column, row_count, null_count, null_pct`` for every column, in one pass."""
    rows = F.count(F.lit(1))

    def entry(c: str) -> Column:
        nulls = rows - F.count(col(c))
        percent = F.round(F.coalesce(F.try_divide(nulls * 100.0, rows), F.lit(0.0)), 4)
        return F.struct(
            F.lit(c).alias("column"),
            rows.alias("row_count"),
            nulls.alias("null_count"),
            percent.alias("null_pct"),
        )

    counted = one_row_per_column(df, df.columns, entry, _LIGHT_COLUMNS_PER_PASS)
    return counted.where("null_count > 0") if only_missing else counted


@exact_names()
def completeness(df: DataFrame) -> DataFrame:
    """``row_count, column_count, null_cells, completeness_pct`` in one row."""
    width = len(df.columns)
    counted = null_counts(df).agg(
        F.max("row_count").alias("row_count"), F.sum("null_count").alias("null_cells")
    )
    share = F.try_divide(F.col("null_cells"), F.col("row_count") * width)
    return counted.select(
        "row_count",
        F.lit(width).alias("column_count"),
        "null_cells",
        F.round(F.coalesce((1 - share) * 100, F.lit(100.0)), 2).alias("completeness_pct"),
    )


@exact_names(texts=["target"])
def quality_checks(df: DataFrame, *, held_values: int = HELD_VALUES) -> DataFrame:
    """The checks that need no rules, as ``check, target, affected_rows, affected_pct``.

    One row per column with missing values, one if there are duplicate rows,
    and one per column with IQR outliers.
    """
    missing = null_counts(df, only_missing=True).select(
        F.lit("MISSING_VALUES").alias("check"),
        F.col("column").alias("target"),
        F.col("null_count").alias("affected_rows"),
        "row_count",
    )
    duplicates = (
        duplicate_row_count(df)
        .where("duplicate_row_count > 0")
        .select(F.lit("DUPLICATE_ROWS"), F.lit(None).cast("string"), "duplicate_row_count", "row_count")
    )
    outliers = iqr_outliers(df, held_values=held_values).select(
        F.lit("IQR_OUTLIERS"), "column", "outlier_count", "row_count"
    )
    percent = F.round(F.col("affected_rows") * 100.0 / F.col("row_count"), 4)
    return (
        missing.unionAll(duplicates)
        .unionAll(outliers)
        .select("check", "target", "affected_rows", percent.alias("affected_pct"))
    )


def iqr_quartiles(
    df: DataFrame, columns: Sequence[str] | None = None, *, held_values: int = HELD_VALUES
) -> dict[str, tuple[float, float]]:
    """Nearest-rank quartiles of the columns that can have IQR outliers.

    Columns with fewer than four values or a zero range are left out.
    """
    chosen = numeric_columns(df) if columns is None else list(columns)
    if not chosen:
        return {}
    valid, nans = rankable_counts(df, chosen)
    return _usable_quartiles(df, valid, nans, held_values)


def _usable_quartiles(
    df: DataFrame, valid: Mapping[str, int], nans: Mapping[str, int], held_values: int
) -> dict[str, tuple[float, float]]:
    enough = {c: valid[c] for c in valid if valid[c] + nans[c] >= _MIN_VALUES_FOR_IQR}
    found = nearest_quantiles(df, [0.25, 0.75], enough, nans, held_values)
    return {c: (q1, q3) for c, (q1, q3) in found.items() if q3 - q1 != 0}


@exact_names("columns", texts=["column"])
def iqr_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    keep_all: bool = False,
    held_values: int = HELD_VALUES,
) -> DataFrame:
    """``column, q1, q3, lower, upper, outlier_count, row_count`` of columns with outliers.

    ``keep_all`` keeps the tested columns that turn out to have none.
    """
    quartiles = iqr_quartiles(df, columns, held_values=held_values)
    if not quartiles:
        return df.sparkSession.createDataFrame(
            [],
            "column string, q1 double, q3 double, lower double, upper double, "
            "outlier_count bigint, row_count bigint",
        )

    def entry(c: str) -> Column:
        q1, q3 = quartiles[c]
        lower, upper = _fences(q1, q3)
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(q1).alias("q1"),
            F.lit(q3).alias("q3"),
            F.lit(lower).alias("lower"),
            F.lit(upper).alias("upper"),
            F.count_if(_outlying(c, q1, q3)).alias("outlier_count"),
            F.count(F.lit(1)).alias("row_count"),
        )

    counted = one_row_per_column(df, list(quartiles), entry, _LIGHT_COLUMNS_PER_PASS)
    return counted if keep_all else counted.where(F.col("outlier_count") > 0)


def _fences(q1: float, q3: float) -> tuple[float, float]:
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def _outlying(column: str, q1: float, q3: float) -> Column:
    lower, upper = _fences(q1, q3)
    return (col(column) < lower) | (col(column) > upper)


# --- validity rules ----------------------------------------------------------


@dataclass
class _Rule:
    """A rule; ``broken`` is null where the values meet a list of ``allowed`` ones."""

    check: str
    severity: str
    target: str
    message: str
    broken: Column | None = None
    column: str | None = None
    allowed: list[Any] = field(default_factory=list)


def _rules(
    df: DataFrame,
    non_negative_columns: Iterable[str] | None = None,
    datetime_order_pairs: Iterable[tuple[str, str]] | None = None,
    expected_categories: Mapping[str, Iterable[Any]] | None = None,
    maximum_values: Mapping[str, float] | None = None,
    date_ranges: Mapping[str, tuple[Any, Any]] | None = None,
) -> list[_Rule]:
    rules: list[_Rule] = []
    for c in non_negative_columns or ():
        require(df, [c], MISSING_IN_RULE)
        rules.append(_Rule("NON_NEGATIVE", "ERROR", c, NEGATIVE_TEXT.format(c), col(c) < 0, c))
    for start, end in datetime_order_pairs or ():
        require(df, [start], MISSING_IN_RULE)
        require(df, [end], MISSING_IN_RULE)
        text = ORDER_TEXT.format(start, end)
        late = col(start) > col(end)
        rules.append(_Rule("DATETIME_ORDER", "ERROR", f"{start} <= {end}", text, late))
    for c, values in (expected_categories or {}).items():
        require(df, [c], MISSING_IN_RULE)
        allowed = [v for v in dict.fromkeys(values) if v is not None]
        text = CATEGORY_TEXT.format(c)
        rules.append(_Rule("EXPECTED_CATEGORY", "WARNING", c, text, None, c, allowed))
    for c, maximum in (maximum_values or {}).items():
        require(df, [c], MISSING_IN_RULE)
        above = col(c) > F.lit(maximum)
        rules.append(_Rule("MAXIMUM_VALUE", "WARNING", c, MAXIMUM_TEXT.format(c, maximum), above, c))
    for c, (minimum, maximum) in (date_ranges or {}).items():
        require(df, [c], MISSING_IN_RULE)
        value, low = _comparable(df, c, minimum)
        _, high = _comparable(df, c, maximum)
        outside = (value < low) | (value > high)
        rules.append(_Rule("DATE_RANGE", "WARNING", c, DATE_RANGE_TEXT.format(c), outside, c))
    return rules


def _comparable(df: DataFrame, column: str, bound: Any) -> tuple[Column, Column]:
    """Column and bound in one type, without going through a machine time zone."""
    value, dtype = col(column), data_type(df, column)
    if isinstance(dtype, T.DateType):
        dtype = T.TimestampNTZType()
        value = value.cast(dtype)
    if isinstance(bound, (date, datetime)):
        return value, F.lit(str(bound)).cast(dtype)
    return value, F.lit(bound).cast(dtype)


@exact_names(
    "non_negative_columns", "datetime_order_pairs", "expected_categories", "maximum_values", "date_ranges",
    texts=["target", "message"],
)
def quality_findings(
    df: DataFrame,
    *,
    non_negative_columns: Iterable[str] | None = None,
    datetime_order_pairs: Iterable[tuple[str, str]] | None = None,
    expected_categories: Mapping[str, Iterable[Any]] | None = None,
    maximum_values: Mapping[str, float] | None = None,
    date_ranges: Mapping[str, tuple[Any, Any]] | None = None,
    example_limit: int = 5,
) -> DataFrame:
    """One row per broken rule, with a few of the offending values as text.

    All rules share one pass.  Examples are the first bad values in file order
    where the source tells it (a direct read of Parquet or CSV), else the smallest ones;
    unexpected categories are listed once each.
    """
    rules = _rules(
        df,
        non_negative_columns,
        datetime_order_pairs,
        expected_categories,
        maximum_values,
        date_ranges,
    )
    if not rules:
        return df.sparkSession.createDataFrame([], _FINDING_SCHEMA)
    total, *affected = one_row(df, [F.count(F.lit(1)), *_break_counts(rules)])
    found = _findings(df, rules, affected, total, example_limit)
    return df.sparkSession.createDataFrame(found, _FINDING_SCHEMA)


def _break_counts(rules: Sequence[_Rule]) -> list[Column]:
    """Counts of broken rows for the rules that a shared pass can count."""
    return [F.count_if(r.broken) for r in rules if r.broken is not None]


def _findings(
    df: DataFrame, rules: Sequence[_Rule], affected: Sequence[int], total: int, example_limit: int
) -> list[tuple]:
    """Rows of the broken rules; ``affected`` are the values of :func:`_break_counts`."""
    tested = [i for i, r in enumerate(rules) if r.broken is not None]
    broken_rows = {i: n for i, n in zip(tested, affected) if n > 0}
    examples: dict[int, list[str]] = {}
    # At most ``example_limit`` values a rule, and a count for each list.
    for row in _shown(df, rules, broken_rows, max(example_limit, 0)):
        if row.number == 0:
            broken_rows[row.rule] = row.copies
        else:
            examples.setdefault(row.rule, []).append(row.v)
    return [
        (r.check, r.severity, r.target, n, round(n / total * 100, 4), r.message, examples.get(i))
        for i, r in enumerate(rules)
        if (n := broken_rows.get(i, 0)) > 0
    ]


@exact_names("rules", texts=["target", "message", "warning"])
def quality_table(
    df: DataFrame, *, example_limit: int = 5, held_values: int = HELD_VALUES, **rules: Any
) -> DataFrame:
    """The whole report; ``rules`` as in :func:`quality_findings`.

    One row ``DATASET``, one per result of :func:`quality_checks`, and one per broken
    rule, in that order.  ``warning`` is the text of the report's warning that a row
    belongs to.  Every row carries the totals of the dataset.  Nulls, rankable values
    and rules are counted in one pass.
    """
    checked, names, numeric = _rules(df, **rules), df.columns, numeric_columns(df)
    found = iter(
        one_row(
            df,
            [
                F.count(F.lit(1)),
                *[F.count_if(col(c).isNull()) for c in names],
                *rankable_expressions(df, numeric),
                *_break_counts(checked),
            ],
        )
    )
    total = next(found)
    nulls = {c: n for c in names if (n := next(found))}
    ranks = [(next(found), next(found)) for _ in numeric]
    valid, nans = ({c: r[k] for c, r in zip(numeric, ranks)} for k in (0, 1))
    quartiles = _usable_quartiles(df, valid, nans, held_values)
    outside = one_row(df, [F.count_if(_outlying(c, *q)) for c, q in quartiles.items()])
    outliers = {c: n for c, n in zip(quartiles, outside) if n}
    copies = duplicate_row_count(df, rows=total).first()["duplicate_row_count"]

    def entry(check: str, target: str | None, amount: int, warning: str) -> tuple:
        return check, None, target, amount, round(amount * 100 / total, 4), None, None, warning

    entries: list[tuple] = [("DATASET", *[None] * 7)]
    entries += [entry("MISSING_VALUES", c, n, MISSING_WARNING.format(len(nulls))) for c, n in nulls.items()]
    if copies:
        entries.append(entry("DUPLICATE_ROWS", None, copies, DUPLICATE_WARNING.format(copies)))
    entries += [entry("IQR_OUTLIERS", c, n, OUTLIER_WARNING.format(len(outliers))) for c, n in outliers.items()]
    cells = total * len(names)
    complete = round((1 - sum(nulls.values()) / cells) * 100, 2) if cells else 100.0
    for row in _findings(df, checked, list(found), total, example_limit):
        entries.append((*row, f"{row[1]}: {row[5]}"))
    report = df.sparkSession.createDataFrame(entries, f"{_FINDING_SCHEMA}, warning string")
    return report.select(
        "*",
        F.lit(total).cast("bigint").alias("row_count"),
        F.lit(len(names)).alias("column_count"),
        F.lit(complete).alias("completeness_pct"),
    )


def _shown(df: DataFrame, rules: Sequence[_Rule], failing: Container[int], limit: int) -> list[Row]:
    """``rule, number, v, copies`` in one query: number 0 has the count of rows outside a
    list, the others are the first ``limit`` bad values of a rule in order.

    One scan makes a row of every bad value of the ``failing`` rules, with its place; each
    task keeps ``limit`` rows a rule before the shuffle.
    """
    listed = {i: r for i, r in enumerate(rules) if r.broken is None}
    tested = {i: r for i, r in enumerate(rules) if i in failing and r.column is not None} if limit else {}
    placed = with_place(df) if tested else None
    # Values of different types are ordered in columns of their own.
    types = {i: data_type(df, r.column) for i, r in (listed | tested).items()}

    def entry(rule: int, value: Column, file: Column | None, row: Column | None) -> list[Column]:
        nothing = F.lit(None)
        return [
            F.lit(rule).alias("rule"),
            value.cast("string").alias("v"),
            (nothing if file is None else file).cast("string").alias("file"),
            (nothing if row is None else row).cast("bigint").alias("row"),
            *[
                (order_key(value, t) if i == rule and file is None else nothing.cast(_order_type(t))).alias(f"k{i}")
                for i, t in types.items()
            ],
        ]

    bad, totals = [], []
    if tested:
        scanned, file, row = (placed[0], F.col(placed[1]), F.col(placed[2])) if placed else (df, None, None)
        entries = [F.when(r.broken, F.struct(*entry(i, col(r.column), file, row))) for i, r in tested.items()]
        present = F.filter(F.array(*entries), lambda e: e.isNotNull())
        bad.append(scanned.select(F.inline(present)))
    for i, r in listed.items():
        unexpected = _unexpected_values(df, r)
        if limit:
            bad.append(unexpected.select(*entry(i, F.col("v"), None, None)))
        copies = unexpected.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))
        nothing = F.lit(None).cast("string").alias("v")
        totals.append(copies.select(F.lit(i).alias("rule"), F.lit(0).alias("number"), nothing, "copies"))
    if bad:
        order = ["file", "row", *[f"k{i}" for i in types]]
        number = F.row_number().over(Window.partitionBy("rule").orderBy(*order))
        first = reduce(DataFrame.unionAll, bad).withColumn("number", number).where(F.col("number") <= limit)
        totals.append(first.select("rule", "number", "v", F.lit(None).cast("bigint").alias("copies")))
    found = reduce(DataFrame.unionAll, totals).collect() if totals else []
    return sorted(found, key=lambda r: (r.rule, r.number))


def _order_type(dtype: T.DataType) -> T.DataType:
    """The type of :func:`order_key`."""
    if not isinstance(dtype, T.MapType):
        return dtype
    entry = [T.StructField("key", dtype.keyType, False), T.StructField("value", dtype.valueType)]
    return T.ArrayType(T.StructType(entry))


# --- membership --------------------------------------------------------------


def _unexpected_values(df: DataFrame, rule: _Rule) -> DataFrame:
    """``v, copies`` of the values outside a list, counted before they meet the list.

    Values are compared in the type in which Spark compares the column with the listed
    values.  What has no form in it equals nothing.
    """
    counted = (
        df.where(col(rule.column).isNotNull())
        .groupBy(col(rule.column).alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    if not rule.allowed:
        return counted
    kinds: dict[str, list[Any]] = {}
    for value in rule.allowed:
        value = value.item() if hasattr(value, "item") else value
        kinds.setdefault(_literal_kind(value), []).append(value)
    typed = {_list_type(kind, values, data_type(df, rule.column)): values for kind, values in kinds.items()}
    nothing = [F.lit(None).cast(kind) for kind in typed]
    common = df.select(F.coalesce(col(rule.column), *nothing).alias("v")).schema["v"].dataType
    parts = [
        df.sparkSession.createDataFrame(
            [(v,) for v in values], T.StructType([T.StructField("a", kind)])
        ).select(F.col("a").try_cast(common).alias("a"))
        for kind, values in typed.items()
    ]
    allowed = reduce(DataFrame.unionAll, parts)
    if len(rule.allowed) <= BROADCAST_ROWS and _value_bytes(rule) <= BROADCAST_BYTES:
        allowed = F.broadcast(allowed)
    return counted.join(allowed, F.col("v").try_cast(common) == F.col("a"), "left_anti")


def _value_bytes(rule: _Rule) -> int:
    return sum(len(str(v).encode()) + 16 for v in rule.allowed)


def _literal_kind(value: Any) -> str:
    for kind in (bool, int, float, str, Decimal, datetime, date):
        if isinstance(value, kind):
            return kind.__name__
    return "other"


def _list_type(kind: str, values: Sequence[Any], dtype: T.DataType) -> T.DataType:
    """The Spark type of listed values of one Python type."""
    if kind == "int":
        widest = max(v if v >= 0 else ~v for v in values)
        return T.IntegerType() if widest < 1 << 31 else T.LongType() if widest < 1 << 63 else T.DecimalType(38, 0)
    if kind == "Decimal":
        scale = max(max(-v.as_tuple().exponent, 0) if v.is_finite() else 0 for v in values)
        whole = max(v.adjusted() + 1 if v.is_finite() else 0 for v in values)
        return T.DecimalType(min(max(whole, 0) + scale or 1, 38), min(scale, 38))
    types = {
        "bool": T.BooleanType(), "float": T.DoubleType(), "str": T.StringType(),
        "datetime": T.TimestampType(), "date": T.DateType(),
    }
    return types.get(kind, dtype)
