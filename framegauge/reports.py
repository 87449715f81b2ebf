"""Results as plain dicts, for callers that want one small answer.

The work is done by the operators; only their small result rows come to the
driver.  Results that may have many rows are refused above ``max_rows`` instead
of being cut; use the operator's DataFrame for those.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framegauge.operators import correlation as _correlation
from framegauge.operators import describe as _describe
from framegauge.operators import grouping as _grouping
from framegauge.operators import profile as _profile
from framegauge.operators import quality as _quality
from framegauge.operators import timeseries as _timeseries
from framegauge.schema import NUMERIC, data_type, numeric_columns, type_class

MAX_ROWS = 100_000


def small_rows(df: DataFrame, max_rows: int = MAX_ROWS) -> list[dict[str, Any]]:
    """All rows as dicts, or an error if there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"The result has more than {max_rows} rows; use its DataFrame instead.")
    return [row.asDict(recursive=True) for row in rows]


def _number(text: str | None, dtype: T.DataType) -> Any:
    """A number again from its text form, in the Python type of the column."""
    if text is None:
        return None
    if isinstance(dtype, T.IntegralType):
        return int(text)
    return Decimal(text) if isinstance(dtype, T.DecimalType) else float(text)


def profile_report(df: DataFrame) -> dict[str, Any]:
    rows = {row["name"]: row for row in _profile.profile_table(df).collect()}
    columns = []
    for name in df.columns:
        row, dtype = rows[name], data_type(df, name)
        kind = type_class(dtype)
        item = {k: row[k] for k in ("name", "dtype", "null_count", "null_pct", "unique_count")}
        if kind == _profile.OTHER:
            item["top_values"] = {t["value"]: t["count"] for t in row["top_values"]}
        elif kind == NUMERIC and row["min"] is not None:
            item |= {k: _number(row[k], dtype) for k in ("min", "max")}
            item |= {"mean": row["mean"], "median": row["median"]}
        elif row["min"] is not None:
            item |= {"min": row["min"], "max": row["max"]}
        columns.append(item)
    totals = row.asDict()
    return {
        "row_count": totals["row_count"],
        "column_count": totals["column_count"],
        "columns": columns,
        "duplicate_row_count": totals["duplicate_row_count"],
    }


def quality_report(df: DataFrame, **rules: Any) -> dict[str, Any]:
    """Statistical checks and rule findings; ``rules`` as in ``quality_findings``."""
    dataset, *rows = _quality.quality_table(df, **rules).collect()

    def amounts(check: str) -> dict[str, int]:
        return {row["target"]: row["affected_rows"] for row in rows if row["check"] == check}

    return {
        "row_count": dataset["row_count"],
        "column_count": dataset["column_count"],
        "duplicate_row_count": amounts("DUPLICATE_ROWS").get(None, 0),
        "null_counts": amounts("MISSING_VALUES"),
        "outlier_counts_iqr": amounts("IQR_OUTLIERS"),
        "completeness_pct": dataset["completeness_pct"],
        "findings": [_finding(df, row) for row in rows if row["severity"]],
        "warnings": list(dict.fromkeys(row["warning"] for row in rows)),
    }


def _finding(df: DataFrame, row: T.Row) -> dict[str, Any]:
    shown = ("check", "severity", "target", "affected_rows", "affected_pct", "message")
    finding, examples = {name: row[name] for name in shown}, row["examples"]
    if examples:
        if row["check"] != "DATE_RANGE" and type_class(data_type(df, row["target"])) == NUMERIC:
            examples = [_number(e, data_type(df, row["target"])) for e in examples]
        finding["examples"] = examples
    return finding


def describe_report(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Any]:
    chosen = list(columns) if columns is not None else numeric_columns(df)
    by_column = {row["column"]: row for row in _describe.describe(df, columns).collect()}
    rows = [_present(by_column[c].asDict()) for c in chosen]
    return {
        "analysis": "descriptive_statistics",
        "parameters": {"columns": chosen},
        "result": rows,
        "metadata": {"row_count": df.count()},
    }


def describe_numeric_report(df: DataFrame, column: str) -> dict[str, Any]:
    return _present(_describe.describe_numeric(df, column).first().asDict())


def _present(row: dict[str, Any]) -> dict[str, Any]:
    """Drop what an empty column does not have; a single value keeps its null std."""
    return row if row["count"] else {k: v for k, v in row.items() if v is not None}


def aggregate_report(
    df: DataFrame,
    *,
    group_by: Sequence[str] | None,
    metric: str | None,
    agg: str,
    max_rows: int = MAX_ROWS,
) -> dict[str, Any]:
    result = _grouping.aggregate(df, group_by=group_by, metric=metric, agg=agg)
    return {
        "analysis": "grouped_aggregation" if group_by else "aggregation",
        "parameters": {"group_by": list(group_by or []), "metric": metric, "aggregation": agg},
        "result": small_rows(result, max_rows),
        "metadata": {},
    }


def correlation_report(
    df: DataFrame, columns: Sequence[str] | None = None, *, max_rows: int = MAX_ROWS
) -> dict[str, Any]:
    chosen = list(columns) if columns is not None else numeric_columns(df)
    label = "column"
    while label in chosen:
        label += "_"
    rows = small_rows(_correlation.correlation(df, columns, label=label), max_rows)
    by_name = {row[label]: row for row in rows}
    return {
        "analysis": "correlation",
        "parameters": {"columns": chosen},
        "result": [{c: by_name[name][c] for c in chosen} for name in chosen],
        "metadata": {},
    }


def time_series_report(
    df: DataFrame,
    *,
    datetime_column: str,
    frequency: str = "1d",
    metric: str | None = None,
    agg: str = "count",
    max_rows: int = MAX_ROWS,
) -> dict[str, Any]:
    series = _timeseries.time_series(
        df, datetime_column=datetime_column, frequency=frequency, metric=metric, agg=agg
    )
    return {
        "analysis": "time_series",
        "parameters": {
            "datetime_column": datetime_column,
            "frequency": frequency,
            "metric": metric,
            "aggregation": agg,
        },
        "result": small_rows(series, max_rows),
        "metadata": {},
    }
