"""Result rows with their trace, and JSON output."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values]).cast("array<string>")


def with_trace(
    df: DataFrame,
    *,
    operation: str,
    input_columns: Sequence[str] = (),
    filters: Sequence[str] = (),
    calculation: str = "",
    warnings: Sequence[str] = (),
    metadata: Mapping[str, object] | None = None,
) -> DataFrame:
    """One traced row per result row; the row itself becomes JSON text.

    All operations share this schema, so their results fit in one table.
    """
    entries = [F.lit(str(part)) for item in (metadata or {}).items() for part in item]
    return df.select(
        F.lit(operation).alias("operation"),
        _text_array(input_columns).alias("input_columns"),
        _text_array(filters).alias("filters"),
        F.lit(calculation).alias("calculation"),
        json_row(df).alias("result"),
        _text_array(warnings).alias("warnings"),
        F.create_map(*entries).cast("map<string,string>").alias("metadata"),
    )


def append_trace(traced: DataFrame, path: str, *, run_id: str | None = None) -> None:
    """Append traced rows to a Parquet table partitioned by operation and run.

    Rows of one operation and ``run_id`` replace those that an earlier attempt of the same
    run left there; nothing else is touched.  Without ``run_id`` every call is a run of its
    own.  An attempt without rows leaves what is there.
    """
    run = str(uuid.uuid4()) if run_id is None else run_id
    if not run:
        raise ValueError("A run id must not be empty.")
    (
        traced.withColumn("run_id", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("operation", "run_id")
        .parquet(path)
    )


def json_row(df: DataFrame) -> Column:
    """The whole row as a JSON object, null fields included."""
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame) -> DataFrame:
    """One text column ``value`` with a JSON object per row."""
    return df.select(json_row(df).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_rows(df).write.mode(mode).text(path)
