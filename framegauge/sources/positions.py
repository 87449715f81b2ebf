"""Where a row stands in its source file.

Parquet readers number the rows of a file.  A CSV reader tells only the block of the file
that a task read; the rows of a block follow each other in that task, so a running number
taken at the scan orders them, and the rows counted in the blocks before give the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegauge.schema import free_names
from framegauge.storage import pinned

# Steps that leave the rows of a scan in the task and the order in which it read them.
_IN_PLACE = ("Project", "Filter", "SubqueryAlias", "View")


def _offers(df: DataFrame, *fields: str) -> bool:
    try:
        df.select(*[F.col(f"_metadata.{field}") for field in fields])
    except AnalysisException:
        return False
    return True


def has_row_index(df: DataFrame) -> bool:
    """True where the reader itself numbers the rows of a file."""
    return _offers(df, "file_path", "row_index")


def has_blocks(df: DataFrame) -> bool:
    """True where tasks still hold the rows of a file block in the order of the file."""
    if not _offers(df, "file_path", "file_block_start"):
        return False
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1:
        if node.nodeName() not in _IN_PLACE:
            return False
        node = node.children().head()
    return node.children().isEmpty()


def with_place(df: DataFrame) -> tuple[DataFrame, str, str] | None:
    """``df`` with two more columns, named in the result, that order its rows by file and row.

    The first is a text, the second a number; none where the order is not known.
    """
    file, row = free_names(df, "file", "row")
    path = F.col("_metadata.file_path")
    if has_row_index(df):
        return df.select("*", path.alias(file), F.col("_metadata.row_index").alias(row)), file, row
    if has_blocks(df):
        start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
        block = F.concat(path, F.lit("\0"), start)
        return df.select("*", block.alias(file), F.monotonically_increasing_id().alias(row)), file, row
    return None


def first_rows(df: DataFrame, keys: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """``names``, ``path`` and ``row``: the first row of each key in each file, from 0.

    Rows of CSV input are numbered as ``df`` holds them, without the header and without
    rows that a filter took away.
    """
    path, named = F.col("_metadata.file_path").alias("path"), [k.alias(n) for k, n in zip(keys, names)]
    if has_row_index(df):
        return df.groupBy(*named, path).agg(F.min("_metadata.row_index").alias("row"))
    if not has_blocks(df):
        raise ValueError("First-appearance order needs a DataFrame read directly from Parquet or CSV files.")
    block = F.col("_metadata.file_block_start").alias("block")
    numbered = df.select(*named, path, block, F.monotonically_increasing_id().alias("id"))
    # Pinned, because another run of the scan may cut the files into other blocks.
    found = pinned(
        numbered.groupBy(*names, "path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    blocks = found.groupBy("path", "block").agg(F.min("first").alias("begin"), F.sum("rows").alias("held"))
    before = F.sum("held").over(Window.partitionBy("path").orderBy("block")) - F.col("held")
    offsets = blocks.select("path", "block", (before - F.col("begin")).alias("offset"))
    row = (F.col("first") + F.col("offset")).alias("row")
    return (
        found.join(offsets, ["path", "block"])
        .select(*names, "path", row)
        .groupBy(*names, "path")
        .agg(F.min("row").alias("row"))
    )
