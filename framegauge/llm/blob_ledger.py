"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text.  The
ledger, a folder of Parquet tables, knows which blobs were scanned with which rule
version and what was found.  A scan reads the text of one version of each blob that
the ledger lacks for this rule version, writes the findings and then the ledger rows,
and joins the findings of all blobs back to every path and version.  Only findings
whose scan is in the ledger count, so a scan that died half-way is done again.

Spans come from built-in functions alone: the matches of a pattern and the text
between them alternate, so running sums of their lengths are the places, in code
points.  Null content is empty; null paths and repeated rows are kept; equal
blobs share their findings; an empty table gives no row; other columns are ignored.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegauge.schema import col, free_names
from framegauge.storage import pinned


class Rule(NamedTuple):
    """A kind of secret: all matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The rules in their order.  Runs of one class are matched with their
# least length, which finds the same matches as a filter afterwards.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULE_VERSION = "1"

_LEDGER = "blob string, rule_version string, scan string"
_FINDINGS = "blob string, rule_version string, scan string, kind_order int, kind string, first long, last long"


def find_spans(texts: DataFrame, key: str, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``key``, ``kind_order``, ``kind``, ``first``, ``last`` (exclusive) of all secrets.

    Rows of one ``key`` must have the same text; it is scanned once.
    """
    # The places are running sums by key, which a repeated row would count again.
    some = texts.where(_matched(text, rules)).dropDuplicates([key])
    found = None
    for order, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        own = some.where(F.col(text).rlike(rule.pattern)).select(
            key, F.posexplode(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match")))
        )
        lengths = F.length("col.gap") + F.coalesce(F.length("col.match"), F.lit(0))
        through = F.sum(lengths).over(Window.partitionBy(key).orderBy("pos"))
        value = F.col("col.match") if not rule.group else F.regexp_extract("col.match", rule.pattern, rule.group)
        spans = own.select(
            key,
            F.lit(order).alias("kind_order"),
            F.lit(rule.kind).alias("kind"),
            (through - F.length("col.match")).cast("long").alias("first"),
            through.cast("long").alias("last"),
            F.length(value).alias("size"),
        ).where(F.col("size") >= rule.least)
        found = spans if found is None else found.unionByName(spans)
    return found.drop("size")


def _matched(text: str, rules: Sequence[Rule]) -> Column:
    """Whether a pattern occurs in the text; without one there is no finding. False for null."""
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.col(text).rlike(rule.pattern)
    return F.coalesce(hit, F.lit(False))


def update_ledger(
    spark: SparkSession,
    versions: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    rule_version: str = RULE_VERSION,
) -> None:
    """Scan the blobs of ``versions`` that the ledger lacks for this rule version.

    ``versions`` has ``path``, ``version``, ``content``; ``ledger`` is the address of a
    folder that all machines share.
    """
    addressed = versions.select(
        F.col("path").cast("string").alias("path"),
        F.col("version").cast("string").alias("version"),
        F.coalesce("content", F.lit("")).alias("content"),
        blob_of("content").alias("blob"),
    )
    source = F.min(F.struct("path", "version")).alias("source")
    unseen = pinned(
        addressed.groupBy("blob").agg(source).join(_scanned(spark, ledger, rule_version), "blob", "left_anti")
    )
    # One version of each unseen blob; the keys differ, so no task is hot.
    wanted = unseen.select("blob", "source.path", "source.version")
    same = (
        (addressed["blob"] == wanted["blob"])
        & addressed["path"].eqNullSafe(wanted["path"])
        & addressed["version"].eqNullSafe(wanted["version"])
    )
    fresh = find_spans(addressed.join(wanted, same, "left_semi"), "blob", "content", rules)
    marks = [F.lit(rule_version).alias("rule_version"), F.lit(uuid.uuid4().hex).alias("scan")]
    rows = fresh.select("blob", *marks, "kind_order", "kind", "first", "last").distinct()
    rows.write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", *marks).write.mode("append").parquet(f"{ledger}/scanned")


def blob_of(content: str) -> Column:
    """The address of a text."""
    return F.sha2(F.coalesce(F.col(content), F.lit("")), 256)


def _scanned(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    return _table(spark, f"{ledger}/scanned", _LEDGER).where(F.col("rule_version") == rule_version)


def findings_by_blob(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """``blob``, ``findings``: (first, kind_order, last, kind) in that order."""
    found = _table(spark, f"{ledger}/findings", _FINDINGS).join(
        _scanned(spark, ledger, rule_version), ["blob", "rule_version", "scan"], "left_semi"
    )
    return found.groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("first", "kind_order", "last", "kind"))).alias("findings")
    )


def scan_versions(
    spark: SparkSession,
    versions: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Every row's ``path``, ``version``, ``blob`` and ``findings``, scanning what is new.

    ``findings`` is empty where nothing was found.
    """
    update_ledger(spark, versions, ledger, rules, rule_version)
    # Written first, so that the join is a stage of its own and a hot blob can be dealt out.
    found = pinned(findings_by_blob(spark, ledger, rule_version))
    none = F.array().cast(found.schema["findings"].dataType)
    rows = versions.select("path", "version", blob_of("content").alias("blob")).join(found, "blob", "left")
    return rows.select("path", "version", "blob", F.coalesce("findings", none).alias("findings"))


def redact(
    spark: SparkSession, docs: DataFrame, ledger: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets.

    A column ``n_chars`` of lengths follows the change.  Only texts in which a pattern occurs
    meet the ledger; all others stay in their place.
    """
    versions = docs.select(
        F.col(id_column).alias("path"), F.lit(0).alias("version"), F.col(text_column).alias("content")
    )
    update_ledger(spark, versions, ledger)
    blob, findings, before, after = free_names(docs, "blob", "findings", "before", "after")
    found = pinned(findings_by_blob(spark, ledger))
    found = found.select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    hit = _matched(text_column, RULES)
    rows = docs.where(hit).select("*", blob_of(text_column).alias(blob), F.col(text_column).alias(before))
    rows = rows.join(found, blob, "left")
    # Under a name of its own: a lambda that reads the text must not meet the text it makes.
    cleaned = F.when(F.col(findings).isNotNull(), redacted(F.col(before), F.col(findings))).otherwise(F.col(before))
    rows = rows.withColumn(after, cleaned)
    longer = F.coalesce(F.length(after) - F.length(before), F.lit(0))
    columns = []
    for name in docs.columns:
        value = col(name)
        if name == text_column:
            value = F.col(after).alias(name)
        elif name == "n_chars":
            value = (value + longer).cast(docs.schema[name].dataType).alias(name)
        columns.append(value)
    return rows.select(*columns).union(docs.where(~hit))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def redacted(text: Column, findings: Column) -> Column:
    """``text`` with each stretch covered by findings replaced by its kind in brackets."""
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit("").alias("kept"),
    )

    def step(state: Column, finding: Column) -> Column:
        first, last, at = finding["first"], finding["last"], state["at"]
        before = F.substring(text, (at + 1).cast("int"), (first - at).cast("int"))
        mark = F.concat(before, F.lit("["), finding["kind"], F.lit("]"))
        return F.struct(
            F.greatest(at, last).alias("at"),
            F.when(first >= at, F.concat(state["kept"], mark)).otherwise(state["kept"]).alias("kept"),
        )

    def finish(state: Column) -> Column:
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(state["kept"], rest)

    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, start, step, finish))
