"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.llm import (
    blob_ledger,
    bpe,
    fertility,
    langid,
    maxent_lm,
    merkle,
    packing,
    prefix_trie,
    recompression,
    simhash,
    simple8b,
    topk,
    toxicity,
)
from framegauge.storage import new_path, pinned

Query = Callable[[SparkSession, str], DataFrame]

_ROOT = str(Path(__file__).resolve().parents[2])

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Workers import this package; a checkout need not be installed.
            spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_simple8b")
def _simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as Simple-8b files and read them back."""
    folder = new_path(spark, "token-ids")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    starts = simple8b.write_token_files(_documents(spark, sf_dir), folder, tokenizer, end_id=2)
    return simple8b.read_token_files(spark, folder, starts).withColumnRenamed("id", "doc_id")


def _remainder(column: str, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@_query("op2_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a lexicon learned from labels that are not held out."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels, _remainder("doc_id", 4) != 2)
    scored = toxicity.score_documents(docs, toxicity.fit(sample))
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(_remainder("id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@_query("op4_language")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents from centroids of those not held out."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(langid.language_sample(docs, _remainder("doc_id", 3) != 1))
    return langid.predict_languages(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(_remainder("id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


@_query("op9_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, fertility and verdict of all documents."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    judged = fertility.judge(fertility.document_measures(_documents(spark, sf_dir), model))
    return judged.withColumnRenamed("id", "doc_id")


@_query("op3_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# The kinds of secrets in their order, the pattern of each, and the
# condition on a match (DuckDB names; `m` is the match).
_SECRET_SQL_KINDS = {
    "assign": (
        """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
        """[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "length(regexp_extract(m, '{pattern}', 2)) >= 12",
    ),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"),
    "hex": ("[0-9a-f]+", "length(m) >= 16"),
}


def _secret_sql() -> str:
    parts = []
    for order, (kind, (pattern, condition)) in enumerate(_SECRET_SQL_KINDS.items()):
        parts.append(
            f"""select doc_id, {order} as kind_order, '{kind}' as kind, m,
                sum(length(gap) + length(m)) over (partition by doc_id, row_id order by pos) - length(m) as start
            from (select doc_id, row_id, unnest(range(len(ms))) as pos, unnest(ms) as m, unnest(gaps[:len(ms)]) as gap
                  from (select doc_id, row_id, regexp_extract_all(text, '{pattern}', 0) as ms,
                            regexp_split_to_array(text, '{pattern}') as gaps from texts))
            qualify {condition.format(pattern=pattern)}"""
        )
    found = "\nunion all\n".join(parts)
    return f"""
with texts as (select doc_id, row_number() over () as row_id, coalesce(text, '') as text from documents),
found as ({found}),
digests as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex,
        string_agg(kind || ':' || start || ':' || (start + length(m)), ',' order by start, kind_order) as spans
    from found group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
    coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join digests using (doc_id)"""


@_query("op5_secrets", _secret_sql())
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, through a new ledger."""
    ledger = new_path(spark, "secret-ledger")
    versions = _documents(spark, sf_dir).select(
        F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content")
    )
    found = blob_ledger.scan_versions(spark, versions, ledger)

    def joined(findings: Column) -> Column:
        spans = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["first"], f["last"]))
        return F.array_join(spans, ",")

    def counted(kind: str) -> Column:
        own = F.filter("findings", lambda f: f["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"),
        *[counted(kind) for kind in _SECRET_SQL_KINDS],
        F.sha2(joined(F.col("findings")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


_TOPK_SQL = """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
    select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
    from vectors q join vectors v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20"""


@_query("op6_topk", _TOPK_SQL)
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = topk.top_k(vectors, F.col("id") % 20 == 0, k=20, scale=64)
    return found.withColumnRenamed("id", "vec_id")


@_query("op7_bpe")
def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents with the transducer, then decode the ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decoded.withColumnRenamed("id", "doc_id")


@_query("op8_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(_documents(spark, sf_dir), tokenizer, end_id=0, capacity=2048)
    return packing.pack_pieces(pieces, capacity=2048).withColumnRenamed("id", "doc_id")


DAMAGED_EVERY, DAMAGED_REST = 61, 7


def _flip_some(content: bytes, records: list[tuple[int, int, int | None]]) -> bytes:
    """Flip one bit in the middle of each record whose id has a certain remainder."""
    changed = bytearray(content)
    for offset, length, name in records:
        if name is not None and name % DAMAGED_EVERY == DAMAGED_REST:
            changed[offset + length // 2] ^= 4
    return bytes(changed)


_WARC_SQL = f"""
with records as (
    select page_id,
        'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
        || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
        || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
    from pages)
select page_id, strlen(record) as record_bytes, sha256(record) as record_sha256,
    page_id % {DAMAGED_EVERY} = {DAMAGED_REST} as damaged
from records"""


@_query("op10_warc", _WARC_SQL)
def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, audit a replica with flipped bits, and mark the records that differ."""
    folder, replica = new_path(spark, "warc"), new_path(spark, "warc-replica")
    index = merkle.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    merkle.copy_archive(spark, folder, replica, _flip_some)
    damaged = merkle.damaged_records(
        merkle.merkle_levels(spark, folder, folder), merkle.merkle_levels(spark, replica, folder), index
    )
    marks = damaged.select("file", "ordinal", F.lit(True).alias("marked"))
    return index.join(marks, ["file", "ordinal"], "left").select(
        F.col("id").alias("page_id"),
        "record_bytes",
        "record_sha256",
        F.coalesce("marked", F.lit(False)).alias("damaged"),
    )


@_query("op11_maxent")
def _maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model of those that are not held out."""
    held_out = F.coalesce(_remainder("doc_id", 7) == 2, F.lit(False))
    docs = _documents(spark, sf_dir)
    training = docs.where(~held_out)
    counts = pinned(maxent_lm.count_words(training))
    model = maxent_lm.train(training, counts)
    scored = maxent_lm.score_documents(docs, model, counts).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


_WORDS = "[^\\x20\\x09-\\x0D]+"


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Texts in which the words repeat from some place on, for a tenth of the ids."""
    words = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(code % 10 == 0, words).alias("words"), F.floor(code / 10).alias("g"))
    sized = chosen.withColumn("n", F.size("words"))
    placed = sized.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)")
    )
    # Whole arrays only: a function of each word would work all of them out again.
    changed = F.expr(
        "array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat("
        "slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))), ' ')"
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, with planted ones."""
    found = recompression.document_runs(_with_periodic_tails(_documents(spark, sf_dir)))
    # Longest first, then by start and period.
    ordered = F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"], r["period"]))
    best = found.select("*", F.size("runs").cast("long").alias("n_runs"), F.array_min(ordered).alias("best"))
    length = -F.col("best.order")
    return best.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        "best.start",
        length.alias("length"),
        "best.period",
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


# crc32 of decimal text: each byte is followed by seven steps without one.
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))))"""

_TRIE_SQL = f"""
with turns as (
    select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as key,
        length(coalesce(text, '')) as size,
        row_number() over (partition by conv_id order by turn nulls first) - 1 as k
    from conversations where conv_id is not null),
ids as (
    select conv_id, conv_id - conv_id % 100 as base, {_CRC32_SQL.format(text="conv_id::varchar")} % 6 as h
    from (select distinct conv_id from turns)),
rebuilt as (
    select i.conv_id, 0 as part, k, key, size from ids i join turns t on t.conv_id = i.base where k < h
    union all
    select i.conv_id, 1 as part, k, key, size from ids i join turns t on t.conv_id = i.conv_id where k >= h),
paths as (
    select conv_id, coalesce(list(key order by part, k) filter (key is not null), []) as path,
        coalesce(list(size order by part, k) filter (key is not null), []) as sizes
    from ids left join rebuilt using (conv_id) group by conv_id),
nodes as (
    select path[:d] as node, d::int as depth, min(conv_id) as conv_id, count(*) as n_convs,
        coalesce(max(sizes[d]), 0) as size
    from (select *, unnest(range(len(path) + 1)) as d from paths) group by 1, 2),
children as (select node[:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node)),
below as (
    select node[:a] as node, count(*) filter (n_children = 0) as n_leaves,
        sum((n_convs - 1) * size)::bigint as saved_tokens
    from (select *, unnest(range(depth + 1)) as a from counted) group by 1),
ends as (select path as node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from paths group by 1)
select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves,
    saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from counted c join below using (node) left join ends using (node)
    left join nodes p on c.depth > 0 and p.node = c.node[:c.depth - 1]"""


@_query("op13_prefix_trie", _TRIE_SQL)
def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, many of which open like the first of their hundred."""
    paths = prefix_trie.turn_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    heads = paths.select(F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("head"))
    coded = paths.select("*", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), _remainder("conv_id", 6).cast("int").alias("h"))
    head = F.coalesce("head", F.slice("path", 1, 0))
    path = F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("path", F.col("h") + 1, F.size("path")))
    rebuilt = coded.join(heads, "base", "left").select("conv_id", path.alias("path"))
    nodes = prefix_trie.prefix_nodes(rebuilt)
    return nodes.withColumn("depth", F.col("depth").cast("long"))


@_query("pipeline")
def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
