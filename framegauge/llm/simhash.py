"""SimHash near-duplicates by a grid range join over segment bit counts.

A fingerprint is a majority vote over the hashes of a document's word shingles.  Its
embedding counts the set bits of each of ``SEGMENTS`` short segments.  Flipping one
bit changes one count by one, so the Manhattan distance of two embeddings is at most
the Hamming distance of the fingerprints.

The range join finds all embeddings within Manhattan distance ``DISTANCE``.  The
counts are cut into ``BLOCKS`` runs.  Two embeddings within the distance differ in at
most ``DISTANCE`` runs, so they agree in all coordinates of at least ``BLOCKS -
DISTANCE`` runs and share one of the cells that these spell.  Each distinct
fingerprint goes to its 70 cells; within a cell the Manhattan bound is tested first and
the survivors are verified exactly.

Copies have one fingerprint and count once.  A cell emits a spanning forest of its
links, not all its pairs; cells with more than ``CELL_ROWS`` fingerprints are dealt out
as pairs of slices, so no task holds a whole hot cell and no link is lost.  Components
of the links then carry over to documents.

Null text has no word; a text without words has fingerprint zero and is linked like
any other, also to documents whose id is null.  Repeated rows are linked as copies, ties go
to the smallest id and then the smallest hash of the row, and an empty table gives no row.
Other columns, maps among them, are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framegauge.llm.components import connected_components
from framegauge.llm.workers import drop_state, slices
from framegauge.schema import col, free_names
from framegauge.storage import pinned

DISTANCE = 4
SEGMENTS = 32  # of two bits each
BLOCKS = 8
CELL_ROWS = 2_000
SALTS = 16  # tasks over which a large component is dealt

_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
_SEED = 42


def fingerprint(text: str | None, shingle_words: int) -> int:
    """A bit is set if more than half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(" ".join(words), _SEED)
    shingles = map(" ".join, zip(*(words[k:] for k in range(shingle_words))))
    hashes = np.fromiter((xxh64_intdigest(s, _SEED) for s in shingles), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4
) -> DataFrame:
    """``id`` and ``bits`` (the fingerprint as a signed long) of every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return _with_bits(rows, shingle_words).select("id", "bits")


def _with_bits(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``rows``, whose last column is the text, with ``bits`` in its place."""
    fields = [*rows.schema.fields[:-1], StructField("bits", LongType())]
    return rows.mapInArrow(partial(_fingerprint_batches, shingle_words=shingle_words), StructType(fields))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that hold maps, which Spark does not hash, as JSON."""
    values = []
    for field in docs.schema.fields:
        value = col(field.name)
        values.append(F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value)
    return F.xxhash64(*values)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    drop_state()
    for batch in slices(batches):
        *kept, texts = batch.columns
        found = [fingerprint(text, shingle_words) for text in texts.to_pylist()]
        bits = np.array(found, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(bits)], [*batch.schema.names[:-1], "bits"])


def segment_counts(bits: np.ndarray) -> np.ndarray:
    """The embedding: set bits of each two-bit segment, one row per fingerprint."""
    ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return ones.reshape(-1, SEGMENTS, 64 // SEGMENTS).sum(axis=2, dtype=np.uint8)


def _cells(bits: Column) -> tuple[Column, list[Column]]:
    """The cells of a fingerprint, and the blocks of counts (``b0``, ``b1``, ...) they spell."""
    counts = [F.bit_count(F.shiftrightunsigned(bits, 2 * k).bitwiseAND(F.lit(3))) for k in range(SEGMENTS)]
    edges = [SEGMENTS * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = []
    for first, last in zip(edges, edges[1:]):
        code = F.lit(0)
        for k in range(first, last):
            code = code * 3 + counts[k]
        blocks.append(code)
    chosen = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    return F.array(*[F.xxhash64(F.lit(n), *[F.col(f"b{k}") for k in c]) for n, c in enumerate(chosen)]), blocks


def near_links(distinct: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct ``bits`` that span all near pairs.

    Two fingerprints within ``DISTANCE`` bits are connected by the links; not each such
    pair is a link itself.
    """
    cells, blocks = _cells(F.col("bits"))
    # Each row becomes 70: a few small partitions of fingerprints would be a few very long tasks.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(tasks, "bits")
    coded = dealt.select("bits", *[b.alias(f"b{k}") for k, b in enumerate(blocks)])
    rows = coded.select(F.explode(cells).alias("cell"), "bits")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = pinned(sizes.select("cell", F.ceil(F.col("size") / cell_rows).cast("int").alias("slices")))
    shared = rows.join(sizes, "cell")
    own = F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int")
    small = shared.where("slices = 1").select("cell", F.lit(0).alias("part"), F.lit(0).alias("slice"), "bits")
    # A slice of a hot cell meets itself and every other slice once.
    large = shared.where("slices > 1").select(
        "cell", "slices", own.alias("slice"), "bits"
    ).select(
        "cell",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("slices") - 1),
                lambda other: F.least("slice", other) * F.col("slices") + F.greatest("slice", other),
            )
        ).alias("part"),
        "slice",
        "bits",
    )
    grouped = small.unionByName(large).groupBy("cell", "part")
    return grouped.applyInArrow(_cell_links, "a long, b long").distinct()


def _cell_links(table: pa.Table) -> pa.Table:
    drop_state()
    bits = np.unique(table.column("bits").to_numpy()).view(np.uint64)
    roots = np.arange(len(bits))
    counts = segment_counts(bits).astype(np.int16) if len(bits) > 2 else None
    for at in range(len(bits) - 1):
        later = np.arange(at + 1, len(bits))
        if counts is not None:
            later = later[np.abs(counts[later] - counts[at]).sum(axis=1) <= DISTANCE]
        near = later[np.bitwise_count(bits[later] ^ bits[at]) <= DISTANCE]
        for root in np.unique(roots[near]).tolist():
            if root != roots[at]:
                low, high = sorted((root, int(roots[at])))
                roots[roots == high] = low
    linked = np.flatnonzero(roots != np.arange(len(bits)))
    signed = bits.view(np.int64)
    return pa.table({"a": pa.array(signed[roots[linked]]), "b": pa.array(signed[linked])})


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4
) -> DataFrame:
    """``id``, ``bits`` and ``component`` (smallest id reachable) of every document."""
    rows = pinned(fingerprints(docs, id_column, text_column, shingle_words))
    return rows.join(components_of(rows), "bits", "left").select("id", "bits", "component")


def components_of(rows: DataFrame) -> DataFrame:
    """``bits``, ``centre`` (smallest fingerprint) and ``component`` (smallest id) of ``rows``."""
    distinct = pinned(rows.groupBy("bits").agg(F.min("id").alias("least")))
    linked = connected_components(near_links(distinct.select("bits")))
    linked = pinned(linked.select(F.col("vertex").alias("bits"), F.col("component").alias("centre")))
    members = distinct.join(linked, "bits")
    smallest = members.groupBy("centre").agg(F.min("least").alias("component"))
    # A large component is dealt over several tasks, each of which gets a copy of its smallest id.
    copies = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)).cast("int"))
    found = dealt.join(copies, ["centre", "salt"]).select("bits", "centre", "component")
    alone = distinct.join(linked, "bits", "left_anti")
    return found.unionByName(
        alone.select("bits", F.col("bits").alias("centre"), F.col("least").alias("component"))
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4
) -> DataFrame:
    """The documents, with all their columns, that come first in their component.

    First is the smallest id, then the smallest hash of the row; of wholly equal rows one stays.
    """
    id_of, row_hash = F.col(id_column).cast("long"), _row_hash(docs)
    texts = docs.select(id_of.alias("id"), row_hash.alias("row"), F.col(text_column).alias("text"))
    rows = pinned(_with_bits(texts, shingle_words))
    placed = rows.join(components_of(rows), "bits")
    first = placed.groupBy("centre").agg(F.min(F.struct("id", "row")).alias("first"))
    # One key, in which a null id equals a null id: the rows are dealt by it once, for both
    # steps.  Equal rows are combined within their task before they meet.
    (key,) = free_names(docs, "key")
    kept = first.select(F.col("first").alias(key))
    marked = docs.select("*", F.struct(id_of.alias("id"), row_hash.alias("row")).alias(key))
    return marked.dropDuplicates([key]).join(kept, key, "left_semi").select(*map(col, docs.columns))
