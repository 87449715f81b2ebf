"""Top-k, the WARC audit and the pipeline against brute force."""

import gzip
import hashlib
import math
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framegauge.llm import fertility, merkle, simhash, topk, toxicity

# --- top-k -------------------------------------------------------------------


def _slow_top(rows, k):
    whole = []
    for at, (name, vector) in enumerate(rows):
        if name is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            whole.append((at, name, [math.floor(64 * float(np.float32(x))) for x in vector]))
    found = []
    for at, name, query in whole:
        if name % 20 == 0:
            scored = [
                (-sum(a * b for a, b in zip(query, v)), other)
                for place, other, v in whole
                if place != at and len(v) == len(query)
            ]
            found += [(name, rank, other, -s) for rank, (s, other) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def _rows(source, count, dim):
    return [(k, source.integers(-3, 4, dim).astype(float).tolist()) for k in range(count)]


def test_top_k(spark):
    source = np.random.default_rng(1)
    rows = _rows(source, 130, 4) + [(k, source.normal(size=3).tolist()) for k in range(200, 260)]
    rows += [(0, [1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (300, None), (320, []), (340, [1.0, None, 2.0, 3.0])]
    rows += [(360, [float("nan"), 1.0, 1.0, 1.0]), (380, [float("inf"), 1.0, 1.0, 1.0]), (400, [2.0])]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    for tile_rows, shard_rows in ((2, 7), (1_024, 4_096)):
        found = topk.top_k(frame, F.col("id") % 20 == 0, k=5, tile_rows=tile_rows, shard_rows=shard_rows)
        assert sorted(map(tuple, found.collect())) == _slow_top(rows, 5)
    assert topk.top_k(frame.where("false"), F.col("id") % 20 == 0).count() == 0


def test_exact_products():
    big = np.array([[2.0**40, 3.0]])
    assert topk.inner_products(big, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 3
    with pytest.raises(OverflowError):
        topk.inner_products(big, np.array([[2.0**40, 1.0]]))


def test_partial_selection_keeps_ties():
    ids = np.arange(100)[::-1].copy()
    found, scores = topk.best(ids, np.ones((2, 100), dtype=np.int64), 3)
    assert found.tolist() == [[0, 1, 2]] * 2 and scores.tolist() == [[1, 1, 1]] * 2


# --- WARC --------------------------------------------------------------------


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    rows = [(k, f"http://x/{k}", "<p>" + "text " * (k % 50)) for k in range(120)]
    rows += [(None, None, None), (5, "http://x/5", "again"), (300, "u", "é" * 90_000)]
    pages = spark.createDataFrame([(*r, "f") for r in rows], "page_id long, url string, html string, file string")
    index = merkle.write_warc(pages, f"{folder}/one", file_bytes=3_000)
    return folder, index, rows


def test_records_can_be_read_back(spark, archive):
    folder, index, rows = archive
    files = {r.file: bytes(r.content) for r in merkle._files(spark, f"{folder}/one").collect()}
    found = []
    for r in index.collect():
        record = gzip.decompress(files[r.file][r.offset : r.offset + r.length])
        assert hashlib.sha256(record).hexdigest() == r.record_sha256 and len(record) == r.record_bytes
        found.append((str(r.id), record))
    assert sorted(found) == sorted((str(k), merkle.record_bytes(u, h)) for k, u, h in rows)
    assert len(files) > 3 and sum(map(len, files.values())) == sum(r.length for r in index.collect())


def _audit(spark, archive, name, change):
    folder, index, _ = archive
    merkle.copy_archive(spark, f"{folder}/one", f"{folder}/{name}", change)
    mine, theirs = (merkle.merkle_levels(spark, f"{folder}/{n}", f"{folder}/one") for n in ("one", name))
    return {(r.file, r.ordinal) for r in merkle.damaged_records(mine, theirs, index).collect()}


def test_audit_finds_just_the_damage(spark, archive):
    index = sorted(archive[1].collect(), key=lambda r: (r.file, r.ordinal))
    assert _audit(spark, archive, "same", None) == set()
    flipped = _audit(
        spark,
        archive,
        "flipped",
        lambda content, records: b"".join(
            content[o : o + n - 1] + bytes([content[o + n - 1] ^ (k == 37)]) for o, n, k in records
        ),
    )
    assert flipped == {(r.file, r.ordinal) for r in index if r.id == 37}
    last = {r.file: r.ordinal for r in index}
    cut = _audit(spark, archive, "cut", lambda content, records: content[:-1])
    assert cut == set(last.items())
    gone = index[0].file
    lost = _audit(
        spark, archive, "lost", lambda content, records: None if any(k is None for _, _, k in records) else content
    )
    assert lost == {(r.file, r.ordinal) for r in index if r.file == gone}


def _damage(spark, archive, one, two):
    folder, index, _ = archive
    mine, theirs = (merkle.merkle_levels(spark, f"{folder}/{n}", f"{folder}/one") for n in (one, two))
    return merkle.damaged_records(mine, theirs, index).collect()


def test_audit_of_replicas_that_lack_files(spark, archive):
    folder, index, _ = archive
    records = index.collect()
    sizes = Counter(r.file for r in records)
    widest = max(sizes, key=lambda file: (sizes[file], file))
    assert sizes[widest] >= merkle.FAN_OUT > min(sizes.values())
    wide = lambda records: len(records) >= merkle.FAN_OUT
    merkle.copy_archive(spark, f"{folder}/one", f"{folder}/narrow", lambda c, r: None if wide(r) else c)
    everything = sorted((r.file, r.ordinal) for r in records)
    lost = sorted((r.file, r.ordinal) for r in records if sizes[r.file] >= merkle.FAN_OUT)
    for other, want in (("nowhere", everything), ("narrow", lost)):
        for pair in (("one", other), (other, "one")):
            assert sorted((r.file, r.ordinal) for r in _damage(spark, archive, *pair)) == want


def test_audit_finds_bytes_that_are_no_record(spark, archive):
    folder, index, _ = archive
    merkle.copy_archive(
        spark, f"{folder}/one", f"{folder}/longer", lambda c, r: c + b"tail" if any(k is None for _, _, k in r) else c
    )
    own = sorted((r for r in index.collect()), key=lambda r: (r.file, r.ordinal))
    file = own[0].file
    place = f"{folder}/longer".removeprefix("file://")
    with open(f"{place}/part-999999-00000.warc.gz", "wb") as out:
        out.write(b"surplus")
    last = [r for r in own if r.file == file][-1]
    want = [(file, last.ordinal + 1, last.offset + last.length, 4, None), ("part-999999-00000.warc.gz", 0, 0, 7, None)]
    for pair in (("one", "longer"), ("longer", "one")):
        found = _damage(spark, archive, *pair)
        assert sorted((r.file, r.ordinal, r.offset, r.length, r.id) for r in found) == want


def test_trees_have_roots_over_all_ranges(spark, archive):
    folder, index, _ = archive
    levels = merkle.merkle_levels(spark, f"{folder}/one", f"{folder}/one")
    roots = {r.file: (r.node, r.first, r.last) for r in levels[-1].collect()}
    sizes = {r.file: r.size for r in index.groupBy("file").agg(F.sum("length").alias("size")).collect()}
    assert roots == {file: (0, 0, size) for file, size in sizes.items()}


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/none"
    index = merkle.write_warc(pages, folder)
    levels = merkle.merkle_levels(spark, folder, folder)
    assert index.count() == 0 and merkle.damaged_records(levels, levels, index).count() == 0


# --- pipeline ----------------------------------------------------------------


def test_stages_take_effect_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.collect()

    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, learn))
    scores = dict(zip([r.doc_id for r in before], toxicity.score_texts([r.text for r in before], model)))
    assert {r.doc_id for r in clean.collect()} == {k for k, s in scores.items() if s < 0.3}

    good = corpus_pipeline.drop_low_quality(spark, clean, sf_dir).cache()
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    judged = fertility.judge(fertility.document_measures(clean, vocabulary))
    assert {r.doc_id for r in good.collect()} == {r.id for r in judged.where("kept").collect()}

    unique = corpus_pipeline.drop_near_duplicates(spark, good, sf_dir).cache()
    groups = simhash.near_duplicates(good).collect()
    assert {r.doc_id for r in unique.collect()} == {r.component for r in groups}

    redacted = corpus_pipeline.redact_secrets(spark, unique, sf_dir).cache()
    assert redacted.count() == unique.count()
    assert clean.columns == good.columns == unique.columns == redacted.columns == columns
    assert all(r.n_chars == len(r.text) for r in redacted.collect() if "[hex]" in r.text)

    packed = corpus_pipeline.pack_sequences(spark, redacted, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in redacted.collect()}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(whole) == pieces(packed)


def test_stages_with_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, score int, bits int"
    text = "some words that make a short document which is long enough to stay here"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " token = 'abcdefghijklmnop'")]
    docs = spark.createDataFrame([(*r, None, None, None, 1, 2, 3) for r in rows], schema)
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, frame, sf_dir)
            if name != "packing":
                assert result.columns == docs.columns
                frame = result.cache()
        result.collect()


def test_packed_ids():
    assert array("I", [1]).itemsize == 4
