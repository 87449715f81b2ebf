"""Words of the Simple-8b files: the greedy choice at each point, and what it costs."""

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framegauge.llm import chunks, simple8b


def greedy(ids):
    """(selector, ids of the word) by the definition, one word at a time; the end is filled with zeros."""
    words, at = [], 0
    while at < len(ids):
        fitting = [
            s for s, (n, width) in enumerate(simple8b.PACKINGS) if all(i < 1 << width for i in ids[at : at + n])
        ]
        if fitting:
            n, width = simple8b.PACKINGS[fitting[-1]]
            words.append(fitting[-1] << 60 | sum(i << k * width for k, i in enumerate(ids[at : at + n])))
        else:
            n = 1
            words += [simple8b.ESCAPE << 60, ids[at]]
        at += n
    return words


def test_words_are_the_greedy_ones():
    dice = np.random.default_rng(5)
    for widest in (1, 2, 5, 9, 16, 17, 31, 60, 61, 64):
        for n in (1, 2, 59, 60, 61, 400):
            widths = np.repeat(dice.integers(0, widest + 1, n), dice.integers(1, 70, n))[:n]
            ids = [int(dice.integers(0, 1 << 63)) * 2 + 1 >> 64 - int(w) if w else 0 for w in widths]
            words = simple8b.encode(np.array(ids, dtype=np.uint64))
            assert words.tolist() == greedy(ids)
            assert simple8b.decode(words, n).tolist() == ids


def test_packing_costs_little_more_than_unpacking():
    dice = np.random.default_rng(6)
    ids = (50_000 * dice.random(65_536) ** 4).astype(np.uint64)
    words = simple8b.encode(ids)

    def best(work):
        spent = []
        for _ in range(15):
            before = time.process_time()
            work()
            spent.append(time.process_time() - before)
        return min(spent)

    # About 9 times before windows of widths were shared, 3 times since.
    assert best(lambda: simple8b.encode(ids)) < 5 * best(lambda: simple8b.decode(words, len(ids)))


def test_files_are_read_block_by_block(monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 100)
    dice = np.random.default_rng(7)
    documents = [(k, dice.integers(0, 50_000, n).astype("<u4")) for k, n in enumerate([0, 99, 1, 1_050, 0, 7, 2_300])]
    content = simple8b.file_bytes(documents, 11)
    decoded = []
    whole = simple8b.decode
    monkeypatch.setattr(simple8b, "decode", lambda words, n: decoded.append(n) or whole(words, n))
    # An open file serves, so that no step has to hold one whole.
    found = simple8b.file_documents(pa.BufferReader(content))
    start = 11
    for name, ids in documents:
        assert [*next(found)[:2]] == [name, start]
        start += len(ids)
        # Blocks are decoded no sooner than their documents are asked for.
        assert sum(decoded) < start - 11 + 100
    assert next(found, None) is None and sum(decoded) == start - 11
    assert [ids.tolist() for _, _, ids in simple8b.file_documents(content)] == [ids.tolist() for _, ids in documents]


def test_no_file_passes_whole_through_the_jvm(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(50)], "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    starts = simple8b.write_token_files(docs, folder, tokenizer, end_id=2)
    read = simple8b.read_token_files(spark, folder, starts)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan
    assert read.count() == 50


@pytest.mark.parametrize("name, drops_spaces", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_texts_cut_together_have_the_ids_of_each(monkeypatch, name, drops_spaces):
    monkeypatch.setattr(chunks, "_LONGEST_JOINED", 500)
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    texts = ["", "one two, two.", "a\0b  c", "\0", " ", "x  y \n z", "<|endoftext|> a", "long one. " * 60, "é one two, 字🙂", "", "two"]
    encoder = chunks._library_encoder(path, drops_spaces, 10_000)
    for own in (texts, texts[:1], texts[2:3], []):
        found = [np.frombuffer(ids, "<u4").tolist() for ids in chunks.encode_texts(encoder, own)]
        assert found == [tokenizer.encode(text, add_special_tokens=False).ids for text in own]


def test_texts_cut_together_meet_a_chunk_once():
    made = []
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = chunks._library_encoder(path, False, 10_000)
    make = encoder.store._make
    encoder.store._make = lambda chunk: made.append(chunk) or make(chunk)
    word = "longer" * 20  # too long to be kept
    list(chunks.encode_texts(encoder, [f"{k} {word} {word}" for k in range(50)]))
    assert made.count(" " + word) == 1
