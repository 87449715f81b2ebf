"""The maximum-entropy model against counts by definition and slow sums."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from framegauge.llm import catalogue, maxent_lm

TEXTS = [
    None, "", " \t\n", "One two THREE two", "É é one\x0btwo\x1cx", "one " * 2_000, "two three one two three one",
    "un deux trois un deux trois", "unseen", "one two three", "trois deux un", "one two three",
]


def brute_rows(texts, learned):
    """(tokens, known, base score) of each text, by definition."""

    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    counts = Counter(t for text, may in zip(texts, learned) if may for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return [
        (
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(text)),
        )
        for text in texts
    ]


def slow_score(model, counts, text):
    """The product of the softmax terms, token by token with plain sums."""
    number = {word: k for k, word in enumerate(model.words)}
    end, rest, before = len(model.words), len(model.words) + 1, len(model.words) + 2
    past, total = [before] * 3, 0.0

    def softmax(scores):
        terms = [math.exp(s) for s in scores]
        return [t / sum(terms) for t in terms]

    for word in [*(text or "").encode().lower().split(), b""]:
        own = end if word == b"" else number.get(word, rest)
        history = np.array(past)[:, None]
        rows = [0, *maxent_lm.class_rows(history)[0].tolist()]
        scores = sum(model.class_table[r].astype(float) for r in rows)
        at = maxent_lm.CLASSES - 2 if own == end else maxent_lm.CLASSES - 1
        if own < end:
            at = int(model.classes[own])
            inner = [at, *maxent_lm.word_rows(history, np.array([at]))[0].tolist()]
            within = softmax(sum(model.word_table[r].astype(float) for r in inner))
            total += math.log10(within[int(model.slots[own])]) + float(model.tails[own])
        total += math.log10(softmax(scores)[at])
        if own == rest:
            total += math.log10((counts.get(word, 0) + 1) / (model.rest_tokens + model.rest_distinct + 1))
        past = [own, *past[:2]]
    return total


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text, {"a": 1}, 1.0) for k, text in enumerate(TEXTS)] + [(None, "one two", None, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rare map<string,int>, score double")


@pytest.mark.parametrize("vocabulary", [65_536, 3])
def test_scores_by_definition(spark, docs, vocabulary):
    learned = docs.where("doc_id <> 8")
    counts = maxent_lm.count_words(learned).cache()
    model = maxent_lm.train(learned, counts, vocabulary=vocabulary)
    assert len(model.words) <= vocabulary
    rows = {r.id: r for r in maxent_lm.score_documents(docs, model, counts).collect()}
    texts = [*TEXTS, "one two"]
    known = {r.word.encode(): r.n for r in counts.collect()}
    for name, (tokens, seen, base) in zip([*range(len(TEXTS)), None], brute_rows(texts, [k not in (8, 12) for k in range(13)])):
        row, text = rows[name], texts[12 if name is None else name]
        assert (row.n_tokens, row.n_known) == (tokens, seen)
        assert row.base_score == pytest.approx(base, rel=1e-12)
        assert row.score == pytest.approx(slow_score(model, known, text), rel=1e-4)
    assert rows[9].score == rows[11].score


def test_probabilities_add_up(spark, docs):
    counts = maxent_lm.count_words(docs).cache()
    model = maxent_lm.train(docs, counts)
    reader = maxent_lm._Reader(model)
    for past in ([0, 1, 2], [reader.rest, 0, 0], [len(model.words) + 2] * 3):
        numbers = np.arange(len(model.words) + 2)
        history = np.repeat(np.array(past)[:, None], len(numbers), axis=1)
        found = 10 ** maxent_lm.log_probabilities(model, reader, numbers, history)
        assert found.sum() == pytest.approx(1, abs=1e-4)


def test_nothing_learned(spark, docs):
    none = docs.where("false")
    counts = maxent_lm.count_words(none).cache()
    model = maxent_lm.train(none, counts)
    rows = maxent_lm.score_documents(docs, model, counts).collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(0, abs=1e-6) for r in rows)
    assert maxent_lm.score_documents(none, model, counts).count() == 0


def test_classes_divide_words_by_letters():
    words = [b"tion%d" % k for k in range(40)] + [b"zzz%d" % k for k in range(40)]
    found = maxent_lm.word_classes(words, np.ones(80, dtype=np.int64), 2)
    assert len(set(found[:40].tolist())) == 1 and len(set(found[40:].tolist())) == 1 and found[0] != found[40]
    assert maxent_lm.word_classes([b"a"], np.array([5]), 30).tolist() == [0]


def _batch(seed, n=8_192):
    """Rows, targets and a table as in one batch of steps: some rows are frequent, most are rare."""
    dice = np.random.default_rng(seed)
    rows = (dice.zipf(1.3, (n, 4)) * np.array([1, 7, 13, 29]) % (maxent_lm.CLASS_ROWS - 1) + 1).astype(np.uint16)
    rows[:, 3] = dice.integers(1, maxent_lm.CLASS_ROWS, n)
    table = dice.normal(size=(maxent_lm.CLASS_ROWS, maxent_lm.CLASSES)).astype(np.float32)
    return table, rows, dice.integers(0, maxent_lm.CLASSES, n)


def test_steps_cost_little_more_than_scores():
    table, rows, targets = _batch(1)
    steps = maxent_lm._Steps(table, 0.01)

    def best(work):
        spent = []
        for _ in range(25):
            before = time.process_time()
            work()
            spent.append(time.process_time() - before)
        return min(spent)

    # About 21 times before slopes were added piece by piece, 7 times since.
    assert best(lambda: steps.learn(None, rows, targets)) < 12 * best(lambda: maxent_lm._scores(table, None, rows))


def test_steps_by_definition():
    table, rows, targets = _batch(2, 700)
    table[5] += 300  # beyond what float32 holds as an exponential
    rows[:3, 0] = 5
    rows[3:90, 1] = 7  # one row in many tokens
    steps = maxent_lm._Steps(table, 0.3)
    steps.learn(None, rows, targets)
    scores = table[rows].astype(float).sum(axis=1) + table[0]
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    shares[np.arange(len(targets)), targets] -= 1
    slopes = np.zeros(table.shape)
    np.add.at(slopes, rows.ravel(), np.repeat(shares, 4, axis=0))
    slopes[0] += shares.sum(axis=0)
    rates = 0.3 / np.sqrt(1e-2 + (slopes**2).sum(axis=1) / maxent_lm.CLASSES)
    assert np.abs(steps.table - (table - rates[:, None] * slopes)).max() < 1e-3
    assert steps.updates.tolist() == [700, *np.bincount(rows.ravel(), minlength=len(table))[1:].tolist()]


def test_maxent_query(spark, sf_dir):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held_out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in documents}
    rows = {r.doc_id: r for r in catalogue.QUERIES["op11_maxent"](spark, sf_dir).collect()}
    assert rows.keys() == documents.keys()
    expected = dict(zip(documents, brute_rows(documents.values(), [not held_out[k] for k in documents])))
    train_tokens = sum(expected[k][0] for k in documents if not held_out[k])
    for name, (tokens, known, base) in expected.items():
        row = rows[name]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held_out[name], tokens, known, train_tokens)
        assert row.base_score == pytest.approx(base, rel=1e-9)
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
