"""Language identification by nearest centroid over TF-IDF n-grams.

A text is the vector of its hashed letter n-grams, weighted by 1 + log of their count
and by their inverse document frequency, and scaled to length one.  Each language has
several centroids: spherical clusters of its documents, so that different kinds of
text do not blur into one mean.  The prediction is the language of the centroid with
the highest cosine.  Each centroid also has the cosine below which hardly any of
its own documents lie; a text under it is marked ``rejected``.

Languages, frequencies and centroids are learned from about ``max_per_language``
documents of each language.  Each language is one group of that bounded size.

A null text or one without a letter is ``und`` with score 0, and so is every text if
there is nothing to learn from.  Equal cosines go to the first language by name.
Repeated documents are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.storage import pinned

FEATURES = 4_096
LONGEST = 3  # letters of an n-gram, with a space at either end of a word
CLUSTERS = 3
ROUNDS = 12
MAX_PER_LANGUAGE = 1_000
UNKNOWN = "und"
MAX_WORDS = 300_000  # words whose n-grams a worker keeps

_GROUP = 256  # texts scored together


class Model(NamedTuple):
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected
    idf: np.ndarray


class _Grams(dict):
    """Packed features by word, found when first asked for."""

    def __missing__(self, word: str) -> bytes:
        self[word] = grams = _word_grams(word)
        return grams


_kept = _Grams()


def _word_grams(word: str) -> bytes:
    letters = "".join(c for c in word if c.isalpha())
    if not letters:
        return b""
    framed = f" {letters} "
    grams = [framed[k : k + n] for n in range(1, LONGEST + 1) for k in range(len(framed) - n + 1)]
    return np.array([crc32(g.encode()) % FEATURES for g in grams if g != " "], dtype=np.int32).tobytes()


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None where there is no letter."""
    packed = b"".join(map(_kept.__getitem__, (text or "").lower().split()))
    if len(_kept) > MAX_WORDS:
        _kept.clear()
    if not packed:
        return None
    return np.bincount(np.frombuffer(packed, dtype=np.int32), minlength=FEATURES)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    logs = np.log(np.maximum(counts, 1)) + 1
    rows = np.where(counts > 0, logs, 0.0) * idf
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return (rows / np.maximum(norms, 1e-12)).astype(np.float32)


# --- learning ----------------------------------------------------------------


def language_sample(
    docs: DataFrame,
    may_learn: Column,
    text_column: str = "text",
    language_column: str = "lang",
    max_per_language: int = MAX_PER_LANGUAGE,
) -> DataFrame:
    """``lang`` and packed n-gram counts of about ``max_per_language`` documents of each."""
    known = docs.where(may_learn & F.col(language_column).isNotNull() & F.col(text_column).isNotNull())
    rows = known.select(F.col(language_column).alias("lang"), F.col(text_column).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row.lang, F.lit(min(1.0, max_per_language / row.n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000
    return pinned(rows.where(drawn).mapInArrow(_count_batches, "lang string, counts binary"))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, packed = [], []
        for lang, text in zip(*[column.to_pylist() for column in batch.columns]):
            counts = gram_counts(text)
            if counts is not None:
                languages.append(lang)
                packed.append(np.minimum(counts, 65_535).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(packed, pa.binary())], ["lang", "counts"]
        )


def _table_counts(table: pa.Table) -> np.ndarray:
    packed = b"".join(sorted(table.column("counts").to_pylist()))  # the order of rows must not show
    return np.frombuffer(packed, "<u2").reshape(-1, FEATURES)


def _document_frequencies(table: pa.Table) -> pa.Table:
    counts = _table_counts(table)
    present = (counts > 0).sum(axis=0).astype("<i8")
    return pa.table({"n": pa.array([len(counts)], pa.int64()), "present": pa.array([present.tobytes()], pa.binary())})


def fit(sample: DataFrame, clusters: int = CLUSTERS) -> Model:
    rows = sample.groupBy("lang").applyInArrow(_frequency_function(), "n long, present binary").collect()
    documents = sum(r.n for r in rows)
    present = sum((np.frombuffer(r.present, "<i8") for r in rows), np.zeros(FEATURES, dtype=np.int64))
    idf = np.log((1 + documents) / (1 + present)) + 1
    found = sample.groupBy("lang").applyInArrow(
        _cluster_function(idf, clusters), "lang string, cluster int, centroid binary, least double"
    )
    centroids = sorted(found.collect(), key=lambda r: (r.lang, r.cluster))  # a few per language
    table = np.array([np.frombuffer(r.centroid, "<f4") for r in centroids]).reshape(-1, FEATURES)
    return Model(tuple(r.lang for r in centroids), table, np.array([r.least for r in centroids]), idf)


def _frequency_function() -> Callable[[pa.Table], pa.Table]:
    def frequencies(table: pa.Table) -> pa.Table:
        return _document_frequencies(table)

    return frequencies


def _cluster_function(idf: np.ndarray, clusters: int) -> Callable[[pa.Table], pa.Table]:
    def cluster(table: pa.Table) -> pa.Table:
        rows = _weighted(_table_counts(table), idf)
        centroids = spherical_clusters(rows, clusters)
        cosines = rows @ centroids.T
        own, nearest = cosines.max(axis=1), cosines.argmax(axis=1)
        least = [0.5 * float(np.quantile(own[nearest == k], 0.01)) for k in range(len(centroids))]
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(centroids), pa.string()),
                "cluster": pa.array(range(len(centroids)), pa.int32()),
                "centroid": pa.array([c.astype("<f4").tobytes() for c in centroids], pa.binary()),
                "least": pa.array(least, pa.float64()),
            }
        )

    return cluster


def spherical_clusters(rows: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids of length one: the mean direction, then the farthest rows, improved in rounds."""
    mean = rows.mean(axis=0)
    centroids = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    while len(centroids) < min(clusters, len(rows)):
        far = (rows @ np.array(centroids).T).max(axis=1).argmin()
        centroids.append(rows[far])
    table = np.array(centroids, dtype=np.float32)
    for _ in range(ROUNDS):
        nearest = (rows @ table.T).argmax(axis=1)
        sums = [rows[nearest == k].sum(axis=0) for k in range(len(table)) if (nearest == k).any()]
        better = np.array([s / max(float(np.linalg.norm(s)), 1e-12) for s in sums], dtype=np.float32)
        if better.shape == table.shape and np.allclose(better, table, atol=1e-6):
            break
        table = better
    used = np.unique((rows @ table.T).argmax(axis=1))
    return table[used]


# --- prediction --------------------------------------------------------------


def predict_languages(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (the cosine), ``rejected`` of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        partial(_predict_batches, model=model), f"id {kind}, lang_pred string, score double, rejected boolean"
    )


def predict_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, bool]]:
    found = [(UNKNOWN, 0.0, True)] * len(texts)
    if not model.languages:
        return found
    for at in range(0, len(texts), _GROUP):
        counts = [gram_counts(text) for text in texts[at : at + _GROUP]]
        places = [k for k, c in enumerate(counts) if c is not None]
        if not places:
            continue
        cosines = _weighted(np.array([counts[k] for k in places]), model.idf) @ model.centroids.T
        best = cosines.argmax(axis=1)
        for place, k, cosine in zip(places, best.tolist(), cosines[np.arange(len(best)), best].tolist()):
            score = min(1.0, max(0.0, cosine))
            found[at + place] = model.languages[k], score, cosine < model.least[k]
    return found


def _predict_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = predict_texts(batch.column(1).to_pylist(), model)
        languages, scores, rejected = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(languages, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array([bool(r) for r in rejected], pa.bool_()),
            ],
            ["id", "lang_pred", "score", "rejected"],
        )
