"""Quality rules: word statistics and the fertility of a public tokeniser.

Fertility is what a tokeniser makes of a text: characters per token, the share of
tokens that are single fallback bytes, and the entropy of the tokens relative to the
most that a text of its length can have.  Prose of a script lies in a narrow band;
tables of codes, foreign encodings and endless repetition lie outside.

The bands belong to a language, where a column names it, and else to a script.  They run
around the median, ``REACH`` times as far as the middle half reaches, and are computed
over all documents that pass the rules on words.  The band of a language with few documents
is drawn towards that of its script, and this towards one over all documents, by shares
that grow with the counts; the band is wider for short texts, whose measures are noisy.
So nothing switches at a size.  A document is rejected if a rule on words fails or if a
measure leaves its band.

A null or empty text has no word and fails the rule on word counts.  Repeated rows
are judged alike; an empty table gives no row; other columns are ignored or passed
through.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from framegauge.llm.chunks import ChunkEncoder
from framegauge.llm.workers import slices, worker_state
from framegauge.storage import pinned

LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words in repeated windows
WINDOW = 5
REACH = 3.0
FEW_TOKENS = 50  # at so many tokens a range is twice as wide as at very many
SENT_BANDS = 10_000  # rows of some 100 bytes that may be sent to all tasks
EQUAL_SHARES = 50  # with so many documents a language counts as much as its script

MEASURES = ("chars_per_token", "byte_share", "entropy")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"

# First code points of scripts, in order; "" is for characters that
# belong to none.
SCRIPTS = (
    (0x00, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"),
    (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x700, ""), (0x900, "indic"), (0xE00, "thai"), (0xE80, ""),
    (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
)
_FIRSTS = np.array([first for first, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS} - {""})
_CODES = np.array([_NAMES.index(name) if name else len(_NAMES) for _, name in SCRIPTS])


def script_of(text: str) -> str:
    """The script of most letters; ``none`` without any. Ties go to the first by name."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _CODES[np.searchsorted(_FIRSTS, points, side="right") - 1]
    counts = np.bincount(codes, minlength=len(_NAMES) + 1)[: len(_NAMES)]
    return _NAMES[int(counts.argmax())] if counts.any() else "none"


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    count = len(words)
    if count <= window:
        return 0
    numbers: dict[bytes, int] = {}
    if len(set(words)) == count:
        return 0
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    windows = count - window + 1
    codes = ids[:windows]
    for k in range(1, window):
        codes = codes * len(numbers) + ids[k : k + windows]
        if len(numbers) ** (k + 2) >= 1 << 62 and k + 1 < window:
            codes = np.unique(codes, return_inverse=True)[1]
    _, place, sizes = np.unique(codes, return_inverse=True, return_counts=True)
    repeated = np.concatenate(([0], np.cumsum(sizes[place] > 1)))
    at = np.arange(count)
    first, last = np.maximum(at - window + 1, 0), np.minimum(at, windows - 1)
    return int((repeated[last + 1] > repeated[first]).sum())


def word_statistics(text: str, words: list[bytes]) -> tuple[int, ...]:
    """The values of ``_COUNTS``."""
    lines = [line for line in text.split("\n") if line.strip(_SPACES)] if "\n" in text else ()
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def _encoder(model_path: str) -> tuple[ChunkEncoder, np.ndarray]:
    """Ids by word, and which ids are fallback bytes."""
    return worker_state(("fertility", model_path), lambda: _new_encoder(model_path))


def _new_encoder(model_path: str) -> tuple[ChunkEncoder, np.ndarray]:
    import sentencepiece

    with open(model_path, "rb") as model:
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model.read())
    is_byte = np.array([pieces.is_byte(k) for k in range(pieces.get_piece_size())])

    def encode(word: bytes) -> bytes:
        return array("I", pieces.encode(word.decode())).tobytes()

    return ChunkEncoder(encode, _words), is_byte


def _words(text: str) -> list[bytes]:
    """The words, which ASCII white space divides."""
    return text.encode().split()


def measures(ids: np.ndarray, word_chars: int, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """Number of tokens, then the values of ``MEASURES``."""
    count = len(ids)
    if not count:
        return 0, 0.0, 0.0, 0.0
    sizes = np.unique(ids, return_counts=True)[1] / count
    most = math.log(min(count, len(is_byte))) or 1.0
    entropy = float(-(sizes * np.log(sizes)).sum()) / most
    return count, word_chars / count, float(is_byte[ids].mean()), entropy


_ROW = (
    "band string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def _rows(texts: list[str | None], languages: list[str | None], model_path: str) -> list[tuple]:
    encoder, is_byte = _encoder(model_path)
    rows = []
    for text, language in zip(texts, languages):
        text = text or ""
        counts = word_statistics(text, _words(text))
        ids = np.frombuffer(encoder.packed(text), dtype="<u4")
        script = script_of(text)
        rows.append((language or script, script, *counts, *measures(ids, counts[1], is_byte)))
    return rows


def document_measures(
    docs: DataFrame,
    model_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str | None = "lang",
) -> DataFrame:
    """``id``, ``band`` (language or script), ``script``, word statistics and fertility of every document."""
    language = F.col(language_column) if language_column else F.lit(None)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        language.cast("string").alias("language"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_measure_batches, model_path=model_path), f"id {kind}, {_ROW}")


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return [pa.array(column, kind) for column, kind in zip(columns, kinds)]


def _measure_batches(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    names = ["id", "band", "script", *_COUNTS, "n_tokens", *MEASURES]
    for batch in slices(batches):
        arrays = _arrays(_rows(batch.column(1).to_pylist(), batch.column(2).to_pylist(), model_path))
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)


def rejection_bands(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """``band``, ``script`` and the middle and width of each measure's range there.

    One row for each pair of language and script.  A language's own figures count by its
    documents against those of its script, and these against those of all documents.
    """
    usable = measured.where(~base_failed())
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]

    def figures(level: str, keys: list[str]) -> DataFrame:
        found = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{level}_n"), *quartiles)
        columns = [F.col(f"{level}_n")]
        for m in MEASURES:
            low, middle, high = (F.element_at(m, k) for k in (1, 2, 3))
            width = reach * F.greatest(high - low, 0.01 * F.abs(middle), F.lit(0.005))
            columns += [middle.alias(f"{level}_{m}_middle"), width.alias(f"{level}_{m}_width")]
        return found.select(*keys, *columns)

    pairs = measured.groupBy("band", "script").count().drop("count")
    joined = (
        pairs.join(figures("band", ["band"]), "band", "left")
        .join(figures("script", ["script"]), "script", "left")
        .join(figures("all", []), how="left")
    )
    columns = []
    for m in MEASURES:
        for part in ("middle", "width"):
            value = F.col(f"all_{m}_{part}")
            for level in ("script", "band"):
                share = F.col(f"{level}_n") / (F.col(f"{level}_n") + EQUAL_SHARES)
                own = F.col(f"{level}_{m}_{part}")
                value = F.when(own.isNull(), value).otherwise(share * own + (1 - share) * value)
            columns.append(value.alias(f"{m}_{part}"))
    return joined.select("band", "script", *columns)


def base_failed() -> Column:
    """The rules on words, as a condition on measured rows."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """``rows`` and the bands of their language and script."""
    bands = pinned(bands)
    if bands.count() <= SENT_BANDS:
        return rows.join(F.broadcast(bands), ["band", "script"], "left")
    return rows.join(bands, ["band", "script"], "left")  # adaptive execution deals hot languages out


def _within_bands() -> Column:
    """Whether no measure leaves its band.

    Measures of few tokens are noisy, so the width grows as tokens become few.
    """
    noise = 1 + F.lit(FEW_TOKENS) / F.greatest(F.col("n_tokens"), F.lit(1))
    kept = F.lit(True)
    for m in MEASURES:
        distance = F.abs(F.col(m) - F.col(f"{m}_middle"))
        kept = kept & (distance <= noise * F.col(f"{m}_width"))
    return F.coalesce(kept, F.lit(True))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    measured = pinned(measured)
    joined = _with_bands(measured, rejection_bands(measured))
    failed = base_failed()
    kept = ~failed & _within_bands()
    names = [name for name in measured.columns if name != "script"]
    return joined.select(*names, failed.alias("base_failed"), kept.alias("kept"))


def keep_good(
    docs: DataFrame, model_path: str, text_column: str = "text", language_column: str | None = "lang"
) -> DataFrame:
    """The documents, with all their columns, that pass the rules.

    The bands need a pass over all documents before the pass that filters.
    """
    own = [field.split()[0] for field in _ROW.split(", ")]
    names = [f"c{k}" for k in range(len(docs.columns))]  # no column of the rows can clash
    text = docs.columns.index(text_column)
    language = docs.columns.index(language_column) if language_column else -1
    fields = [StructField(name, field.dataType) for name, field in zip(names, docs.schema.fields)]
    schema = StructType([*fields, *StructType.fromDDL(_ROW).fields])
    measure = partial(_append_batches, model_path=model_path, text=text, language=language)
    measured = docs.toDF(*names).mapInArrow(measure, schema)
    bands = rejection_bands(pinned(measured.select(*own)))
    passed = _with_bands(measured, bands).where(~base_failed() & _within_bands())
    return passed.select(*[F.col(name).alias(own_name) for name, own_name in zip(names, docs.columns)])


def _append_batches(
    batches: Iterator[pa.RecordBatch], model_path: str, text: int, language: int
) -> Iterator[pa.RecordBatch]:
    own = [field.split()[0] for field in _ROW.split(", ")]
    for batch in slices(batches):
        languages = batch.column(language).cast(pa.string()).to_pylist() if language >= 0 else [None] * batch.num_rows
        arrays = _arrays(_rows(batch.column(text).to_pylist(), languages, model_path))
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *own])
