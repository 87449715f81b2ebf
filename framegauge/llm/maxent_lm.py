"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a word is that of its class times that of the word within its class,
each a softmax over few choices.  The scores of the choices are sums of weight rows that
the history picks: the word before, the words two and three before (skips), the pair of the
last two, and a constant.  Rows are found by hashing, so the tables have a fixed size.

The vocabulary is the most frequent words, at most ``VOCABULARY``, found by a threshold on
their counts; all other words are the class *rest*.  Classes come from the letters of the
words, which divide languages and word forms: the heaviest class is split at the weighted
median of the main direction of its letter pairs.  The most frequent words of a class have
slots of their own, its others share one and divide it by their counts.  Words of the rest
divide theirs by counts plus one, a word never seen among them.

Counts cover all training texts.  Training passes over all of them too: each task walks
through about ``TASK_TOKENS`` tokens in small batches of gradient steps from the common
weights, and gives the changes of its rows with the number of their updates.  Their
weighted means are the next common weights.  The work, and what is shuffled, grows with the
texts; what the driver holds does not.

Texts are scored in batches of sparse rows.  The tokens are words, with A to Z in lower
case, then one end of text.  Null text is empty.  Without training tokens every word is of
the rest and has probability one.  Repeated rows are scored alike, an empty table gives no
row, and other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.llm.workers import slices, worker_state
from framegauge.storage import pinned

VOCABULARY = 65_536
LEAST_COUNT = 3  # of a word of the vocabulary; rarer ones teach what unknown words are like
CLASSES = 32  # the last two are the end of a text and the rest
SLOTS = 32  # the last one is for the other words of a class
CLASS_ROWS = 1 << 14
WORD_ROWS = 1 << 15
TASK_TOKENS = 4_000_000
ROUNDS = 2
BATCH_TOKENS = 8_192
RATE = 0.3
COUNTED_WORDS = 300_000  # distinct words that a task counts before it passes them on

END = b""  # no word is empty
_LETTER_PAIRS = 128
_BLOCK = 256  # rows of a table that travel together
_HISTORY = 3
_PIECE = 16  # slopes of a row that are added side by side with those of other rows
_LARGEST, _LEAST = 80.0, 1e-30  # of a score and of a sum of exponentials, well within float32


class Model(NamedTuple):
    words: tuple[bytes, ...]
    counts: np.ndarray  # of the words in training
    classes: np.ndarray  # of the words
    slots: np.ndarray
    tails: np.ndarray  # log10 of each word's share of its slot
    class_table: np.ndarray
    word_table: np.ndarray
    texts: int
    tokens: int  # N
    distinct: int  # V
    rest_tokens: int
    rest_distinct: int


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A to Z in lower case."""
    return (text or "").encode().lower().split()


# --- counts and vocabulary ---------------------------------------------------


def count_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``word``, ``n`` over all texts; the end of a text is the empty word."""
    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(_count_batches, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        batch = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
        counts[END] += batch.num_rows
        if len(counts) > COUNTED_WORDS:
            yield flush()
    yield flush()


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the least threshold that leaves at most ``most``, the most frequent first."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")  # a few hundred steps at any size
    eligible = counts.where((F.col("n") >= LEAST_COUNT) & (F.col("word") != ""))
    sizes = eligible.groupBy(step).agg(F.count(F.lit(1)).alias("words")).collect()
    held, least = 0, None
    for at, words in sorted(((r.step, r.words) for r in sizes), reverse=True):
        held += words
        if held > most:
            break
        least = at
    if least is None:
        return []
    chosen = eligible.where(step >= least).collect()  # at most ``most`` rows
    return sorted(((r.word.encode(), r.n) for r in chosen), key=lambda pair: (-pair[1], pair[0]))


def _letters(words: list[bytes]) -> np.ndarray:
    """Hashed counts of neighbouring letters, one row per word."""
    table = np.zeros((len(words), _LETTER_PAIRS), dtype=np.float32)
    for row, word in enumerate(words):
        padded = b"^" + word + b"$"
        for a, b in zip(padded, padded[1:]):
            table[row, (a * 37 + b * 101) % _LETTER_PAIRS] += 1
        table[row] /= len(padded)
    return table


def word_classes(words: list[bytes], counts: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word, 0 to ``classes`` - 1, by splits of the heaviest class."""
    table = _letters(words)
    found = np.zeros(len(words), dtype=np.int64)
    mass = {0: float(counts.sum())}
    for new in range(1, classes):
        while mass:
            heaviest = max(mass, key=lambda k: (mass[k], -k))
            members = np.flatnonzero(found == heaviest)
            upper = _upper_half(table[members], counts[members])
            if upper is not None:
                break
            del mass[heaviest]  # one word or words of the same letters: stays whole
        else:
            break
        found[members[upper]] = new
        mass[new] = float(counts[members[upper]].sum())
        mass[heaviest] -= mass[new]
    return found


def _upper_half(table: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """The rows beyond the weighted median along the main direction, None if all are alike."""
    if len(table) < 2:
        return None
    weights = np.sqrt(counts)[:, None].astype(np.float32)
    centred = table - (table * weights).sum(axis=0) / weights.sum()
    spread = centred.T @ (centred * weights)
    direction = np.linspace(1, 2, len(spread))
    for _ in range(30):
        direction = spread @ direction
        size = np.linalg.norm(direction)
        if size == 0:
            return None
        direction /= size
    along = centred @ direction.astype(np.float32)
    order = np.argsort(along, kind="stable")
    heap = np.cumsum(counts[order])
    cut = along[order[min(int(np.searchsorted(heap, heap[-1] / 2)), len(order) - 1)]]
    upper = along > cut
    if not upper.any():
        upper = along >= cut
    return upper if upper.any() and not upper.all() else None


# --- features and steps ------------------------------------------------------


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    code = np.full(len(parts[0]), kind + 1, dtype=np.uint64)
    for part in parts:
        code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return code


def class_rows(history: np.ndarray) -> np.ndarray:
    """Rows of the class table for each token; ``history`` has the last three words, nearest first."""
    near, next_near, third = history
    rows = [_mixed(0, near), _mixed(1, next_near), _mixed(2, third), _mixed(3, near, next_near)]
    picked = np.stack([r % np.uint64(CLASS_ROWS - 1) + np.uint64(1) for r in rows], axis=1)
    return picked.astype(np.uint16)  # row 0 is the constant


def word_rows(history: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the word table for each token of known class."""
    near, next_near, _ = history
    rows = [_mixed(4, classes, near), _mixed(5, classes, next_near)]
    picked = np.stack([r % np.uint64(WORD_ROWS - CLASSES) + np.uint64(CLASSES) for r in rows], axis=1)
    return picked.astype(np.uint16)  # the first rows are the constants of the classes


def _exponentials(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of the scores less a shift by row, their sums and the shifts.

    The shift, a row's greatest score, is taken only if some number would leave the range without.
    """
    if scores.max(initial=0) < _LARGEST:
        exponentials = np.exp(scores)
        sums = np.einsum("ij->i", exponentials)
        if sums.min(initial=1) > _LEAST:
            return exponentials, sums, np.zeros(len(scores), dtype=np.float32)
    shifts = scores.max(axis=1)
    exponentials = np.exp(scores - shifts[:, None])
    return exponentials, np.einsum("ij->i", exponentials), shifts


def _log_shares(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural logarithms of the softmax of each row at one choice."""
    _, sums, shifts = _exponentials(scores)
    return scores[np.arange(len(chosen)), chosen] - shifts - np.log(sums, dtype=np.float64)


def _stretch_sums(values: np.ndarray, owners: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[owners]`` over the stretches that begin at ``firsts``.

    Stretches are cut into pieces, the longest pieces first, and the n-th rows of all pieces that
    have one are added at once; only long stretches have pieces to be added one by one.
    """
    sizes = np.diff(firsts, append=len(owners))
    pieces = -(-sizes // _PIECE)
    heads = np.cumsum(pieces) - pieces
    skipped = (np.arange(int(pieces.sum())) - np.repeat(heads, pieces)) * _PIECE
    lengths = np.minimum(np.repeat(sizes, pieces) - skipped, _PIECE).astype(np.int8)
    by_length = np.argsort(-lengths, kind="stable")
    starts = (np.repeat(firsts, pieces) + skipped)[by_length]
    longer = np.cumsum(np.bincount(lengths, minlength=_PIECE + 1)[::-1])[::-1]  # pieces of n rows at least
    sums = values.take(owners.take(starts), axis=0)
    for n in range(1, _PIECE):
        count = int(longer[n + 1])
        if not count:
            break
        sums[:count] += values.take(owners.take(starts[:count] + n), axis=0)
    place = np.empty_like(by_length)
    place[by_length] = np.arange(len(by_length))
    total = sums.take(place[heads], axis=0)
    long = pieces > 1
    if long.any():
        of_long = np.flatnonzero(np.repeat(long, pieces))
        found = np.cumsum(pieces[long]) - pieces[long]
        total[long] = np.add.reduceat(sums.take(place[of_long], axis=0), found, axis=0)
    return total


def _scores(table: np.ndarray, constants: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Sums of each token's rows and its constant, which is row 0 where no others are given."""
    total = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        total += table.take(rows[:, k], axis=0)
    total += table[0] if constants is None else table.take(constants, axis=0)
    return total


class _Steps:
    """Gradient steps on one table, with rates that fall by row."""

    def __init__(self, table: np.ndarray, rate: float) -> None:
        self.start, self.table, self._rate = table, table.copy(), rate
        self._seen = np.full(len(table), 1e-2, dtype=np.float32)
        self.updates = np.zeros(len(table), dtype=np.float32)

    def learn(self, constants: np.ndarray | None, rows: np.ndarray, targets: np.ndarray) -> None:
        slope, sums, _ = _exponentials(_scores(self.table, constants, rows))
        slope /= sums[:, None]
        slope[np.arange(len(targets)), targets] -= 1
        if constants is None:
            self._move(np.zeros(1, dtype=np.int64), slope.sum(axis=0, keepdims=True), len(targets))
        else:
            rows = np.concatenate([constants[:, None].astype(np.uint16), rows], axis=1)
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        firsts = np.flatnonzero(np.diff(ranked, prepend=ranked[0] + np.uint16(1)))
        slopes = _stretch_sums(slope, order // rows.shape[1], firsts)
        self._move(ranked[firsts].astype(np.int64), slopes, np.diff(firsts, append=len(ranked)))

    def _move(self, at: np.ndarray, slopes: np.ndarray, updates: np.ndarray | int) -> None:
        seen = self._seen[at] + np.einsum("ij,ij->i", slopes, slopes) / slopes.shape[1]
        self._seen[at] = seen
        self.table[at] -= (self._rate / np.sqrt(seen))[:, None] * slopes
        self.updates[at] += updates

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of (updates, updates x change) of the rows."""
        change = (self.table - self.start) * self.updates[:, None]
        joined = np.concatenate([self.updates[:, None], change], axis=1).astype(np.float32)
        for block in range(0, len(joined), _BLOCK):
            yield block // _BLOCK, joined[block : block + _BLOCK].tobytes()


class _Reader:
    """Texts to word numbers and histories."""

    def __init__(self, model: Model) -> None:
        self._numbers = {word: k for k, word in enumerate(model.words)}
        self.rest, self._before = len(model.words) + 1, len(model.words) + 2
        # Without training texts the end of a text is as unknown as any word.
        self._numbers[END] = len(model.words) if model.texts else self.rest
        self.classes = np.concatenate([model.classes, [CLASSES - 2, CLASSES - 1]])
        self.slots = np.concatenate([model.slots, [0, 0]])
        self.tails = np.concatenate([model.tails, [0.0, 0.0]])

    def numbers(self, words: list[bytes]) -> list[int]:
        """The number of each word and of the end after them."""
        return [*map(self._numbers.get, words, repeat(self.rest)), self._numbers[END]]

    def tokens(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the numbered texts, and the three before each."""
        before = [self._before] * _HISTORY
        sizes = np.array([len(numbers) for numbers in texts], dtype=np.int64)
        parts = (part for numbers in texts for part in (before, numbers))
        joined = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()) + _HISTORY * len(texts))
        is_token = np.ones(len(joined), dtype=bool)
        heads = np.cumsum(sizes + _HISTORY) - (sizes + _HISTORY)
        for k in range(_HISTORY):
            is_token[heads + k] = False
        at = np.flatnonzero(is_token)
        return joined[at], np.stack([joined[at - k] for k in range(1, _HISTORY + 1)])


def log_probabilities(
    model: Model, reader: _Reader, numbers: np.ndarray, history: np.ndarray
) -> np.ndarray:
    """log10 of the probability of each token; for a word of the rest, of the class alone."""
    found = reader.tails[numbers].copy()
    for at in range(0, len(numbers), BATCH_TOKENS):
        part = slice(at, at + BATCH_TOKENS)
        own, past = numbers[part], history[:, part]
        classes = reader.classes[own]
        found[part] += _log_shares(_scores(model.class_table, None, class_rows(past)), classes) / math.log(10)
        inner = np.flatnonzero(classes < CLASSES - 2)
        within = _scores(model.word_table, classes[inner], word_rows(past[:, inner], classes[inner]))
        found[at + inner] += _log_shares(within, reader.slots[own[inner]]) / math.log(10)
    return found


# --- training ----------------------------------------------------------------


def _share_by_counts(
    words: list[bytes], counts: np.ndarray, classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, tails and the logarithms of the slots' shares by class; words come most frequent first."""
    slots, tails = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
    constants = np.full((CLASSES, SLOTS), -30.0)
    for k in range(CLASSES - 2):
        members = np.flatnonzero(classes == k)
        slots[members] = np.minimum(np.arange(len(members)), SLOTS - 1)
        others = members[SLOTS - 1 :]
        if len(others):
            tails[others] = np.log10(counts[others] / counts[others].sum())
        shares = np.bincount(slots[members], weights=counts[members], minlength=SLOTS)
        constants[k, shares > 0] = np.log(shares[shares > 0] / shares.sum())
    return slots, tails, constants


def start_model(counts: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """The model of the counts alone: every history gives the shares of the training texts."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    texts = counts.where("word = ''").agg(F.sum("n").alias("n")).first().n or 0
    frequent = _frequent(counts, vocabulary)
    words = [word for word, _ in frequent]
    known = np.array([n for _, n in frequent], dtype=np.int64)
    tokens, distinct = total.n or 0, total.words
    rest_tokens = tokens - texts - int(known.sum())
    rest_distinct = distinct - len(words) - (texts > 0)
    classes = word_classes(words, known, CLASSES - 2) if words else np.zeros(0, dtype=np.int64)
    slots, tails, constants = _share_by_counts(words, known, classes)
    class_table = np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32)
    # The rest keeps a count of its own for a word never seen.
    mass = np.bincount(classes, weights=known, minlength=CLASSES).astype(np.float64)
    mass[CLASSES - 2], mass[CLASSES - 1] = texts, rest_tokens + 1
    class_table[0] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -30.0)
    word_table = np.zeros((WORD_ROWS, SLOTS), dtype=np.float32)
    word_table[:CLASSES] = constants
    return Model(
        tuple(words), known, classes, slots, tails, class_table, word_table,
        texts, tokens, distinct, rest_tokens, rest_distinct,
    )


def train(
    docs: DataFrame, counts: DataFrame, text_column: str = "text", vocabulary: int = VOCABULARY, rounds: int = ROUNDS
) -> Model:
    """Learn the weights from all texts, one part of them a round; ``counts`` are of the same texts."""
    rows = docs.select(F.col(text_column).alias("text"))
    model = start_model(counts, vocabulary)
    if not model.words:
        return model
    tasks = max(1, round(model.tokens / TASK_TOKENS))
    for turn in range(rounds):
        part = F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn
        learn = partial(_learn_batches, model=model, rate=RATE / (1 + turn))
        changes = rows.where(part).coalesce(tasks).mapInArrow(learn, "kind int, block int, content binary")
        summed = changes.groupBy("kind", "block").applyInArrow(_sum_blocks, "kind int, block int, content binary")
        tables = [model.class_table.copy(), model.word_table.copy()]
        for row in summed.collect():  # the fixed number of blocks of two tables
            table = tables[row.kind]
            joined = np.frombuffer(row.content, dtype=np.float32).reshape(-1, table.shape[1] + 1)
            own = table[row.block * _BLOCK : row.block * _BLOCK + len(joined)]
            own += joined[:, 1:] / np.maximum(joined[:, :1], 1)
        model = model._replace(class_table=tables[0], word_table=tables[1])
    return model


def _learn_batches(batches: Iterator[pa.RecordBatch], model: Model, rate: float) -> Iterator[pa.RecordBatch]:
    reader = _Reader(model)
    steps = [_Steps(model.class_table, rate), _Steps(model.word_table, rate)]
    pending: list[list[int]] = []
    held = 0

    def learn() -> None:
        nonlocal held
        numbers, history = reader.tokens(pending)
        pending.clear()
        held = 0
        for at in range(0, len(numbers), BATCH_TOKENS):
            own, past = numbers[at : at + BATCH_TOKENS], history[:, at : at + BATCH_TOKENS]
            classes = reader.classes[own]
            steps[0].learn(None, class_rows(past), classes)
            inner = np.flatnonzero(classes < CLASSES - 2)
            if len(inner):
                known = classes[inner]
                steps[1].learn(known, word_rows(past[:, inner], known), reader.slots[own[inner]])

    some = False
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            some = True
            pending.append(reader.numbers(words_of(text)))
            held += len(pending[-1])
            if held >= BATCH_TOKENS:
                learn()
    if held:
        learn()
    if some:
        for kind, step in enumerate(steps):
            blocks = list(step.changes())
            arrays = [
                pa.array([kind] * len(blocks), pa.int32()),
                pa.array([block for block, _ in blocks], pa.int32()),
                pa.array([content for _, content in blocks], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "block", "content"])


def _sum_blocks(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for content in batch.column("content"):
            part = np.frombuffer(content.as_py(), dtype=np.float32)
            total = part.astype(np.float64) if total is None else total + part
    arrays = [pa.array([key.as_py()], pa.int32()) for key in keys]
    content = pa.array([total.astype(np.float32).tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([*arrays, content], ["kind", "block", "content"])


# --- scoring -----------------------------------------------------------------


def score_documents(
    docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every document.

    ``n_known`` tokens occur in ``counts``, those that the model was trained on.  ``base_score``
    is the log10 probability by counts plus one, ``score`` that of the model.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:long>>"
    scored = pinned(rows.mapInArrow(partial(_score_batches, model=model), schema))
    # Numbered after it is written, so that a row keeps its number.
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode("rare").alias("token")).select("row", "token.word", "token.n")
    known = counts.select("word", F.col("n").alias("c"))
    seen = F.coalesce("c", F.lit(0))

    def share(whole: int) -> Column:
        return F.sum(F.col("n") * F.log10((seen + 1) / F.lit(float(whole))))

    parts = (
        rare.join(known, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more_known"),
            share(model.tokens + model.distinct + 1).alias("more_base"),
            share(model.rest_tokens + model.rest_distinct + 1).alias("more"),
        )
    )
    return scored.join(parts, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_tokens", "n_known", "base", "score", "rare"]
    tokens = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    key = ("maxent", model.tokens, hash(model.class_table.tobytes()), hash(model.words))
    reader = worker_state(key, partial(_Reader, model))
    logs = np.log10((np.concatenate([model.counts, [model.texts, 0]]) + 1) / (model.tokens + model.distinct + 1))
    logs[reader.rest] = 0  # the join with the counts adds these; an end without training has log 0
    for batch in slices(batches, 100):
        texts = [words_of(text) for text in batch.column(1).to_pylist()]
        numbered = [reader.numbers(words) for words in texts]
        found, history = reader.tokens(numbered)
        owner = np.repeat(np.arange(len(numbered)), [len(numbers) for numbers in numbered])
        listed = found != reader.rest
        rare = _unlisted(texts, listed, owner, tokens)
        scores = log_probabilities(model, reader, found, history)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=len(numbered))

        arrays = [
            batch.column(0),
            pa.array(summed(np.ones(len(found))).astype(np.int64)),
            pa.array(summed(listed).astype(np.int64)),
            pa.array(summed(logs[found])),
            pa.array(summed(scores)),
            rare,
        ]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _unlisted(texts: list[list[bytes]], listed: np.ndarray, owner: np.ndarray, kind: pa.ListType) -> pa.ListArray:
    """The counts of the words of each text that are not listed; ``listed`` and ``owner`` go by token."""
    tokens = [token for words in texts for token in (*words, END)]
    places = np.flatnonzero(~listed)
    ends = np.searchsorted(owner[places], np.arange(len(texts)), side="right").tolist()
    words, counts, offsets, at = [], [], [0], 0
    places = places.tolist()
    for end in ends:
        counted = Counter(map(tokens.__getitem__, places[at:end]))
        counted.pop(END, None)  # the end of a text is no word
        words += counted
        counts += counted.values()
        offsets.append(len(words))
        at = end
    arrays = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
    members = pa.StructArray.from_arrays(arrays, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)
