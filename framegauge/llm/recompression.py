"""Periodic runs of words by recompression and grammar LCE queries.

A batch of documents is one sequence of word numbers, with a separator of its own after
each document.  Recompression alternates two steps.  *Block compression* names each
maximal repetition of one symbol by (symbol, length).  *Pair compression* deals the
symbols to a left and a right side and names each left-right pair.  Equal stretches thus
get equal names but near their ends, and every document shrinks to a few symbols in a
number of rounds that grows with the logarithm of its length.

The longest common extension of two places climbs this run-length grammar while both
places are borders of its symbols, and descends again around the first difference.  All
queries of a batch climb and descend together, forwards and backwards.

A run of period q and at least 3 q + 1 words covers four neighbouring points of the grid
of multiples of q.  So each q gives its grid points as candidates, n / q of them, where
four such words are equal; two LCE queries then give the exact extent.  Of all candidates
with one extent the smallest period is the run's.

Null text has no word and no run.  Repeated rows give repeated results, an empty table
gives none, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.llm.workers import slices

MIN_EXPONENT = 4
MIN_LENGTH = 6
BATCH_WORDS = 250_000  # words of a batch of documents; a longer document is a batch of its own
QUERIES = 200_000  # candidates whose extent is asked for at once
TOP_SYMBOLS = 4  # documents are compressed to so many symbols at most
TOO_SHORT = 4  # fewer words have no run

Run = tuple[int, int, int]  # start, length, period


class _Level:
    """One sequence of the grammar and how the next one groups it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.above: np.ndarray | None = None  # the group of each symbol, and one past the last
        self.firsts: np.ndarray | None = None  # the first symbol of each group, and one past the last
        self.block_first: np.ndarray | None = None  # first of the repetition around each symbol
        self.block_last: np.ndarray | None = None  # one past its last

    def group(self, is_first: np.ndarray) -> np.ndarray:
        """Set the grouping; returns the first symbol of each group."""
        firsts = np.flatnonzero(is_first).astype(np.int32)
        count = len(self.symbols)
        self.above = np.empty(count + 1, dtype=np.int32)
        np.cumsum(is_first, out=self.above[:count])
        self.above[:count] -= 1
        self.above[count] = len(firsts)
        self.firsts = np.append(firsts, np.int32(count))
        return firsts


class Grammar:
    """Levels of a recompressed sequence; ``separators`` are symbols that stay alone.

    ``symbols`` are numbers from 0; those from ``first_separator`` on are separators, each of
    which occurs once.
    """

    def __init__(self, symbols: np.ndarray, first_separator: int, top: int = TOP_SYMBOLS) -> None:
        self._levels = [_Level(np.asarray(symbols, dtype=np.int64))]
        alone = self._levels[0].symbols >= first_separator
        turn = 0
        while True:
            ends = np.flatnonzero(alone)
            stretches = np.diff(np.concatenate(([-1], ends, [len(alone)]))) - 1
            if stretches.max() <= top:
                break
            alone = self._compress_blocks(alone)
            alone = self._compress_pairs(alone, turn)
            turn += 1

    def _push(self, codes: np.ndarray) -> None:
        """Name the groups of the next level densely; equal names are equal stretches."""
        self._levels.append(_Level(np.unique(codes, return_inverse=True)[1].astype(np.int64)))

    def _compress_blocks(self, alone: np.ndarray) -> np.ndarray:
        level = self._levels[-1]
        symbols = level.symbols
        is_first = np.ones(len(symbols), dtype=bool)
        np.not_equal(symbols[1:], symbols[:-1], out=is_first[1:])
        firsts = level.group(is_first)
        lengths = np.diff(level.firsts)
        level.block_first = firsts[level.above[:-1]]
        level.block_last = level.firsts[level.above[:-1] + 1]
        self._push(symbols[firsts] * (int(lengths.max()) + 1) + lengths)
        return alone[firsts]

    def _compress_pairs(self, alone: np.ndarray, turn: int) -> np.ndarray:
        level = self._levels[-1]
        symbols = level.symbols
        mixed = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left = (mixed >> np.uint64(63)).astype(bool)
        paired = left[:-1] & ~left[1:] & ~alone[:-1] & ~alone[1:]
        is_first = np.ones(len(symbols), dtype=bool)
        is_first[1:] = ~paired
        firsts = level.group(is_first)
        # Neighbours differ after block compression, so each group is one symbol or a pair.
        second = np.zeros(len(firsts), dtype=np.int64)
        pair = np.diff(level.firsts) == 2
        second[pair] = symbols[firsts[pair] + 1] + 1
        self._push(symbols[firsts] * (int(symbols.max()) + 2) + second)
        return alone[firsts]

    def extend(self, a: np.ndarray, b: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many symbols agree from borders ``a`` and ``b`` on, or before them."""
        at, other = a.astype(np.int64), b.astype(np.int64)
        level_of = np.full(len(at), -1)
        climbing = np.arange(len(at))
        for depth, level in enumerate(self._levels):
            if not len(climbing) or level.above is None:
                level_of[climbing] = depth
                break
            # Step symbol by symbol until both are borders above or differ.
            moving = climbing
            while len(moving):
                p, q = at[moving], other[moving]
                low = ~((level.firsts[level.above[p]] == p) & (level.firsts[level.above[q]] == q))
                moving = moving[low]
                agree = self._step(level, at, other, moving, backwards)
                level_of[moving[~agree]] = depth
                moving = moving[agree]
            climbing = climbing[level_of[climbing] < 0]
            at[climbing], other[climbing] = level.above[at[climbing]], level.above[other[climbing]]
        # Descend: at each level go on while symbols agree.
        for depth in range(len(self._levels) - 1, -1, -1):
            level = self._levels[depth]
            here = np.flatnonzero(level_of >= depth)
            if depth + 1 < len(self._levels):
                come = here[level_of[here] > depth]
                at[come], other[come] = level.firsts[at[come]], level.firsts[other[come]]
            while len(here):
                here = here[self._step(level, at, other, here, backwards)]
        return a - at if backwards else at - a

    @staticmethod
    def _step(
        level: _Level, at: np.ndarray, other: np.ndarray, which: np.ndarray, backwards: bool
    ) -> np.ndarray:
        """Move the borders past equal symbols, whole repetitions at once; who could move."""
        p, q = at[which], other[which]
        count = len(level.symbols)
        if backwards:
            inside = (p > 0) & (q > 0)
            s, t = np.maximum(p - 1, 0), np.maximum(q - 1, 0)
        else:
            inside = (p < count) & (q < count)
            s, t = np.minimum(p, count - 1), np.minimum(q, count - 1)
        agree = inside & (level.symbols[s] == level.symbols[t])
        if level.block_first is None:
            length = np.ones(len(which), dtype=np.int64)
        elif backwards:
            length = np.minimum(p - level.block_first[s], q - level.block_first[t])
        else:
            length = np.minimum(level.block_last[s] - p, level.block_last[t] - q)
        step = np.where(agree, -length if backwards else length, 0)
        at[which], other[which] = p + step, q + step
        return agree


def _grid_candidates(symbols: np.ndarray, owner: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(period, grid places) where this and the next three grid words are equal."""
    for period in range(1, longest // MIN_EXPONENT + 1):
        grid = symbols[::period]
        same = grid[1:] == grid[:-1]
        if len(same) < 3:
            continue
        places = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(places):
            places = places * period
            places = places[owner[places] == owner[places + 3 * period]]
            if len(places):
                yield period, places


def runs_of(documents: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each document's word numbers, by start and then period.

    Equal numbers are equal words, in all documents of the list alike.
    """
    found: list[list[Run]] = [[] for _ in documents]
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    if not len(lengths) or lengths.max() < TOO_SHORT:
        return found
    words = np.concatenate(documents)
    separator = int(words.max()) + 1
    owner = np.repeat(np.arange(len(documents)), lengths + 1)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.empty(len(owner), dtype=np.int64)
    is_end = np.zeros(len(owner), dtype=bool)
    is_end[starts + lengths] = True
    symbols[~is_end] = words
    symbols[is_end] = separator + np.arange(len(documents))
    periods: dict[tuple[int, int], int] = {}
    grammar: Grammar | None = None
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def ask() -> None:
        nonlocal grammar, held
        if not waiting:
            return
        if grammar is None:
            grammar = Grammar(symbols, separator)
        period = np.concatenate([np.full(len(places), q, dtype=np.int64) for q, places in waiting])
        first = np.concatenate([places for _, places in waiting])
        after = first + period + grammar.extend(first, first + period)
        before = first - grammar.extend(first, first + period, backwards=True)
        size = after - before
        is_run = (size >= MIN_EXPONENT * period) & (size >= MIN_LENGTH)
        for start, length, q in zip(before[is_run].tolist(), size[is_run].tolist(), period[is_run].tolist()):
            known = periods.get((start, length))
            if known is None or q < known:
                periods[start, length] = q
        waiting.clear()
        held = 0

    for candidate in _grid_candidates(symbols, owner, int(lengths.max())):
        waiting.append(candidate)
        held += len(candidate[1])
        if held >= QUERIES:
            ask()
    ask()
    for (start, length), period in sorted(periods.items(), key=lambda item: (item[0][0], item[1])):
        document = int(owner[start])
        found[document].append((start - int(starts[document]), length, period))
    return found


def longest_run(runs: list[Run]) -> Run | None:
    """The longest; of equally long ones the first, then the one of the smallest period."""
    return min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _batches_of(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts in batches of bounded size."""
    batch: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = (text or "").encode().split()
        if batch and size + len(words) > BATCH_WORDS:
            yield batch
            batch, size = [], 0
        batch.append(words)
        size += len(words)
    if batch:
        yield batch


def _numbered(batch: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    for words in batch:
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
    return [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in batch]


_SCHEMA = (
    "runs array<struct<start:long,length:long,period:long>>, n_words long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def document_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False
) -> DataFrame:
    """``id``, all ``runs`` of every document's words, digests of them and of the text without repeats.

    ``runs_sha256`` is of lines ``start,length,period``; ``collapsed_sha256`` is of the words
    that no run repeats, joined by single spaces.  ``with_text`` adds this text as ``collapsed``.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_SCHEMA}" + ", collapsed string" * with_text
    return rows.mapInArrow(partial(_run_batches, with_text=with_text), schema)


def _run_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    struct = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    names = ["id", "runs", "n_words", "runs_sha256", "collapsed_sha256", "collapsed"]
    for whole in slices(batches):
        at = 0
        for batch in _batches_of(whole.column(1).to_pylist()):
            ids = whole.column(0).slice(at, len(batch))
            at += len(batch)
            rows: list[list] = [[], [], [], [], []]
            for words, runs in zip(batch, runs_of(_numbered(batch))):
                lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                collapsed = b" ".join(without_repeats(words, runs))
                values = (
                    [dict(zip(("start", "length", "period"), run)) for run in runs],
                    len(words),
                    hashlib.sha256(lines.encode()).hexdigest(),
                    hashlib.sha256(collapsed).hexdigest(),
                    collapsed.decode() if with_text else None,
                )
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [struct, pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(column, kind) for column, kind in zip(rows, kinds)]
            count = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([ids, *arrays][:count], names[:count])
