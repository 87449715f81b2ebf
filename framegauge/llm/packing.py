"""Pack token pieces into sequences by best fit and swap-based local search.

Documents are tokenised and cut into pieces of at most one sequence.  Pieces are
dealt by hash into shards of bounded size.  A shard is packed by best fit in order
of falling length; then its sequences are improved by local search.  The search
takes the emptiest sequence and gives its pieces away one by one: a piece *moves*
to the sequence that it fills best, or is *exchanged* for a shorter piece of a
fuller sequence, or for *two* pieces of such a one that are shorter together.  Each step
raises the sum of squared fills.  A sequence that has lost all pieces is gone; one
that cannot be emptied goes back as it was.

A shard leaves a few sequences short.  Its emptiest ones go on to the next level,
where several shards meet and the search runs again, until one group is left.  The
rows at each level are bounded by ``CARRIED`` sequences a group, and the search by
``GIVE_UP``, ``STEPS`` and ``PAIRED``; the bounds limit the search, never the result: every
piece ends in exactly one sequence.

Null text is empty and one piece.  Repeated rows are packed each on its own, equal lengths
in any order, so sequence numbers may differ between runs of other partitions.  An empty
table gives no row.  Other columns of pieces are kept, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from framegauge.llm.chunks import encode_texts, library_encoder
from framegauge.llm.workers import drop_state, slices
from framegauge.schema import col, free_names
from framegauge.storage import pinned

SHARD_PIECES = 2_048
FAN_IN = 8
CARRIED = 64  # emptiest sequences of a group that take part in the next level
GIVE_UP = 8  # emptiest sequences that a group tries to empty in vain before it stops
STEPS = 256  # moves and exchanges for one sequence
PAIRED = 24  # longest pieces of a sequence that are exchanged in pairs

_PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, crc32 of the ids.

    Null text is empty; an empty document is one piece with the end id.  ``with_ids``
    adds the ids as packed little-endian unsigned 32-bit numbers.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_PIECE}"
    cut = partial(_cut, tokenizer=tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids)
    return rows.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def _cut(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(tokenizer, drops_spaces=True)
    tail, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    for batch in slices(batches):
        owner, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, packed in enumerate(encode_texts(encoder, batch.column(1).to_pylist())):
            packed += tail
            for k, at in enumerate(range(0, len(packed), width)):
                part = packed[at : at + width]
                owner.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        arrays = [
            batch.column(0).take(pa.array(owner, pa.int64())),
            pa.array(piece, pa.int32()),
            *[pa.array(values, pa.int64()) for values in (start, length, crc)],
        ]
        if with_ids:
            arrays.append(pa.array(ids, pa.binary()))
        names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def pack_pieces(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``.

    ``pieces`` needs ``length`` (1 to ``capacity``); all columns but ``sequence_id`` and
    ``offset`` are kept.  It is evaluated once.
    """
    pieces = pinned(pieces.drop("sequence_id", "offset"))
    group, bin_name, is_open = names = free_names(pieces, "group", "bin", "open")
    groups = -(-pieces.count() // shard_pieces)
    if not groups:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kept = pieces.columns
    # By their number in the written table, which differs among equal pieces.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    rows = pieces.select(spread.alias(group), F.lit(None).cast("long").alias(bin_name), *map(col, kept))
    done, level = [], 0
    while True:
        last = groups == 1
        own = [StructField(group, IntegerType()), StructField(bin_name, LongType()), StructField(is_open, BooleanType())]
        results = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
        schema = StructType([*own, *pieces.schema.fields, *results])
        pack = _packer(capacity, level, last, names)
        packed = pinned(rows.groupBy(group).applyInArrow(pack, schema))
        done.append(packed.where(~F.col(is_open)).select(*map(col, kept), "sequence_id", "offset"))
        if last:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        regrouped = F.floor(F.col(group) / FAN_IN).cast("int")
        rows = packed.where(F.col(is_open)).select(
            regrouped.alias(group), F.col("sequence_id").alias(bin_name), *map(col, kept)
        )
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _packer(capacity: int, level: int, last: bool, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        return _pack_group(table, capacity, level, last, names)

    return pack


def _pack_group(table: pa.Table, capacity: int, level: int, last: bool, names: list[str]) -> pa.Table:
    """The rows of ``table`` (group, bin, then the columns of the pieces) with their places."""
    drop_state()  # the pieces are cut, so no worker needs the tokenizer
    group_name, bin_name, open_name = names
    group = table.column(group_name)[0].as_py()
    lengths = table.column("length").to_pylist()
    bins = table.column(bin_name).to_pylist()
    if level == 0:
        packed = best_fit(lengths, capacity)
    else:
        by_bin: dict[int, list[int]] = {}
        for row, b in enumerate(bins):
            by_bin.setdefault(b, []).append(row)
        packed = [rows for _, rows in sorted(by_bin.items())]
    packed = local_search(packed, lengths, capacity)
    fills = [sum(lengths[r] for r in rows) for rows in packed]
    short = sorted((f, k) for k, f in enumerate(fills) if f < capacity)
    carried = set() if last else {k for _, k in short[:CARRIED]}
    sequence, offset, is_open = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
    first = (level << 58) | (group << 24)
    for k, rows in enumerate(packed):
        at = 0
        for r in rows:
            sequence[r], offset[r], is_open[r] = first + k, at, k in carried
            at += lengths[r]
    columns = {name: table.column(name) for name in table.column_names}
    own = {name: columns.pop(name) for name in (group_name, bin_name)}
    columns = {**own, open_name: pa.array(is_open), **columns}
    columns["sequence_id"] = pa.array(sequence, pa.int64())
    columns["offset"] = pa.array(offset, pa.int64())
    return pa.table(columns)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit by falling length: each piece into the fullest sequence that takes it."""
    packed: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # sorted gaps that have a sequence
    for row in sorted(range(len(lengths)), key=lambda r: -lengths[r]):
        size = lengths[row]
        at = bisect.bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps[at]
            k = by_gap[gap].pop()
            if not by_gap[gap]:
                del gaps[at]
        else:
            gap, k = capacity, len(packed)
            packed.append([])
        packed[k].append(row)
        gap -= size
        if gap:
            if not by_gap[gap]:
                bisect.insort(gaps, gap)
            by_gap[gap].append(k)
    return packed


def local_search(packed: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty sequences by moves and exchanges that raise the squared fill.

    Stops when no whole sequence's worth of space is free, or after ``GIVE_UP`` sequences
    that could not be emptied.
    """
    bins = [list(rows) for rows in packed]
    fill = [sum(lengths[r] for r in rows) for rows in bins]
    free, stuck = len(bins) * capacity - sum(fill), set()
    while free >= capacity and len(stuck) < GIVE_UP:
        short = [k for k, f in enumerate(fill) if 0 < f < capacity]
        open_to_try = [k for k in short if k not in stuck]
        if len(short) < 2 or not open_to_try:
            break
        emptiest = min(open_to_try, key=fill.__getitem__)
        others = [k for k in short if k != emptiest]
        changes = _emptied(bins[emptiest], [bins[k] for k in others], lengths, capacity)
        if changes is None:
            stuck.add(emptiest)
            continue
        bins[emptiest], fill[emptiest] = [], 0
        for at, rows in changes.items():
            bins[others[at]] = rows
            fill[others[at]] = sum(lengths[r] for r in rows)
        free -= capacity
    return [rows for rows in bins if rows]


class _Exchanges:
    """One or two pieces of a sequence that a longer piece may take the place of."""

    def __init__(self, bins: list[list[int]], lengths: list[int]) -> None:
        self._lengths = lengths
        entries = [entry for at, rows in enumerate(bins) for entry in self._of(at, rows)]
        self._table = np.array(entries, dtype=np.int64).reshape(-1, 4)

    def _of(self, at: int, rows: list[int]) -> list[tuple[int, int, int, int]]:
        """(sum, sequence, piece, second piece or -1); pairs of the longest ``PAIRED`` only."""
        size = self._lengths
        found = [(size[r], at, r, -1) for r in rows]
        longest = sorted(rows, key=lambda r: -size[r])[:PAIRED]
        return found + [(size[r] + size[s], at, r, s) for r, s in combinations(longest, 2)]

    def best(self, size: int, gap: np.ndarray) -> tuple[int, list[int]] | None:
        """The exchange after which the taking sequence is fuller by most."""
        gain = size - self._table[:, 0]
        gain[gain > gap[self._table[:, 1]]] = 0
        at = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[at] <= 0:
            return None
        _, k, first, second = self._table[at].tolist()
        return k, [first] if second < 0 else [first, second]

    def replace(self, at: int, rows: list[int]) -> None:
        new = np.array(self._of(at, rows), dtype=np.int64).reshape(-1, 4)
        self._table = np.concatenate([self._table[self._table[:, 1] != at], new])


def _emptied(
    leaving: list[int], bins: list[list[int]], lengths: list[int], capacity: int
) -> dict[int, list[int]] | None:
    """The sequences that change when the ``leaving`` pieces find room, or None."""
    gap = np.array([capacity - sum(lengths[r] for r in rows) for rows in bins], dtype=np.int64)
    left = sorted((lengths[r], r) for r in leaving)
    now: dict[int, list[int]] = {}
    exchanges = None
    for _ in range(STEPS):
        if not left:
            return now
        size, row = left.pop()
        fits = np.flatnonzero(gap >= size)
        if len(fits):  # move
            at, out = int(fits[np.argmin(gap[fits])]), []
        else:
            exchanges = exchanges or _Exchanges([now.get(k, b) for k, b in enumerate(bins)], lengths)
            found = exchanges.best(size, gap)
            if found is None:
                return None
            at, out = found
        now[at] = [r for r in now.get(at, bins[at]) if r not in out] + [row]
        gap[at] += sum(lengths[r] for r in out) - size
        if exchanges:
            exchanges.replace(at, now[at])
        for r in out:
            bisect.insort(left, (lengths[r], r))
    return None
