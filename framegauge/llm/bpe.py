"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours
are the encoding of theirs.  So the encodings are the paths of an automaton whose
states are (last token, place in the trie of token bytes), where a token may end
only if it may follow the last one.  Read bytewise this automaton is not
deterministic: after ``th`` the token may be over or go on as ``the``.  The class
below determinises it: a state is the set of places together with the tokens that
each has read but that are not yet common to all.  What becomes common is emitted;
nothing waits longer than the longest token goes on.  States and steps are built
when they are first met and dropped together at a bound, as in lazy pattern
matchers; that costs time only.

Decoding steps an incremental UTF-8 machine over the ids: it holds the at most
three bytes of an unfinished character and emits whole characters, and runs of tokens
that are whole characters at once.

Null text is empty; both give no id.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.llm.chunks import ChunkEncoder, encode_texts, split_before_spaces
from framegauge.llm.workers import slices, worker_state

MAX_STATES = 160_000
MAX_PAIRS = 400_000
_NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BpeTransducer:
    """Encode pieces of text by walking the determinised transducer."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self._ranks, self._max_states = ranks, max_states
        self._bytes = {rank: token for token, rank in ranks.items()}
        # The trie of token bytes: one table by (node, byte), the token that ends at a
        # node, and whether the node goes on.
        self._children: dict[int, int] = {}
        self._ends: list[int] = [_NONE]
        self._goes_on = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self._children.get(node << 8 | byte)
                if following is None:
                    following = self._children[node << 8 | byte] = len(self._ends)
                    self._goes_on[node] = 1
                    self._ends.append(_NONE)
                    self._goes_on.append(0)
                node = following
            self._ends[node] = rank
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((_NONE, 0, ()),)
        self._numbers = {start: 0}
        self._states = [start]
        self._finals: list[tuple[int, ...]] = [()]
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > until:
            ranked = [self._ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranked if r is not None), default=None)
            if best is None:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self._ranks[part] for part in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from; None for bytes and unreachable tokens."""
        if token not in self._halves:
            parts = self.merged(self._bytes[token], until=2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]]:
        """What stands at the left and right end of a token while it is merged.

        Each list holds, in the order of merging, the piece at that end and the rank of the
        merge that takes it in.
        """
        known = self._edges.get(token)
        if known is None:
            ends: list[list[tuple[bytes, float]]] = []
            for side in (0, 1):
                pieces, part, rank = [], token, float("inf")
                while True:
                    pieces.append((self._bytes[part], rank))
                    halves = self._split(part)
                    if halves is None:
                        break
                    part, rank = halves[side], part
                ends.append(pieces[::-1])
            known = self._edges[token] = ends[0], ends[1]
        return known

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge crosses the border between the two tokens."""
        key = (last + 1) << 32 | token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known = self._border_holds(last, token)
        return known

    def _border_holds(self, last: int, token: int) -> bool:
        reachable = len(self._bytes[token]) == 1 or self._split(token) is not None
        if last == _NONE or not reachable:
            return reachable
        left, right = self._edge(last)[1], self._edge(token)[0]
        i = j = 0
        while True:
            (a, left_rank), (b, right_rank) = left[i], right[j]
            rank = self._ranks.get(a + b)
            if rank is not None and rank < left_rank and rank <= right_rank:
                return False
            if left_rank == right_rank == float("inf"):
                return True
            if left_rank <= right_rank:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        # Places stand in the order in which their unfinished tokens began, so equal
        # sets of places are equal tuples.
        places, ended = [], None
        child, ends, goes_on, pairs = self._children.get, self._ends, self._goes_on, self._pairs
        for last, node, waiting in self._states[state]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if goes_on[node]:
                places.append((last, node, waiting))
            if ended is None and (token := ends[node]) != _NONE:
                follows = pairs.get((last + 1) << 32 | token)
                if follows or (follows is None and self._may_follow(last, token)):
                    ended = (token, 0, (*waiting, token))
        places.append(ended)
        emitted = places[0][2]
        if emitted:
            for _, _, waiting in places:
                while waiting[: len(emitted)] != emitted:
                    emitted = emitted[:-1]
            if emitted:
                cut = len(emitted)
                places = [(last, node, waiting[cut:]) for last, node, waiting in places]
        following = tuple(places)
        number = self._numbers.get(following)
        if number is None:
            number = len(self._states)
            self._numbers[following] = number
            self._states.append(following)
            self._finals.append(following[-1][2])
        result = self._steps[state << 8 | byte] = number, emitted
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(self._states) > self._max_states:
            self._reset()
        ids: list[int] = []
        steps, state = self._steps, 0
        for byte in piece:
            state, emitted = steps.get(state << 8 | byte) or self._step(state, byte)
            if emitted:
                ids += emitted
        ids += self._finals[state]
        return ids


class StreamDecoder:
    """Ids to whole characters; the machine's state is the unfinished bytes.

    Tokens of whole characters leave the machine in its first state and are emitted in runs.
    """

    def __init__(self, token_bytes: dict[int, bytes]) -> None:
        self._bytes = token_bytes
        self._is_part = np.zeros(max(token_bytes, default=-1) + 1, dtype=bool)
        for token, content in token_bytes.items():
            try:
                content.decode()
            except UnicodeDecodeError:
                self._is_part[token] = True

    @staticmethod
    def unfinished(tail: bytes) -> int:
        """Bytes at the end that may still become a character."""
        for back in range(1, min(3, len(tail)) + 1):
            lead = tail[-back]
            if lead >= 0xC0:
                needed = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if needed > back and lead < 0xF5 else 0
            if lead < 0x80:
                break
        return 0

    def pieces(self, ids: Sequence[int]) -> Iterator[bytes]:
        """Decoded bytes in runs of whole characters; a broken tail comes last."""
        held, at = b"", 0
        parts = np.flatnonzero(self._is_part[np.asarray(ids, dtype=np.int64)]).tolist()
        for part in [*parts, len(ids)]:
            if part > at:
                yield held + b"".join(map(self._bytes.__getitem__, ids[at:part]))
                held = b""
            if part < len(ids):
                joined = held + self._bytes[ids[part]]
                cut = len(joined) - self.unfinished(joined)
                held = joined[cut:]
                if cut:
                    yield joined[:cut]
            at = part + 1
        yield held


class _Coder(NamedTuple):
    encoder: ChunkEncoder
    decoder: StreamDecoder


def _coder(ranks_path: str, pattern: str) -> _Coder:
    return worker_state(("bpe", ranks_path, pattern), lambda: _new_coder(ranks_path, pattern))


def _new_coder(ranks_path: str, pattern: str) -> _Coder:
    import regex

    ranks = load_ranks(ranks_path)
    transducer = BpeTransducer(ranks)
    pieces = regex.compile(pattern).findall

    def encode(chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isascii() and word.isalpha():
            return array("I", transducer.encode_piece(chunk.encode())).tobytes()
        parts = pieces(chunk)
        if len(parts) == 1:
            return array("I", transducer.encode_piece(parts[0].encode())).tobytes()
        return b"".join(map(encoder.store.__getitem__, parts))

    encoder = ChunkEncoder(encode, split_before_spaces)
    return _Coder(encoder, StreamDecoder({rank: token for token, rank in ranks.items()}))


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id``, ``ids`` (packed little-endian unsigned 32 bit) of every document."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        partial(_encode_batches, ranks_path=ranks_path, pattern=pattern), f"id {kind}, ids binary"
    )


def _encode_batches(
    batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str
) -> Iterator[pa.RecordBatch]:
    encoder = _coder(ranks_path, pattern).encoder
    for batch in slices(batches):
        ids = list(encode_texts(encoder, batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])


def decode_documents(
    encoded: DataFrame, ranks_path: str, pattern: str, with_text: bool = True
) -> DataFrame:
    """``id``, ``n_tokens``, digests of the ids and of the decoded bytes, and the text."""
    kind = encoded.schema["id"].dataType.simpleString()
    decode = partial(_decode_batches, ranks_path=ranks_path, pattern=pattern, with_text=with_text)
    return encoded.select("id", "ids").mapInArrow(decode, _decoded_schema(kind, with_text))


def round_trip(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """:func:`decode_documents` of :func:`encode_documents`, by one worker for each task.

    Two Python steps in one stage would run in two processes a task, each of which
    builds the transducer and meets the words anew.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    both = partial(_round_trip_batches, ranks_path=ranks_path, pattern=pattern, with_text=with_text)
    return rows.mapInArrow(both, _decoded_schema(kind, with_text))


def _decoded_schema(kind: str, with_text: bool) -> str:
    fixed = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return fixed + ", text string" * with_text


def _round_trip_batches(
    batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, with_text: bool
) -> Iterator[pa.RecordBatch]:
    return _decode_batches(_encode_batches(batches, ranks_path, pattern), ranks_path, pattern, with_text)


def _decode_batches(
    batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, with_text: bool
) -> Iterator[pa.RecordBatch]:
    decoder = _coder(ranks_path, pattern).decoder
    for batch in slices(batches):
        counts, ids_digests, digests, texts = [], [], [], []
        for packed in batch.column(1).to_pylist():
            ids = array("I", packed)
            decoded = b"".join(decoder.pieces(ids))
            counts.append(len(ids))
            ids_digests.append(hashlib.sha256(packed).hexdigest())
            digests.append(hashlib.sha256(decoded).hexdigest())
            if with_text:
                texts.append(decoded.decode(errors="replace"))
        arrays = [
            batch.column(0),
            pa.array(counts, pa.int64()),
            pa.array(ids_digests, pa.string()),
            pa.array(digests, pa.string()),
        ]
        if with_text:
            arrays.append(pa.array(texts, pa.string()))
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "text"][: len(arrays)]
        yield pa.RecordBatch.from_arrays(arrays, names)
