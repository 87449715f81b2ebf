"""What a Python worker keeps between tasks, under one bound.

Spark hands idle workers to any task, so a worker meets one operator after another.  It
keeps the state of one operator only: the next operator's takes its place.  A state may
hold a store of words met before, which is bounded in bytes and drops what was not used
lately; that costs time and never changes a result.  Steps that keep nothing call
``drop_state``, so that no worker carries what an earlier step has left through theirs.
Freed memory goes back to the system: a worker lives as long as its executor has tasks.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

STORE_BYTES = 96 << 20  # what all entries of a worker's stores may take
ENTRY_BYTES = 150  # of a dictionary entry and the heads of its two values
LARGEST_KEY = 64  # longer keys are worked out anew each time
SLICE_ROWS = 500

_key: Hashable = None
_state: Any = None


def worker_state(key: Hashable, build: Callable[[], Any]) -> Any:
    """The state that ``build`` makes, kept until another key is asked for."""
    global _key, _state
    if _key != key:
        drop_state()  # the old state goes before the new one is built
        _state = build()
        _key = key
    return _state


def drop_state() -> None:
    """Drop the state of an earlier operator and give its memory back."""
    global _key, _state
    if _key is not None:
        _key = _state = None
        gc.collect()  # states may refer to themselves
        pa.default_memory_pool().release_unused()


class Store(dict):
    """Values by key, made when first asked for; half of them may go when the bound is met.

    Two generations: at half the bound the young entries become the old ones, and the
    former old ones, which were not asked for since, are dropped.
    """

    def __init__(self, make: Callable[[Any], Any], most_bytes: int = STORE_BYTES) -> None:
        super().__init__()
        self._make, self._half = make, most_bytes // 2
        self._old: dict = {}
        self._bytes = 0

    def __missing__(self, key: Any) -> Any:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
            if len(key) > LARGEST_KEY:
                return value
        self._bytes += len(key) + len(value) + ENTRY_BYTES
        if self._bytes > self._half:
            self._old = dict(self)
            self.clear()
            self._bytes = len(key) + len(value) + ENTRY_BYTES
        self[key] = value
        return value

    @property
    def bytes_held(self) -> int:
        """What the entries of both generations take, about."""
        return sum(len(k) + len(v) + ENTRY_BYTES for part in (self, self._old) for k, v in part.items())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are Python objects at a time.

    Arrow keeps the memory of batches that are done; it goes back after each, and at the end.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()
