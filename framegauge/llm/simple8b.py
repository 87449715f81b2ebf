"""Token ids in word-aligned Simple-8b files, in ascending document order.

Coding: a 64-bit word holds a selector in its top 4 bits and, below, as many ids
as fit at one width: 1 id of 60 bits, 2 of 30, ... 60 of 1 bit.  The encoder takes
at each point the selector with most ids.  An id over 60 bits is an escape: a word
with selector 15, then the id itself as a raw word.  Ids are coded in blocks of
``BLOCK_IDS``; the footer holds the place and the first id of each block, so that
blocks are written, read and decoded apart, each with one vector operation per selector.

File: ``S8B1``, words of all blocks, footer (arrays of block word offsets, block
id offsets, document ids, null flags of those, and id counts), footer sizes,
``S8B1``.  All numbers are little-endian.

Documents are range-partitioned and sorted by id (nulls first; rows of equal id by
text), and each task writes the files of its range.  File names and contents
depend on the rows alone, and a file is moved to its name when complete, so a task
that runs again after the loss of an executor writes the same files.  The one thing
the driver gathers is the number of ids in each partition.  Null text counts as
empty, an empty table gives no file and no row, other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.llm.chunks import encode_texts, library_encoder
from framegauge.llm.workers import STORE_BYTES, slices

BLOCK_IDS = 65_536
WORD_BYTES = 2 * STORE_BYTES  # what a worker keeps of words: new ones cost most of the time here
FILE_IDS = 4_000_000  # a file is closed at this many ids; documents are not split

# How many ids of how many bits share a word.
PACKINGS = (
    (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8),
    (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1),
)
ESCAPE = 15
_MAGIC = b"S8B1"
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)
_SIZES = np.array([*[n for n, _ in PACKINGS], 1, 1], dtype=np.uint8)  # ids that a selector takes
_SMALL_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The number of bits of each id."""
    if int(ids.max()) < len(_SMALL_WIDTHS):
        return _SMALL_WIDTHS[ids]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids."""
    count = len(ids)
    if not count:
        return np.empty(0, dtype=np.uint64)
    padded = np.zeros(count + 60, dtype=np.uint64)
    padded[:count] = ids
    bits = _widths(padded)
    chosen = np.zeros(count, dtype=np.uint8)
    # Greatest width of the ``reach`` ids from each place on; two such windows make a longer one.
    most, reach = bits, 1
    for selector, (n, width) in enumerate(PACKINGS):
        while reach < n:
            step = min(reach, n - reach)
            most, reach = np.maximum(most[:-step], most[step:]), reach + step
        fits = most[:count] <= width
        if not fits.any():
            break
        np.maximum(chosen, fits * np.uint8(selector), out=chosen)
    chosen[bits[:count] > PACKINGS[0][1]] = ESCAPE
    taken = _SIZES[chosen].tobytes()
    starts, at = [], 0
    while at < count:
        starts.append(at)
        at += taken[at]
    starts = np.array(starts)
    selectors = chosen[starts]
    escaped = selectors == ESCAPE
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    for selector, (n, width) in enumerate(PACKINGS):
        own = selectors == selector
        if own.any():
            firsts, packed = starts[own], np.uint64(selector << 60)
            for k in range(n):
                packed = packed | padded[firsts + k] << np.uint64(k * width)
            words[place[own]] = packed
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = padded[starts[escaped]]
    return words


def decode(words: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of Simple-8b words."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = _after_escape(selectors)
    sizes = np.array([*[n for n, _ in PACKINGS], 0, 0], dtype=np.int64)[selectors]
    sizes[raw] = 1
    offsets = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for selector, (n, width) in enumerate(PACKINGS):
        own = (selectors == selector) & ~raw
        if own.any():
            shifts = np.arange(n, dtype=np.uint64) * np.uint64(width)
            values = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
            ids[offsets[own][:, None] + np.arange(n)] = values
    ids[offsets[raw]] = words[raw]
    return ids[:count]


def _after_escape(selectors: np.ndarray) -> np.ndarray:
    """Which words are raw: each follows an escape that is not itself raw."""
    raw = np.zeros(len(selectors), dtype=bool)
    for at in np.flatnonzero(selectors == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1] = True
    return raw


def file_bytes(documents: list[tuple[int | None, np.ndarray]], local_start: int) -> bytes:
    """One file of documents (id or null, token ids).

    ``local_start`` counts the ids of earlier files of the same partition.
    """
    return b"".join(_file_parts(documents, local_start))


def _file_parts(documents: list[tuple[int | None, np.ndarray]], local_start: int) -> Iterator[bytes]:
    """A file block by block, so that its words are never held all together."""
    ids = np.concatenate([ids for _, ids in documents])
    sizes = []
    yield _MAGIC
    for at in range(0, len(ids), BLOCK_IDS):
        words = encode(ids[at : at + BLOCK_IDS].astype(np.uint64))
        sizes.append(len(words))
        yield words.astype("<u8").tobytes()
    yield np.array(list(accumulate([0, *sizes])), dtype="<u8").tobytes()
    yield np.array([*range(0, len(ids), BLOCK_IDS), len(ids)], dtype="<u8").tobytes()
    yield np.array([name or 0 for name, _ in documents], dtype="<i8").tobytes()
    yield np.array([name is None for name, _ in documents], dtype="u1").tobytes()
    yield np.array([len(ids) for _, ids in documents], dtype="<u8").tobytes()
    yield struct.pack("<QQQ", len(sizes), len(documents), local_start) + _MAGIC


def file_documents(content: bytes | pa.NativeFile) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, ids before it in its partition, its ids) of a file, which is read block by block."""
    file = pa.BufferReader(content) if isinstance(content, bytes) else content
    size = file.size()
    if size < len(_MAGIC) + 28 or file.read_at(4, 0) != _MAGIC or file.read_at(4, size - 4) != _MAGIC:
        raise ValueError("not a Simple-8b token file")
    blocks, documents, start = struct.unpack("<QQQ", file.read_at(24, size - 28))
    length = 16 * (blocks + 1) + 17 * documents
    footer, at = file.read_at(length, size - 28 - length), 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(footer, kind, n, at)
        at += values.nbytes
        return values

    word_offsets, id_offsets = take("<u8", blocks + 1).tolist(), take("<u8", blocks + 1).tolist()
    names, nulls, counts = take("<i8", documents), take("u1", documents), take("<u8", documents)

    def decoded() -> Iterator[np.ndarray]:
        for k in range(blocks):
            first, last = word_offsets[k : k + 2]
            words = np.frombuffer(file.read_at(8 * (last - first), len(_MAGIC) + 8 * first), "<u8")
            yield decode(words, id_offsets[k + 1] - id_offsets[k])

    following, held = decoded(), np.empty(0, dtype=np.uint64)
    for name, null, n in zip(names.tolist(), nulls.tolist(), counts.tolist()):
        parts, missing = [], n
        while missing > len(held):
            parts.append(held)
            missing -= len(held)
            held = next(following)
        parts.append(held[:missing])
        held = held[missing:]
        yield None if null else name, start, np.concatenate(parts)
        start += n


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    file_ids: int = FILE_IDS,
) -> list[int]:
    """Write the ids of all documents under ``folder``, a shared folder's address.

    Returns the number of ids before each partition, which readers need.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    write = partial(_write_partition, folder=folder, tokenizer=tokenizer, end_id=end_id, file_ids=file_ids)
    written = ordered.mapInArrow(write, "partition int, ids long")
    totals = {r.partition: r.ids for r in written.collect()}  # one row per task
    last = max(totals, default=-1)
    return list(accumulate((totals.get(k, 0) for k in range(last)), initial=0))


def _write_partition(
    batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, file_ids: int
) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    encoder = library_encoder(tokenizer, most_bytes=WORD_BYTES)
    context = TaskContext.get()
    partition, attempt = context.partitionId(), context.taskAttemptId()
    pending: list[tuple[int | None, np.ndarray]] = []
    held = total = files = 0

    def close() -> None:
        nonlocal pending, held, files
        name = f"{root}/part-{partition:06d}-{files:05d}.s8b"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{name}.{attempt}") as out:
            for part in _file_parts(pending, total - held):
                out.write(part)
        store.move(f"{name}.{attempt}", name)
        pending, held, files = [], 0, files + 1

    tail = np.array([end_id], dtype="<u4").tobytes()
    for batch in slices(batches):
        names = batch.column(0).to_pylist()
        for name, packed in zip(names, encode_texts(encoder, batch.column(1).to_pylist())):
            ids = np.frombuffer(packed + tail, "<u4")
            pending.append((name, ids))
            held, total = held + len(ids), total + len(ids)
            if held >= file_ids:
                close()
    if pending:
        close()
    if total:
        yield pa.RecordBatch.from_pydict(
            {"partition": pa.array([partition], pa.int32()), "ids": pa.array([total], pa.int64())}
        )


def read_token_files(
    spark: SparkSession, folder: str, starts: list[int], with_ids: bool = False
) -> DataFrame:
    """One row per document in the files: id, ids before it, number and crc32 of its ids.

    ``with_ids`` adds the ids themselves as an array.
    """
    if not starts or not _has_files(spark, folder):
        files = spark.createDataFrame([], "path string")
    else:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.s8b")
            .load(folder)
            .select("path")  # tasks read the blocks themselves: no file passes whole through the JVM
        )
    schema = "id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<long>"
    return files.mapInArrow(partial(_read_files, folder=folder, starts=starts, with_ids=with_ids), schema)


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _read_files(
    batches: Iterator[pa.RecordBatch], folder: str, starts: list[int], with_ids: bool
) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file_name = path.rsplit("/", 1)[1]
            base = starts[int(file_name.split("-")[1])]
            columns: list[list] = [[], [], [], [], []]
            with store.open_input_file(f"{root}/{file_name}") as file:
                for name, first, ids in file_documents(file):
                    row = [name, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())]
                    for column, value in zip(columns, [*row, ids.tolist() if with_ids else None]):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
            if with_ids:
                arrays.append(pa.array(columns[4], pa.list_(pa.int64())))
            names = ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)]
            yield pa.RecordBatch.from_arrays(arrays, names)
