"""WARC archives and a Merkle audit of their replicas.

``write_warc`` writes records in order of their id into files of one gzip member per
record, and beside each an index of the byte ranges of its records.  ``merkle_levels`` hashes the
byte range of every record of an archive (the leaves) and then, level by level, the
hashes of ``FAN_OUT`` consecutive ranges of a file with the offset range they cover; a
file's last hash is its root.  ``damaged_records`` compares the roots of two replicas
and follows only branches that differ down to the records in them.

Ranges are those of the index, so a replica with a changed, cut or missing stretch
differs just there; bytes after the last record are one more range, and a file that the
index lacks is one range.  The number of levels is that of the index too, so that the
trees of all replicas, also of one without files, have the same depth.  Files and
levels are handled apart, no task sees more than one file or ``FAN_OUT`` hashes of
a branch, and the driver sees none.  File names and contents depend on the rows
alone, so a task that runs again writes the same files.

Null ids are written first, null payloads as empty records, equal ids in the order
of their payloads; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.storage import pinned

FAN_OUT = 16
FILE_BYTES = 8_000_000  # a file is closed at this many compressed bytes
_PLACE_BYTES = 32  # of a record in the index beside its file
_INDEX = "file string, ordinal int, offset long, length long, id long, record_bytes long, record_sha256 string"


def record_bytes(uri: str | None, payload: str | None) -> bytes:
    """A WARC response record."""
    body = (payload or "").encode()
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\n"
        f"WARC-Target-URI: {uri or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    coder = zlib.compressobj(4, zlib.DEFLATED, 31)
    return coder.compress(record) + coder.flush()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    uri_column: str = "url",
    payload_column: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the archive under ``folder``, an address all machines share; return its index."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(uri_column).alias("uri"),
        F.col(payload_column).alias("payload"),
    )
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "payload", "uri")
    return pinned(ordered.mapInArrow(partial(_write, folder=folder, file_bytes=file_bytes), _INDEX))


def _put(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    passing = f"{root}/{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(passing) as out:
        out.write(content)
    store.move(passing, f"{root}/{name}")


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("file", pa.string()), ("ordinal", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
         ("id", pa.int64()), ("record_bytes", pa.int64()), ("record_sha256", pa.string())]
    )
    partition, files = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    index: list[tuple] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal held, index, size, files
        name = f"part-{partition:06d}-{files:05d}.warc.gz"
        places = np.array([(r[2], r[3], r[4] or 0, r[4] is not None) for r in index], dtype="<i8")
        _put(folder, f"{name}.cdx", places.tobytes())
        _put(folder, name, b"".join(held))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*index), schema.types)], schema=schema
        )
        held, index, size, files = [], [], 0, files + 1
        return batch

    for batch in batches:
        for name, uri, payload in zip(*[column.to_pylist() for column in batch.columns]):
            record = record_bytes(uri, payload)
            member = _member(record)
            file = f"part-{partition:06d}-{files:05d}.warc.gz"
            digest = hashlib.sha256(record).hexdigest()
            index.append((file, len(index), size, len(member), name, len(record), digest))
            held.append(member)
            size += len(member)
            if size >= file_bytes:
                yield close()
    if held:
        yield close()


def _places(folder: str, file: str) -> list[tuple[int, int, int | None]]:
    """(offset, length, id) of the records of a file, from the index beside it; none if the folder lacks both."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    own, beside = store.get_file_info([f"{root}/{file}", f"{root}/{file}.cdx"])
    if own.type == beside.type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/{file}.cdx") as stored:
        rows = np.frombuffer(stored.read(), "<i8").reshape(-1, 4).tolist()
    return [(offset, length, name if known else None) for offset, length, name, known in rows]


def _binary(spark: SparkSession, folder: str, names: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = _binary(spark, folder, "*.warc.gz")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _most_records(spark: SparkSession, index_folder: str) -> int:
    """Records of the file with most of them, from the lengths of the indexes beside the files."""
    longest = _binary(spark, index_folder, "*.warc.gz.cdx").agg(F.max("length")).first()[0]
    return (longest or 0) // _PLACE_BYTES


def copy_archive(
    spark: SparkSession,
    folder: str,
    target: str,
    change: Callable[[bytes, list[tuple[int, int, int | None]]], bytes | None] | None = None,
) -> None:
    """Copy the files of an archive; ``change`` may alter a file's bytes or drop it (None).

    It gets the bytes and the (offset, length, id) of the file's records.
    """
    copied = _files(spark, folder).mapInArrow(
        partial(_copy, folder=folder, target=target, change=change), "file string"
    )
    copied.write.format("noop").mode("overwrite").save()


def _copy(
    batches: Iterator[pa.RecordBatch], folder: str, target: str, change
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            content = row["content"]
            if change is not None:
                content = change(content, _places(folder, row["file"]))
            if content is not None:
                _put(target, row["file"], content)
        yield batch.select(["file"])


def merkle_levels(spark: SparkSession, folder: str, index_folder: str) -> list[DataFrame]:
    """Hash tree of each file: ``file, node, first, last, hash``; leaves first, roots last.

    ``node`` numbers the ranges of a level in a file, ``first`` and ``last`` are the offsets
    that the range covers.  A file that the archive lacks has no node.  The ranges and the
    number of levels are those of the archive in ``index_folder``, of which ``folder`` is a
    replica or the same.
    """
    cut = partial(_leaves, index_folder=index_folder)
    leaves = _files(spark, folder).mapInArrow(cut, "file string, node int, first long, last long, hash binary")
    levels = [pinned(leaves)]
    widest = _most_records(spark, index_folder)  # the number of its last range
    while widest:
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        level = (
            levels[-1]
            .groupBy("file", F.floor(F.col("node") / FAN_OUT).cast("int").alias("parent"))
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), children.alias("c"))
        )
        joined = F.array_join(F.transform("c", lambda c: F.hex(c["hash"])), "")
        covered = F.concat_ws(":", F.col("first").cast("string"), F.col("last").cast("string"), joined)
        hashed = F.unhex(F.sha2(covered, 256)).alias("hash")
        levels.append(pinned(level.select("file", F.col("parent").alias("node"), "first", "last", hashed)))
        widest //= FAN_OUT
    return levels


def _leaves(batches: Iterator[pa.RecordBatch], index_folder: str) -> Iterator[pa.RecordBatch]:
    names = ["file", "node", "first", "last", "hash"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):
            content = memoryview(content.as_buffer())
            ranges = _places(index_folder, file.as_py())
            places = [(offset, offset + length) for offset, length, _ in ranges]
            end = places[-1][1] if places else 0
            places.append((end, max(end, len(content))))
            rows = [
                (file.as_py(), k, first, last, hashlib.sha256(content[first:last]).digest())
                for k, (first, last) in enumerate(places)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names
            )


def damaged_records(first: list[DataFrame], second: list[DataFrame], index: DataFrame) -> DataFrame:
    """Index rows whose bytes differ between two replicas, found from the roots down.

    Ranges that differ and are no record are rows without an id: bytes after the last
    record, whose ordinal is the number of records, and files that the index lacks, whose
    ordinal is 0.  Their length is that in the replica that has more.  Both trees must be
    over the same index.
    """
    if len(first) != len(second):
        raise ValueError("The trees of the two replicas differ in depth: build both over the same index.")
    branches = None
    for mine, theirs in zip(reversed(first), reversed(second)):
        if branches is not None:
            inside = branches.select("file", F.col("node").alias("parent"))
            mine, theirs = _within(mine, inside), _within(theirs, inside)
        mine = mine.select("file", "node", "first", "last", "hash")
        other = theirs.select(
            "file", "node", F.col("first").alias("other_first"), F.col("last").alias("other_last"),
            F.col("hash").alias("other"),
        )
        # Full, as either replica may lack a file.
        differ = mine.join(other, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        branches = pinned(
            differ.select(
                "file",
                "node",
                F.coalesce("first", "other_first").alias("first"),
                F.greatest("last", "other_last").alias("last"),
            )
        )
    marked = branches.withColumnRenamed("node", "ordinal")
    records = pinned(index.join(marked, ["file", "ordinal"], "left_semi"))
    # A lost file also lacks the range after its last record, which mostly is empty.
    others = marked.join(records, ["file", "ordinal"], "left_anti").where("last > first or ordinal = 0")
    ranges = others.select("file", "ordinal", F.col("first").alias("offset"), (F.col("last") - F.col("first")).alias("length"))
    return records.unionByName(ranges, allowMissingColumns=True)


def _within(level: DataFrame, parents: DataFrame) -> DataFrame:
    """The nodes of a level that are below ``parents``: ``file``, ``parent``."""
    own = level.withColumn("parent", F.floor(F.col("node") / FAN_OUT).cast("int"))
    return own.join(parents, ["file", "parent"], "left_semi")
