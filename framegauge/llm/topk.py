"""Exact top-k inner products by tiled matrix products.

Vectors are packed into blocks of bounded size.  A query tile meets every candidate
shard in one matrix product; a partial selection keeps the best ``k`` of each row of
the product.  The short lists of a tile are merged in a tree of ``FAN_IN`` lists a
step until one is left for each query.

A tile is sent to the shards and a shard to groups of ``TILES_TOGETHER`` tiles, so a
task holds one shard and one such group.

Integer components: ``floor(scale * x)`` of each component as a double.  Products
are taken in doubles while no sum can pass 2^53, else in whole numbers; a score
outside a long fails.  Vectors that are null, empty, or hold a null or non-finite
component take no part.  Only vectors of equal length are compared.  A query never
meets its own row, but it meets other rows with the same id.  Ties go to the smaller id.
An empty table gives no row; rows whose id is null take no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.storage import pinned

TILE_ROWS = 1_024
SHARD_ROWS = 4_096
TILES_TOGETHER = 8
FAN_IN = 16

_BLOCK = "dim int, block int, ids binary, marks binary, kind string, vectors binary"
_LISTS = "dim int, tile int, part int, queries binary, ids binary, scores binary"
_ABSENT = np.iinfo(np.int64).min
_EXACT = 2.0**53


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id``, ``mark`` (a number of the row) and ``vector`` of the rows that take part."""
    doubles = F.col(vector_column).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_column).isNotNull() & (F.size(vector_column) > 0) & finite).select(
        F.col(id_column).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("mark"),
        F.col(vector_column).alias("vector"),
    )


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tile_rows: int = TILE_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score`` of the best ``k`` rows of each query.

    ``is_query`` is a condition on the column ``id``.
    """
    vectors = pinned(usable_vectors(rows, id_column, vector_column))
    shards, shard_count = _blocks(vectors, shard_rows, scale)
    tiles, tile_count = _blocks(vectors.where(is_query), tile_rows, scale)
    together = -(-tile_count // TILES_TOGETHER)
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))).alias("shard")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(together - 1))).alias("tiles")
    group = F.floor(F.col("block") / TILES_TOGETHER).cast("int").alias("tiles")
    sent_tiles = tiles.select("*", group, every_shard)
    sent_shards = shards.select("*", F.col("block").alias("shard"), every_group)
    keys = ["dim", "shard", "tiles"]
    lists = pinned(
        sent_shards.groupBy(*keys).cogroup(sent_tiles.groupBy(*keys)).applyInArrow(_product(k), _LISTS)
    )
    parts = shard_count
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = F.floor(F.col("part") / FAN_IN).cast("int").alias("part")
        grouped = lists.select("dim", "tile", merged, "queries", "ids", "scores")
        lists = pinned(grouped.groupBy("dim", "tile", "part").applyInArrow(_merger(k), _LISTS))
    return lists.mapInArrow(_ranked, "query_id long, rank int, id long, score long")


def _blocks(vectors: DataFrame, rows: int, scale: int) -> tuple[DataFrame, int]:
    """One block for each length and partition; the number of partitions."""
    count = max(1, -(-vectors.count() // rows))
    dealt = vectors.repartition(count)
    return pinned(dealt.mapInArrow(partial(_pack, scale=scale), _BLOCK)), count


def _pack(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[int, int, list[float]]]] = {}
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            held.setdefault(len(row[2]), []).append(row)
    block = TaskContext.get().partitionId()
    for dim, part in held.items():
        ids, marks, vectors = zip(*sorted(part))
        whole = np.floor(np.array(vectors, dtype=np.float64) * scale)
        largest = np.abs(whole).max()
        kind = next((t for t in ("i1", "i2", "i4") if largest <= np.iinfo(t).max), "f8")
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "ids": pa.array([np.array(ids, "i8").tobytes()], pa.binary()),
                "marks": pa.array([np.array(marks, "i8").tobytes()], pa.binary()),
                "kind": pa.array([kind]),
                "vectors": pa.array([whole.astype(kind).tobytes()], pa.binary()),
            }
        )


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["dim"])
    return np.frombuffer(row["ids"], "i8"), np.frombuffer(row["marks"], "i8"), vectors


def inner_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact whole-number products as longs."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if bound * queries.shape[1] < _EXACT:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (queries, candidates)]
    return (whole[0] @ whole[1].T).astype(np.int64)  # fails outside a long


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row: highest score, then smallest id."""
    width = scores.shape[1]
    if width > 2 * k:  # partial selection; ties at the last place stay
        least = np.partition(scores, width - k, axis=1)[:, width - k : width - k + 1]
        rows, columns = np.nonzero(scores >= least)
        starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(scores)))))
        place = np.arange(len(rows)) - starts[rows]
        widest = int(place.max(initial=-1)) + 1
        some_scores = np.full((len(scores), widest), _ABSENT)
        some_ids = np.zeros((len(scores), widest), dtype=np.int64)
        some_scores[rows, place] = scores[rows, columns]
        some_ids[rows, place] = np.broadcast_to(ids, scores.shape)[rows, columns]
        ids, scores = some_ids, some_scores
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _lists(dim: int, tile: int, part: int, queries: bytes, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "tile": pa.array([tile], pa.int32()),
            "part": pa.array([part], pa.int32()),
            "queries": pa.array([queries], pa.binary()),
            "ids": pa.array([ids.astype("i8").tobytes()], pa.binary()),
            "scores": pa.array([scores.astype("i8").tobytes()], pa.binary()),
        }
    )


_NO_LISTS = _lists(0, 0, 0, b"", np.empty(0), np.empty(0)).slice(0, 0)


def _product(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def product(shard: pa.Table, tiles: pa.Table) -> pa.Table:
        found = [_NO_LISTS]
        for own in shard.to_pylist():
            ids, marks, vectors = _unpacked(own)
            for tile in tiles.to_pylist():
                _, query_marks, queries = _unpacked(tile)
                scores = inner_products(queries, vectors)
                scores[query_marks[:, None] == marks] = _ABSENT
                chosen = best(ids, scores, k)
                found.append(_lists(own["dim"], tile["block"], own["block"], tile["ids"], *chosen))
        return pa.concat_tables(found)

    return product


def _merger(k: int) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        count = len(rows[0]["queries"]) // 8
        ids = np.hstack([np.frombuffer(r["ids"], "i8").reshape(count, -1) for r in rows])
        scores = np.hstack([np.frombuffer(r["scores"], "i8").reshape(count, -1) for r in rows])
        first = rows[0]
        return _lists(first["dim"], first["tile"], first["part"], first["queries"], *best(ids, scores, k))

    return merge


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            queries = np.frombuffer(row["queries"], "i8")
            ids = np.frombuffer(row["ids"], "i8").reshape(len(queries), -1)
            scores = np.frombuffer(row["scores"], "i8").reshape(len(queries), -1)
            at, rank = np.nonzero(scores != _ABSENT)
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(queries[at]),
                    "rank": pa.array((rank + 1).astype(np.int32)),
                    "id": pa.array(ids[at, rank]),
                    "score": pa.array(scores[at, rank]),
                }
            )
