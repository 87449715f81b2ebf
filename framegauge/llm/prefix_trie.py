"""A prefix trie of conversations as double arrays, one per prefix shard.

Every distinct sequence of first turns is a node.  A conversation is its path of turns,
each known by the SHA-256 of its role and text; equal paths are combined first, so a
conversation that very many share is one weighted path.

Paths are dealt into shards by a prefix.  Its depth is the least power of two at which
the paths that share it hold at most ``UNIT_TURNS`` turns, so that a first turn which a
third of all conversations share is split deeper down and no shard is large.  A path that
ends before that depth stands alone.

A shard numbers its turns densely and packs its trie into BASE and CHECK arrays: the child
of state ``s`` by turn ``c`` is ``t = BASE[s] + c`` if ``CHECK[t] = s``.  Its paths walk these
arrays, which gives the members of each node; sums over subtrees go upwards by depth.
Nodes at the depth of their shard's prefix or below belong to this shard alone.  Nodes
above may be shared with other shards: every shard gives what it knows, and these parts are
merged by the node's address, the hash of its turns.  What the merged nodes themselves add
to the subtrees above them is summed once more within shards and over all of them.

Digests of the members that end at a node read the ids in order, first in ranges that are
joined to stretches of text, then stretch by stretch, so no list is held as a whole.

Null role or text is empty.  Rows with a null conversation id take no part.  Turns are
ordered by ``turn``, null first, equal ones by their hash; repeated rows are repeated turns.
An empty table gives no node, not even the root.  Other columns are ignored.  A path,
40 bytes a turn, is one value of a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.storage import pinned

UNIT_TURNS = 10_000  # turns of the distinct paths of a prefix that is not split
SHARD_TURNS = 40_000  # turns of a shard on average
TRIED_SLOTS = 64  # free slots tried for a node's children before they go to the end
CHUNK_IDS = 4_096

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# --- paths -------------------------------------------------------------------


def turn_paths(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id``, ``path``: (key, size) of each turn in order, size in code points of its text."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (role_column, text_column))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(
        F.col(conv_column).cast("long").alias("conv_id"),
        F.struct(F.col(turn_column).alias("turn"), key.alias("key"), F.length(text).alias("size")).alias("step"),
    )
    ordered = F.sort_array(F.collect_list("step"))
    bare = F.transform(ordered, lambda step: F.struct(step["key"].alias("key"), step["size"].alias("size")))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(bare.alias("path"))


def _joined_keys(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.hex(step["key"])), "")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """``address``, ``path``, ``n`` (members), ``least`` (smallest member) and ``ends`` (digest of all)."""
    addressed = pinned(paths.select("conv_id", "path", F.sha2(_joined_keys(F.col("path")), 256).alias("address")))
    combined = addressed.groupBy("address").agg(
        F.any_value("path").alias("path"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
    )
    return combined.join(member_digests(addressed.select("address", "conv_id")), "address")


def member_digests(members: DataFrame) -> DataFrame:
    """``address``, ``ends``: SHA-256 of the members' ids, ascending and joined by commas.

    The ids of one address are dealt out by ranges before they are joined.
    """
    ranged = members.repartitionByRange("address", "conv_id").sortWithinPartitions("address", "conv_id")
    chunks = ranged.mapInArrow(_join_ids, "address string, first long, ids string")
    gathered = chunks.repartition("address").sortWithinPartitions("address", "first")
    return gathered.mapInArrow(_digest_chunks, "address string, ends string")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    address, ids = None, []

    def chunk() -> tuple[str, int, str]:
        return address, ids[0], ",".join(map(str, ids))

    for batch in batches:
        done = []
        for name, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (name != address or len(ids) >= CHUNK_IDS):
                done.append(chunk())
                ids = []
            address = name
            ids.append(conv_id)
        yield _chunk_batch(done)
    if ids:
        yield _chunk_batch([chunk()])


def _chunk_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, ["address", "first", "ids"])


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    address, digest = None, None

    def found(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        arrays = [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["address", "ends"])

    for batch in batches:
        done = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if digest is not None and name == address:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((address, digest.hexdigest()))
                address, digest = name, hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield found(done)
    if digest is not None:
        yield found([(address, digest.hexdigest())])


# --- shards ------------------------------------------------------------------


def _with_units(distinct: DataFrame, unit_turns: int) -> DataFrame:
    """``distinct`` with ``top``, the depth of the prefix that its unit shares, and ``unit``, its hash."""
    turns = F.size("path")
    # The last depth is the first power of two beyond the path.
    last = F.when(turns > 0, F.length(F.bin(turns.cast("long")))).otherwise(0)

    def prefix(depth: Column) -> Column:
        ended = F.when(depth > turns, F.lit("#")).otherwise(F.lit(""))
        return F.sha2(F.concat(_joined_keys(F.slice("path", F.lit(1), depth)), ended), 256)

    level = F.col("level")
    prefixes = distinct.select(
        "address", "path", F.explode(F.sequence(F.lit(0), last)).alias("level")
    ).select("address", "level", (turns + 1).alias("turns"), prefix(F.call_function("shiftleft", F.lit(1), level)).alias("unit"))
    heavy = prefixes.groupBy("level", "unit").agg(F.sum("turns").alias("turns")).where(F.col("turns") > unit_turns)
    split = (
        prefixes.join(heavy.select("level", "unit"), ["level", "unit"], "left_semi")
        .groupBy("address")
        .agg(F.max("level").alias("level"))
    )
    # Prefixes lose paths as they grow, so the first light one follows the last heavy one.
    # A path's own last prefix is its alone, and stands even if the path itself is long.
    level = F.least(F.coalesce(F.col("level") + 1, F.lit(0)), last)
    topped = distinct.join(split, "address", "left").withColumn("top", F.call_function("shiftleft", F.lit(1), level))
    return topped.withColumn("unit", prefix(F.col("top"))).drop("level")


_NODE = (
    "shard long, owned boolean, address binary, parent binary, parent_conv_id long, conv_id long, depth int, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
)


def prefix_nodes(paths: DataFrame, unit_turns: int = UNIT_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of ``paths`` (``conv_id``, ``path``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of its subtree, ``ends_sha256`` of members that end there.
    """
    distinct = pinned(distinct_paths(paths))
    turns = distinct.agg(F.sum(F.size("path") + 1).alias("n")).first().n or 0
    shards = max(1, -(-turns // shard_turns))
    dealt = _with_units(distinct, unit_turns).select(
        F.pmod(F.xxhash64("unit"), F.lit(shards)).alias("shard"), "path", "n", "least", "ends", "top"
    )
    found = pinned(dealt.groupBy("shard").applyInArrow(_shard_nodes, _NODE))
    own, shared = found.where("owned"), found.where("not owned")
    merged = pinned(_merged(shared))
    totals = _subtree_totals(shared, merged)
    names = merged.select(F.col("address").alias("parent"), F.col("conv_id").alias("above"))
    above = F.coalesce("parent_conv_id", "above").alias("parent_conv_id")
    result = ["conv_id", "depth", above, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # Adaptive execution sends the few merged nodes everywhere if they are small, and splits hot parents.
    inner = own.where("parent is null").withColumn("above", F.lit(None).cast("long")).select(*result)
    tops = own.where("parent is not null").join(names, "parent", "left").select(*result)
    upper = (
        merged.join(totals, "address")
        .withColumn("n_leaves", F.col("n_leaves") + F.col("more_leaves"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.col("more_saved"))
        .withColumn("parent_conv_id", F.lit(None).cast("long"))
        .join(names, "parent", "left")
        .select(*result)
    )
    nodes = inner.unionByName(tops).unionByName(upper)
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))


def _merged(shared: DataFrame) -> DataFrame:
    """The shared nodes, each once, with what their shards know added up."""
    nodes = shared.groupBy("address").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("size").alias("size"),
        F.max("ends_sha256").alias("ends_sha256"),
        F.min("conv_id").alias("conv_id"),
        F.min("shard").alias("shard"),  # the one that carries the node's own share upwards
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    nodes = pinned(nodes)
    # Children that belong to one shard are in the sums; shared children are counted here.
    below = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("below"))
    children = F.col("n_children") + F.coalesce("below", F.lit(0))
    return nodes.join(below.withColumnRenamed("parent", "address"), "address", "left").select(
        *[F.col(c) for c in nodes.columns if c != "n_children"], children.alias("n_children")
    )


def _subtree_totals(shared: DataFrame, merged: DataFrame) -> DataFrame:
    """``address``, ``more_leaves``, ``more_saved``: what shared nodes add to the subtrees of each."""
    own = merged.select(
        "address",
        "shard",
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    rows = shared.select("shard", "address", "parent", "depth").join(own, ["address", "shard"], "left")
    summed = rows.select(
        "shard", "address", "parent", "depth", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "saved")]
    )
    parts = summed.groupBy("shard").applyInArrow(_sum_upwards, "address binary, leaves long, saved long")
    return parts.groupBy("address").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _sum_upwards(table: pa.Table) -> pa.Table:
    """Add each node's values to all nodes above it, the deepest first."""
    addresses, parents = table.column("address").to_pylist(), table.column("parent").to_pylist()
    leaves, saved = table.column("leaf").to_pylist(), table.column("saved").to_pylist()
    depth = table.column("depth").to_numpy()
    place = {address: k for k, address in enumerate(addresses)}
    for k in np.argsort(-depth, kind="stable").tolist():
        if parents[k] is not None:
            above = place[parents[k]]
            leaves[above] += leaves[k]
            saved[above] += saved[k]
    return pa.table(
        {"address": pa.array(addresses, pa.binary()), "leaves": pa.array(leaves), "saved": pa.array(saved)}
    )


class DoubleArray:
    """A trie in BASE and CHECK arrays; state 0 is the root, turns are numbered from 0."""

    def __init__(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """``parents`` and ``turns`` of nodes 1, 2, ... in breadth-first order, by parent."""
        size = 2 * (len(parents) + 1)
        self.base = np.zeros(size, dtype=np.int64)
        self.check = np.full(size, -1, dtype=np.int64)
        self.state_of = np.zeros(len(parents) + 1, dtype=np.int64)  # the state of each node
        self._free, self._end = 1, 1  # all slots before are taken; no slot from here on is
        edges = np.flatnonzero(np.diff(parents, prepend=-1, append=-1)) if len(parents) else np.empty(0, int)
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._place(int(self.state_of[parents[first]]), turns[first:last], first)

    def _place(self, state: int, turns: np.ndarray, first: int) -> None:
        turns = turns.astype(np.int64)
        least, span = int(turns[0]), int(turns.max() - turns.min())
        self._grow(self._end + span + 2 + int(turns[0] - turns.min()))
        while self._free < self._end and self.check[self._free] >= 0:
            self._free += 1
        slot, tried = self._free, 0
        while True:
            slots = turns + (slot - least)
            if slots.min() > 0 and (self.check[slots] < 0).all():
                break
            tried += 1
            slot += 1
            if tried >= TRIED_SLOTS:
                slot = self._end + int(least - turns.min())  # all free from here on
            self._grow(slot + span + 2)
        self.base[state] = slot - least
        self.check[slots] = state
        self.state_of[first + 1 : first + 1 + len(turns)] = slots
        self._end = max(self._end, int(slots.max()) + 1)

    def _grow(self, size: int) -> None:
        lack = size - len(self.check)
        if lack > 0:
            lack = max(lack, len(self.check) // 2)
            self.base = np.append(self.base, np.zeros(lack, dtype=np.int64))
            self.check = np.append(self.check, np.full(lack, -1, dtype=np.int64))

    def follow(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The child of each state by its turn, -1 where there is none."""
        slots = self.base[states] + turns
        inside = (slots > 0) & (slots < len(self.check))
        slots = np.where(inside, slots, 0)
        return np.where(inside & (self.check[slots] == states), slots, -1)


def _trie(starts: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The packed trie of paths, and the dense number of each turn as siblings lie together."""
    node = np.zeros(len(starts), dtype=np.int64)
    kinds = int(turns.max()) + 1 if len(turns) else 1
    parents, labels, count = [], [], 1
    active = np.arange(len(starts))
    depth = 0
    while True:
        active = active[lengths[active] > depth]
        if not len(active):
            break
        edges, place = np.unique(node[active] * kinds + turns[starts[active] + depth], return_inverse=True)
        node[active] = count + place
        parents.append(edges // kinds)
        labels.append(edges % kinds)
        count += len(edges)
        depth += 1
    if not parents:
        return DoubleArray(np.empty(0, np.int64), np.empty(0, np.int64)), turns
    parents, labels = np.concatenate(parents), np.concatenate(labels)
    # Number turns as they first occur in breadth-first order: siblings become neighbours.
    known, first = np.unique(labels, return_index=True)
    renumbered = np.empty(kinds, dtype=np.int64)
    renumbered[known[np.argsort(first)]] = np.arange(len(known))
    return DoubleArray(parents, renumbered[labels]), renumbered[turns]


def _shard_nodes(table: pa.Table) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    lists = table.column("path").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    steps = lists.flatten()
    encoded = steps.field("key").dictionary_encode()
    keys = encoded.dictionary.to_pylist()
    dense = encoded.indices.to_numpy().astype(np.int64)
    sizes = steps.field("size").to_numpy().astype(np.int64)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    starts, lengths = bounds[:-1], np.diff(bounds)
    weights, least = table.column("n").to_numpy(), table.column("least").to_numpy()
    tops, ends = table.column("top").to_numpy(), table.column("ends").to_pylist()

    trie, turns = _trie(starts, lengths, dense)
    states = len(trie.check)
    members, first_conv = np.zeros(states, np.int64), np.full(states, np.iinfo(np.int64).max)
    depths, size, top = np.full(states, -1), np.zeros(states, np.int64), np.zeros(states, np.int64)
    key_of = np.zeros(states, np.int64)
    ends_of: dict[int, str] = {}
    state, active, depth = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), 0
    while len(active):
        here = state[active]
        np.add.at(members, here, weights[active])
        np.minimum.at(first_conv, here, least[active])
        depths[here], top[here] = depth, tops[active]
        if depth:
            at = starts[active] + depth - 1
            size[here], key_of[here] = sizes[at], dense[at]
        over = lengths[active] == depth
        ends_of.update(zip(here[over].tolist(), [ends[k] for k in active[over].tolist()]))
        active = active[~over]
        state[active] = trie.follow(state[active], turns[starts[active] + depth])
        depth += 1

    used = np.flatnonzero(depths >= 0)
    used = used[np.argsort(depths[used], kind="stable")]
    owned = depths >= top
    children = np.bincount(trie.check[used[1:]], minlength=states)
    owned_children = np.bincount(trie.check[used[1:]], weights=owned[used[1:]], minlength=states).astype(np.int64)
    leaves = (owned & (children == 0)).astype(np.int64)
    saved = np.where(owned, (members - 1) * size, 0)
    levels = np.split(used, np.flatnonzero(np.diff(depths[used])) + 1)
    for level in levels[:0:-1]:
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    addresses: dict[int, bytes] = {}
    for s in used[~owned[used]].tolist():  # from the root on
        before = addresses[int(trie.check[s])] + keys[key_of[s]] if s else b""
        addresses[s] = hashlib.sha256(before).digest()
    above = trie.check[used].tolist()
    mine = owned[used].tolist()
    rows = used.tolist()
    parent_owned = [s > 0 and bool(owned[p]) for s, p in zip(rows, above)]
    return pa.table(
        {
            "shard": pa.array([shard] * len(rows), pa.int64()),
            "owned": pa.array(mine),
            "address": pa.array([addresses.get(s) for s in rows], pa.binary()),
            "parent": pa.array([addresses.get(p) if s else None for s, p in zip(rows, above)], pa.binary()),
            "parent_conv_id": pa.array(
                [int(first_conv[p]) if known else None for p, known in zip(above, parent_owned)], pa.int64()
            ),
            "conv_id": pa.array(first_conv[used]),
            "depth": pa.array(depths[used], pa.int32()),
            "n_convs": pa.array(members[used]),
            "n_children": pa.array(np.where(owned, children, owned_children)[used]),
            "n_leaves": pa.array(leaves[used]),
            "saved_tokens": pa.array(saved[used]),
            "size": pa.array(size[used]),
            "ends_sha256": pa.array([ends_of.get(s) for s in rows], pa.string()),
        }
    )
