"""Periodic runs and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framegauge.llm import catalogue, prefix_trie, recompression

TEXTS = [
    None, "", " \n", "a", "a a a a a a", "x " + "ab cd " * 9 + "y", "a b " * 40 + "c " * 30 + "a b " * 40,
    "w " * 3_000, "á b\x0bc\x1cd " * 12, "no runs here at all",
]


def brute_runs(words):
    """By definition: each stretch that keeps period q, with the smallest period that keeps it."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        first = 0
        while first + q < len(words):
            last = first
            while last + q < len(words) and words[last] == words[last + q]:
                last += 1
            if last > first and last + q - first >= max(6, 4 * q):
                found.setdefault((first, last + q), q)
            first = last + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    repeated = {k for s, n, q in runs for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in repeated)
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests


@given(st.lists(st.lists(st.integers(0, 3), max_size=70), max_size=5), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_runs_by_definition(documents, period):
    documents = [*documents, *[(d[:period] * 8)[: 6 * period + k] for k, d in enumerate(documents)]]
    found = recompression.runs_of([np.array(d, dtype=np.int64) for d in documents])
    assert found == [brute_runs(d) for d in documents]


def test_grammar_answers_extensions():
    source = random.Random(4)
    symbols = np.array([source.randint(0, 1) for _ in range(300)] * 4 + [9] + [1] * 500 + [10])
    grammar = recompression.Grammar(symbols, 9)
    a, b = np.array([[source.randrange(len(symbols)) for _ in range(4_000)] for _ in range(2)])
    forwards, backwards = grammar.extend(a, b), grammar.extend(a, b, backwards=True)
    for at, other, after, before in zip(a.tolist(), b.tolist(), forwards.tolist(), backwards.tolist()):
        if at == other:
            assert (after, before) == (len(symbols) - at, at)
            continue
        n = 0
        while max(at, other) + n < len(symbols) and symbols[at + n] == symbols[other + n]:
            n += 1
        m = 0
        while min(at, other) - m > 0 and symbols[at - m - 1] == symbols[other - m - 1]:
            m += 1
        assert (after, before) == (n, m)


def test_small_query_bound_changes_nothing(monkeypatch):
    documents = [np.array([0, 1] * 50 + [2] * 40), np.array([3] * 200)]
    whole = recompression.runs_of(documents)
    monkeypatch.setattr(recompression, "QUERIES", 3)
    assert recompression.runs_of(documents) == whole == [[(0, 100, 2), (100, 40, 1)], [(0, 200, 1)]]


def test_document_runs(spark):
    rows = [(k, text, {"a": 1}, 5) for k, text in enumerate(TEXTS)] + [(4, TEXTS[5], None, 6), (None, TEXTS[5], None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs map<string,int>, id long")
    found = recompression.document_runs(docs, with_text=True).collect()
    got = sorted((str(r.id), [tuple(run) for run in r.runs], r.n_words, r.collapsed) for r in found)
    want = []
    for name, text, *_ in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words)
        repeated = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in repeated).decode()
        want.append((str(name), runs, len(words), kept))
    assert got == sorted(want)
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in found)
    assert recompression.document_runs(docs.where("false")).count() == 0


def test_periodic_runs_query(spark, sf_dir):
    rows = catalogue.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    found = {r.doc_id: tuple(r)[1:] for r in rows}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for r in documents:
        words = (r.text or "").encode().split()
        code, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if code % 10 == 0 and n:
            first = code // 10 % n
            period = 1 + (n - first) // (3 + code // 10 % 8)
            words = [words[k if k < first else first + (k - first) % period] for k in range(n)]
        assert found[r.doc_id] == brute_row(words)


# --- prefix trie -------------------------------------------------------------


def brute_nodes(paths):
    """Rows by definition from {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id, path in paths.items():
        ends[tuple(path)].append(conv_id)
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(conv_id)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(own) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node], leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, own in members.items()
    )


def node_rows(nodes):
    return sorted(
        (
            r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
            r.n_leaves, r.saved_tokens, r.ends_sha256,
        )
        for r in nodes.collect()
    )


def _random_conversations(seed):
    source = random.Random(seed)
    paths = {}
    for conv_id in range(-20, 160):
        base = [("s", "shared")] * source.choice([0, 1, 1, 5])
        paths[conv_id] = base + [
            (source.choice("uä"), "t" * source.randint(0, 2)) for _ in range(source.randint(0, 4))
        ]
    paths[500] = [("u", str(k % 7)) for k in range(300)]
    paths[501] = paths[500][:290]
    return {k: p for k, p in paths.items() if p}


@pytest.mark.parametrize("unit, shard", [(10_000, 40_000), (15, 40), (1, 1)])
def test_prefix_nodes_by_definition(spark, unit, shard):
    paths = _random_conversations(unit)
    rows = [(c, k, *turn, "x") for c, path in paths.items() for k, turn in enumerate(path)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    found = prefix_trie.prefix_nodes(prefix_trie.turn_paths(turns), unit, shard)
    assert node_rows(found) == brute_nodes(paths)


def test_odd_turns(spark):
    rows = [
        (1, None, None, None, {1: 2}), (1, 0, "u", "é", None), (1, 0, "u", "é", None), (2, 5, "", "", None),
        (2, 9, "u", "é", None), (None, 0, "u", "lost", None), (3, 1, "u", "long " * 4_000, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path map<int,int>")
    found = node_rows(prefix_trie.prefix_nodes(prefix_trie.turn_paths(turns)))
    assert found == brute_nodes(
        {1: [("", ""), ("u", "é"), ("u", "é")], 2: [("", ""), ("u", "é")], 3: [("u", "long " * 4_000)]}
    )
    assert prefix_trie.prefix_nodes(prefix_trie.turn_paths(turns.where("false"))).count() == 0
    turnless = spark.createDataFrame([(8, []), (5, [])], "conv_id long, path array<struct<key:binary,size:int>>")
    assert node_rows(prefix_trie.prefix_nodes(turnless)) == brute_nodes({8: [], 5: []})


def test_member_digests_cross_chunks(spark, monkeypatch):
    members = spark.range(20_000).selectExpr("if(id % 3 = 0, 'a', 'b') as address", "id * 7 - 5 as conv_id")
    found = {r.address: r.ends for r in prefix_trie.member_digests(members).collect()}
    for name in "ab":
        ids = [str(k * 7 - 5) for k in range(20_000) if (k % 3 == 0) == (name == "a")]
        assert found[name] == hashlib.sha256(",".join(ids).encode()).hexdigest()


@given(st.lists(st.lists(st.integers(0, 6), max_size=6), max_size=30))
@settings(max_examples=100, deadline=None)
def test_double_array_follows_the_trie(paths):
    lengths = np.array([len(p) for p in paths], dtype=np.int64)
    turns = np.array([c for p in paths for c in p], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    trie, turns = prefix_trie._trie(starts, lengths, turns)
    seen = {}
    for path, start, length in zip(paths, starts.tolist(), lengths.tolist()):
        state = np.array([0])
        for k in range(length):
            state = trie.follow(state, turns[start + k : start + k + 1])
            assert state[0] > 0
            assert seen.setdefault(int(state[0]), tuple(path[: k + 1])) == tuple(path[: k + 1])
    assert len(set(seen.values())) == len(seen)
    absent = int(turns.max()) + 1 if len(turns) else 0
    assert trie.follow(np.array([0]), np.array([absent])).tolist() == [-1]
