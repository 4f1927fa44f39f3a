"""The trie of rebuilt conversations against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from caseweave.llm.prefix_trie import end_digests, prefix_trie, subtree_totals

SCHEMA = "conv_id long, turn int, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(x[0] for x in below) or 1 if below else 1, own + sum(x[1] for x in below))
    return sorted(((
        min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), *totals[n],
        hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
    ) for n in members), key=repr)


def found(conversations):
    return sorted((tuple(r) for r in prefix_trie(conversations).collect()), key=repr)


def test_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert found(table) == brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, p, "user", f"first {rng.randrange(2)}") for c in range(40) for p in range(rng.randrange(12))]
    rows += [(5, p, "user", "long") for p in range(150)] + [(5, 7, None, None)] * 30
    rows += [(None, 1, "user", "nobody's"), (77, None, "user", "x"), (77, None, "bot", "x"), (78, 0, "", ""), (81, 0, None, "é漢")]
    wide = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", key string, k int")
    assert found(wide) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


@pytest.mark.parametrize("seed", [0, 1])
def test_totals_of_any_tree(spark, seed):
    rng = random.Random(seed)
    # A chain with irregular depths and bushes on it.
    parent, depth, tip = {0: None}, {0: 0}, 0
    for v in range(1, 300):
        up = tip if rng.random() < 0.8 else rng.randrange(v)
        parent[v], depth[v] = up, depth[up] + rng.choice([1, 2, 4])
        tip = v if up == tip else tip
    kids = defaultdict(list)
    for v, up in parent.items():
        if up is not None:
            kids[up].append(v)
    want = {}
    for v in sorted(parent, reverse=True):
        want[v] = (int(not kids[v]) + sum(want[x][0] for x in kids[v]), v + sum(want[x][1] for x in kids[v]))
    rows = []
    for v, up in parent.items():
        x = y = 0
        for kid in kids[v]:
            x, y = x ^ kid, y ^ depth[kid]
        rows.append((v, depth[v], up, None if up is None else depth[up], len(kids[v]), x, y, int(not kids[v]), v))
    nodes = spark.createDataFrame(rows, "c long, d long, pc long, pd long, k long, kc long, kd long, leaves long, saved long")
    assert {r.c: (r.leaves, r.saved) for r in subtree_totals(nodes).collect()} == want


def test_digests_go_over_chunks(spark):
    ids = [5, 4096, 4095, 70_000, 9, -3]
    ends = spark.createDataFrame([("a", i) for i in ids] + [("b", 1)], "key string, c long")
    got = {r.key: r.ends_sha256 for r in end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in {"a": ids, "b": [1]}.items()}
