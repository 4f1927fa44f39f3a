"""Shards and slots against a plain Python version."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from caseweave.llm.sharding import assign_shards


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def best(key, weights):
    return max(range(len(weights)), key=lambda s: (weights[s] / -math.log((draw(key, s) + 0.5) / 2**52), -s))


def plain(rows, weights, added):
    by, out = defaultdict(list), Counter()
    for doc, text in rows:
        data = (text or "").encode()
        key = "null" if doc is None else str(doc)
        by[best(key, weights)].append((draw(key, len(data) + 1, zlib.crc32(data)), key, len(data) + 1, zlib.crc32(data), doc))
    for shard, found in by.items():
        for slot, (_, key, size, crc, doc) in enumerate(sorted(found, key=lambda x: x[:4])):
            out[(doc, size, crc, "key", shard, slot, best(key, [*weights, added]))] += 1
    return out


def got(df):
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return Counter(tuple(r) for r in df.collect())


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(assign_shards(documents)) == plain(rows, [1.0] * 8, 1.0)
    assert got(assign_shards(documents, rows_per_slice=1)) == plain(rows, [1.0] * 8, 1.0)


def test_a_new_shard_only_gains(documents):
    rows = assign_shards(documents).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 8 for r in moved) and len(moved) < len(rows) / 4


def test_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    found = Counter(r.shard for r in assign_shards(docs, weights=[1.0, 3.0]).collect())
    assert 0.7 < found[1] / 4000 < 0.8


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(assign_shards(odd)) == plain(rows, [1.0] * 8, 1.0)
    assert assign_shards(none).count() == 0
