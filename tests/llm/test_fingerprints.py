"""Fingerprints against a plain computation, and their estimates against exact likeness."""

import hashlib
import re

from pyspark.sql import functions as F

from caseweave.llm.fingerprints import BINS, PROBES, fingerprint_documents, likeness, with_fingerprint


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if 0 < len(words) < 5:
        return {" ".join(words)}
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(text):
    values = [None] * BINS
    for h in sorted(map(md5, shingles(text)), reverse=True):
        values[int(h[:2], 16)] = h
    filled = [b for b, v in enumerate(values) if v]
    if not filled:
        return ""
    out = ""
    for i, v in enumerate(values):
        if v is None:
            asked = [int(md5(f"{i}:{t}")[:2], 16) for t in range(PROBES)]
            donor = next((b for b in asked if values[b]), None)
            if donor is None:
                donor = min(filled, key=lambda b: md5(f"{i}/{b}"))
            v = md5(f"{values[donor]}:{i}")
        out += v[-1]
    return out


def near(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) - 16) / 240)


def brute(rows):
    """Rows with distinct (id, text); null ids last."""
    def key(r):
        return hashlib.sha256((("?" if r[0] is None else f"={r[0]}") + ":" + (r[1] or "")).encode()).digest()

    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, key(r)), reverse=True)
    out = {}
    for (d, text), (_, other) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, e, n = plain(text), plain(edited), plain(other)
        out[(d, text)] = (d, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, near(a, e), near(a, n))
    return sorted((out[(r[0], r[1] or "")] for r in rows), key=repr)


def found(docs):
    return sorted((tuple(r) for r in fingerprint_documents(docs).collect()), key=repr)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()][:40]
    assert found(documents.where(documents.doc_id.isin([r[0] for r in rows]))) == brute(rows)


def test_odd_rows(odd, none):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []
    assert found(odd.where("doc_id = 8")) == brute([(8, "x")])


def test_estimates(spark):
    base = [f"w{i}" for i in range(600)]
    pairs = [(n, " ".join(base), " ".join(base[: 600 - n] + [f"x{i}" for i in range(n)])) for n in (0, 60, 200, 400, 600)]
    short = [(-k, " ".join(base[:k]), " ".join(base[300 : 300 + k])) for k in (1, 3, 6, 20)]
    rows = spark.createDataFrame(pairs + short, "n int, a string, b string")
    rows = with_fingerprint(with_fingerprint(rows, "a", "fa"), "b", "fb").withColumn("near", likeness("fa", "fb"))
    for r in rows.select("n", "a", "b", "near", F.length("fa").alias("size")).collect():
        x, y = shingles(r.a), shingles(r.b)
        assert r.size == BINS and abs(r.near - len(x & y) / len(x | y)) < 0.17, r.n


def test_cuts_through_words(spark):
    """Shingles of the kept part are hashed once: cuts in and between words, few words, a sigma at the cut."""
    texts = [" ".join(f"W{i}ΑΣ" for i in range(n)) + "x" * (n % 4) + " " * (n % 3) for n in (0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 20, 60)]
    rows = [*enumerate(texts), (100, "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ"), (101, "a  \t" * 40), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)
