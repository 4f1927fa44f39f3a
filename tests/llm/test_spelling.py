"""Words, near words and roots against all pairs."""

import re
import zlib
from collections import Counter

import pytest

from caseweave.llm.spelling import group_spellings, roots


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damaged=97):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damaged == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, []
    around = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)] for w in counts}
    for w, others in around.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(around[w]), counts.get(forms[w])))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in group_spellings(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("damaged", [97, 5])
def test_documents(documents, damaged):
    rows = [(r.doc_id, r.text) for r in documents.collect()][:40]
    assert found(documents.where(documents.doc_id.isin([r[0] for r in rows])), damaged=damaged) == brute(rows, damaged)


def test_repeats_ties_and_long_words(spark, odd, none):
    long = "ab" * 100
    words = (
        ["hello"] * 12 + ["helo", "helllo", "hellos"] * 3 + ["hallo"] * 6 + ["hellö", "hella"] * 6 + ["aaaaa"] * 3 + ["aaaaaa"] * 7
        + [long] * 9 + [long + "a"] * 3 + [long[:-1] + "c"] * 4 + [long[1:]] * 4 + ["ÀÀÀÀÀ", "àÀÀÀÀ"] * 3 + ["x" * 5]
    )
    rows = [(i, f"1{w.upper() if i % 3 == 0 and w.isascii() else w}-") for i, w in enumerate(words)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []
    with pytest.raises(ValueError):
        group_spellings(none, factor=1)


def test_long_ways(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 20), (101, 20)], "rank long, form long")
    assert {r.rank: r.root for r in roots(links).collect()} == {**{i: 40 for i in range(40)}, 100: 40, 101: 40}
