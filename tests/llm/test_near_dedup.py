"""Components against all pairs by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import near_dedup
from caseweave.llm.hashing import WHITE, shingle_sets, split_words
from caseweave.llm.near_dedup import SKETCH_BITS, Sketches, link_near_duplicates, may_reach, odd_sketches


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent=80):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return sorted(
        ((d, len(s), find(d) if s else d, (find(d) if s else d) == d) for d, s in sets), key=repr
    )


def found(docs, k):
    out = link_near_duplicates(docs, k)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_documents(documents, k):
    assert found(documents, k) == brute([(r.doc_id, r.text) for r in documents.collect()], k)


def family(rng, n, edits, words=120, first=0):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(copy)))
    return out


def test_families_around_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    rows = family(rng, 150, 9) + family(rng, 40, 5, 40, 1000) + family(rng, 30, 20, 400, 2000)
    # A chain: each member is near the next only.
    words = [f"c{i}" for i in range(60)]
    for i in range(25):
        words = words[4:] + [f"c{100 * i + j}" for j in range(4)]
        rows.append((3000 + i, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, 4) == brute(rows, 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    assert found(docs, 4) == brute(rows, 4)


def test_odd_rows(odd, none, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = found(odd, 4)
    want = brute([r for r in rows if r[0] not in (5, 6, None)], 4)
    assert [r for r in got if r[0] not in (5, 6, None)] == want
    # Ids 5 and 6 have the same text; 6 has another one, too.
    assert sorted(r for r in got if r[0] in (5, 6)) == [(5, 2, 5, True)] * 2 + [(6, 2, 5, False), (6, 2, 6, True)]
    assert [r for r in got if r[0] is None] == [(None, 2, None, True)]
    assert found(none, 4) == []


def sketches(sets):
    rows = [odd_sketches(s) for s in sets]
    bits = lambda k: np.stack([np.frombuffer(r[k] or bytes(SKETCH_BITS // 8), np.uint64) for r in rows])
    return Sketches(
        np.array([len(s) for s in sets]), bits(0), bits(1), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    )


def pairs_at(similarity, n, count, seed):
    """Pairs of sets with a union of ``n`` and at least that similarity."""
    rng, left_sets, right_sets = np.random.default_rng(seed), [], []
    for _ in range(count):
        union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        order = rng.permutation(len(union))
        common = int(np.ceil(similarity * len(union)))
        cut = common + rng.integers(0, len(union) - common + 1)
        both, left, right = (union[order[a:b]] for a, b in ((0, common), (common, cut), (cut, len(union))))
        left_sets.append(np.sort(np.concatenate([both, left])))
        right_sets.append(np.sort(np.concatenate([both, right])))
    return sketches(left_sets), sketches(right_sets)


@pytest.mark.parametrize("n", [1, 3, 8, 20, 60, 170, 500, 1000, 1150, 1250, 1500, 3000, 9000])
def test_the_filter_loses_no_pair(n):
    """Sketches of pairs at the threshold, short and long."""
    assert may_reach(*pairs_at(0.8, n, 300 if n < 1000 else 100, n), 0.8).all()


@pytest.mark.parametrize("n, similarity", [(170, 0.72), (500, 0.74), (1100, 0.74), (3000, 0.7)])
def test_the_filter_is_sharp(n, similarity):
    assert may_reach(*pairs_at(similarity, n, 100, n), 0.8).mean() < 0.1


def test_sizes_in_between_have_a_sketch_in_common():
    for n in (959, 960, 1199, 1200, 1201, 1500):
        m = int(np.ceil(0.8 * n))
        rng = np.random.default_rng(n)
        union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert may_reach(sketches([union]), sketches([union[: max(m, 1)]]), 0.8)[0] == (len(union[:m]) >= 0.8 * len(union))


def test_shingle_hashes_match_sets():
    texts = ["A b C d", "a B c d e", "a b", "", "x y z w x y z w"]
    words = next(split_words(pa.array(texts), WHITE, lower=True))
    assert [len(s) for s in shingle_sets(words, 4)] == [len(shingles(t, 4)) for t in texts]


def twins(letters=1024):
    """Two words that every polynomial modulo 2**64 takes for one: a Thue-Morse word and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 4096])
def test_words_of_two_letters_stay_apart(spark, letters):
    a, b = twins(letters)
    docs = spark.createDataFrame([(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, a), (4, b)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id, r.kept) for r in link_near_duplicates(docs, 5).orderBy("doc_id").collect()] == [
        (i, i, True) for i in (1, 2, 3, 4)
    ]
