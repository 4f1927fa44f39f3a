"""Pieces against the tokenizer itself: an exact round trip."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caseweave.llm.packing import Encoder, hilbert_keys, pack_documents
from caseweave.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check(rows, texts, tokenizer, length):
    """``texts``: (id, text) of every row."""
    want = Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[(doc, tuple(ids))] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    by = defaultdict(list)
    for r in rows:
        by[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    for (doc, ids), copies in want.items():
        data = np.array(ids, dtype="<u4")
        own = [p for p in by[(doc, len(ids))] if zlib.crc32(data[p[0] : p[0] + p[1]].tobytes()) == p[2]]
        for i in range(len(ids)):
            assert sum(s <= i < s + n for s, n, _ in own) >= copies
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("length, ranges", [(2048, 1), (2048, 5), (64, 3)])
def test_round_trip(documents, tokenizer, length, ranges):
    texts = [(r.doc_id, r.text) for r in documents.collect()][:60]
    docs = documents.where(documents.doc_id.isin([d for d, _ in texts]))
    check(pack_documents(docs, tokenizer_path(), length, ranges=ranges).collect(), texts, tokenizer, length)


def test_odd_rows(odd, none, tokenizer):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(pack_documents(odd, tokenizer_path(), ranges=3).collect(), rows, tokenizer, 2048)
    assert pack_documents(none, tokenizer_path()).count() == 0


def test_encoder_on_hard_texts(tokenizer):
    texts = [
        "It's  we'LL a\tb c Ünḯ ΣΑΣ İx '’s 12³½ <|endoftext|> x<|STARTOFTEXT|>y \x1cq\x85r ﬁ 漢字,かな 👍🏽 é",
        "", None, "a\r\nb\n\n c", "don't can't they're", " x", "####$$$ !!!a1b2", "ª º µ ²³¹¼", "ẞ ſ ŉ ǅ",
    ]
    for size in (1, 100):
        encode = Encoder(tokenizer_path())
        found = []
        for at in range(0, len(texts), size):
            found += [x.tolist() for x in encode(pa.array(texts[at : at + size], pa.string()))]
        assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_the_curve_visits_every_cell_by_single_steps():
    bits, dimensions = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_words_of_two_letters_keep_their_ids(spark, tokenizer):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, f"x {word}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(pack_documents(docs, tokenizer_path(), ranges=1).collect(), rows, tokenizer, 2048)
