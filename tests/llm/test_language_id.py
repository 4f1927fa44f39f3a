import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseweave.llm.language_id import Profiles, identify, identify_languages, most_frequent, text_grams


def test_grams_of_a_text():
    assert len(text_grams("")) == len(text_grams(None)) == len(text_grams("12 !?")) == 0
    assert Counter(text_grams("Ab, ab").tolist()) == Counter(text_grams("ab ab").tolist())
    # a b, _a ab b_, _ab ab_
    assert len(text_grams("ab")) == 7 and len(set(text_grams("ab").tolist())) == 7


def test_order_of_equal_counts():
    assert most_frequent(np.array([5, 3, 9, 3, 9, 7], np.uint32), 3).tolist() == [3, 9, 5]


def test_distance_by_hand():
    profiles = Profiles(("x", "y"), np.array([1, 2, 3], np.uint32), np.array([[0, 3], [1, 0], [3, 1]]), 3)
    # Gram 2 first, gram 9 (in no profile) second.
    assert np.allclose(profiles.distances(np.array([2, 9], np.uint32)), [(1 + 3) / 6, (0 + 3) / 6])


def test_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify_languages(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    found = identify_languages(odd).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    empty = [r for r in found if r.doc_id in (1, 2, 3, 7, 9)]
    assert empty and all(r.lang_pred == "und" and r.score == 0 for r in empty)
    assert identify_languages(none).count() == 0


def test_nothing_learned():
    assert identify("text", Profiles(("a",), np.array([1], np.uint32), np.array([[0]]), 3))[0] == "a"


def test_letters_of_large_scripts_are_told_apart():
    """Two Han letters, and a Han and a Hangul letter, 266 code points apart, are different n-grams."""
    from caseweave.llm.language_id import text_grams

    for a, b in ((0x4E00, 0x4E00 + 266), (0x4E00, 0x4E00 + 266 * 100)):
        one, other = (set(text_grams(chr(x)).tolist()) for x in (a, b))
        assert len(one) == 3 and not one & other


def test_clashing_columns_give_way(odd):
    wide = odd.withColumns({c: F.lit("own") for c in ("held_out", "lang_pred", "_whole")})
    rows = identify_languages(wide, keep_rows=True)
    assert rows.columns.count("score") == 1 and dict(rows.dtypes)["score"] == "double"
    assert dict(rows.dtypes)["held_out"] == "boolean" and rows.count() == odd.count()
