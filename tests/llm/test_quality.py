"""Text statistics against plain Python, and both quality operators on labelled rows."""

import re
import zlib

from pyspark.sql import functions as F

from caseweave.llm import quality_rules as rules
from caseweave.llm.quality_classifier import score_quality
from caseweave.llm.statistics import with_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 500 else _twice(windows)
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def _twice(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def statistics(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [(r.text, tuple(r[n] for n in names)) for r in with_statistics(df.select("text")).collect()]


def test_statistics(documents, odd, spark):
    more = spark.createDataFrame([(t,) for t in (
        "a b c a b c", "a b c d a b c", "a a a", "a a a a", "x y\nx y\n\nx y \n", "#*$%&|<>", "a b c x a b c x a b c",
    )], "text string")
    for df in (documents, odd, more):
        for text, found in statistics(df):
            assert found == plain(text), (text or "")[:80]


def test_rules_are_learned_and_applied(documents, labels, odd, odd_labels, none, no_labels, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = rules.judge_quality(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    for r in rules.judge_quality(documents, no_labels).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed) and r.rule is None
    assert rules.judge_quality(odd, odd_labels).count() == odd.count()
    assert rules.judge_quality(none, no_labels).count() == 0


def test_a_planted_conjunction_is_found(spark):
    """Bad rows are those with many symbols and few exclamation marks; one condition alone isn't enough."""
    rows = spark.range(3000).select(
        F.lit(100).cast("long").alias("n_words"), (F.col("id") * 7 % 100).alias("n_symbols"),
        (F.col("id") * 13 % 97).alias("n_exclaim"), (F.col("id") % 3 == 0).alias("pruning"),
        *[F.lit(1).cast("long").alias(c) for c in rules.COUNTS if c not in ("n_words", "n_symbols", "n_exclaim")],
    ).withColumn("bad", ((F.col("n_symbols") > 60) & (F.col("n_exclaim") < 40)).cast("int"))
    found = rules.learn_rules(rows, cuts=100)
    assert found and {c.feature for c in found[0]} == {"symbols", "exclaims"}
    judged = rows.withColumn("rule", rules.verdict(found))
    assert judged.where("bad = 1 AND rule IS NULL").count() <= 30
    assert judged.where("bad = 0 AND rule IS NOT NULL").count() <= 30


def test_classifier(labels, odd, odd_labels, none, no_labels, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)
    for docs_, labels_ in ((odd, odd_labels), (odd, no_labels), (none, no_labels)):
        rows = score_quality(docs_, labels_).collect()
        assert len(rows) == docs_.count() and all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_read(labels, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")
    ).otherwise(F.col("quality")))
    one = {r.doc_id: round(r.score, 9) for r in score_quality(docs, labels).collect()}
    assert one == {r.doc_id: round(r.score, 9) for r in score_quality(docs, turned).collect()}
