"""Every stage of the pipeline on its own input, against plain versions."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm import test_line_dedup, test_near_dedup

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from caseweave.llm.shared import written

    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), name)
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted((tuple(r) for r in df.select(*pipeline.COLUMNS).collect()), key=repr)


def test_stages_return_documents(stages, spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes


def test_language_stage(stages):
    before, after = stages["language_id"]
    assert rows(after) == [r for r in rows(before) if r[1] and any(c.isalpha() for c in r[1])]


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = test_line_dedup.plain([(r.doc_id, r.text, r.source) for r in before.collect()], 3, 4)
    assert [(r[0], r[1]) for r in rows(after)] == sorted(((d, t) for d, _, _, t in want), key=repr)
    assert all(r[4] == len(r[1]) for r in rows(after))


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    want = test_near_dedup.brute([(r.doc_id, r.text) for r in before.collect()], 5)
    keep = {d for d, _, _, kept in want if kept}
    assert rows(after) == [r for r in rows(before) if r[0] in keep] and len(keep) < before.count()


def test_benchmark_stage(stages, spark):
    before, after = stages["decontamination"]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = [r for r in rows(before) if not any(i in " ".join(r[1].split()) for i in items)]
    assert rows(after) == want


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r[0] for r in rows(before)}


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert sorted(n for n in names if n.startswith("op")) == sorted(
        f"op{k}_{n}" for k, n in enumerate(
            "toxicity quality_rules packing quality_classifier line_dedup pii near_dedup language_id decontamination sharding "
            "prefix_trie fingerprints spelling_variants".split(), 1
        )
    )
    assert names["pipeline"](spark, FOLDER).count() > 0


def test_odd_tables(spark, odd, none):
    for start in (odd.withColumn("n_chars", odd.doc_id), none):
        docs = start
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER).checkpoint()


def test_rows_without_an_id_and_repeated_rows(spark):
    """A benchmark copy without an id goes; of equal rows, and of copies without an id, one stays."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    a, b = "one two three four five six seven eight nine ten", "some other words stand in this row of the table here"
    c = "a third text that is found nowhere else in all of the rows"
    made = [(None, item), (None, a), (1, a), (1, a), (None, b), (None, b), (None, c), (2, "short of it")]
    docs = spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.decontaminate(spark, docs, FOLDER)
    assert rows(left) == sorted([(d, t, "en", "x", len(t)) for d, t in made[1:]], key=repr)
    want = [(1, a), (None, b), (None, c), (2, "short of it")]
    assert rows(pipeline.drop_near_duplicates(spark, left, FOLDER)) == sorted([(d, t, "en", "x", len(t)) for d, t in want], key=repr)
