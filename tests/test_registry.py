"""The driver's entry points, and a sample of the SQL checks at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from caseweave.roles import BASE_TABLES
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "a1_event_mean", "a13_lab_summary", "c3_readmission_labels", "c5_head_injury_cohort",
    "f13_index_per_instant", "g9_typed_edges", "o2_score_features", "t4_relation_counts",
)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    frame = entry.queries()[name](spark, FOLDER)
    assert want and rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == want


def test_published_counts(spark, monkeypatch):
    """Queries without a SQL check of their own count draw as often, and boost as long, as published."""
    import inspect

    from caseweave.operators import causal, evaluation

    class Asked(Exception):
        pass

    def stop(f):
        def asked(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            raise Asked(bound.arguments.get("replicates", bound.arguments.get("rounds")))
        return asked

    for module, name in ((causal, "estimate"), (causal, "boosted_means"), (evaluation, "compare_areas"), (evaluation, "train_boosted")):
        monkeypatch.setattr(module, name, stop(getattr(module, name)))
    got = {}
    for name in ("e7_estimate", "e7_narrowed", "e7_estimate_binary", "e1_boosted_means", "m3_boosted", "m10_bootstrap_difference"):
        with pytest.raises(Asked) as asked:
            entry.queries()[name](spark, "/root/testdata/sf0.001")
        got[name] = asked.value.args[0]
    assert list(got.values()) == [200, 200, 200, 200, 100, 1000]
