"""Features of an encounter move few rows: events meet few stays by key, and far edges are left out unshuffled."""

import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as gr, joins as jn
from caseweave.plans import sizes

STAYS = [(1, 10, 0, 5), (1, 11, 4, 9), (2, 20, 0, 300000), (3, 30, 7, 2), (4, 40, None, 8), (None, 50, 0, 9)]
EVENTS = [(k, n, at) for k in (1, 2, 3, 4, None) for n, at in enumerate((0, 4, 5, 9, 10, 299999, None))]


def tables(spark):
    events = spark.createDataFrame(EVENTS, "hadm_id int, id int, at int").withColumn("charttime", F.timestamp_seconds("at"))
    stays = spark.createDataFrame(STAYS, "hadm_id int, stay_id int, a int, b int").select(
        "hadm_id", "stay_id", F.timestamp_seconds("a").alias("intime"), F.timestamp_seconds("b").alias("outtime")
    )
    return events, stays


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return sorted((r.hadm_id, r.id, r.stay_id) for r in df.collect())


def test_events_meet_few_stays_by_key(spark, monkeypatch):
    events, stays = tables(spark)
    expected = sorted(
        (k, n, s) for k, n, at in EVENTS for k2, s, a, b in STAYS
        if None not in (k, at, a) and k == k2 and a <= at <= b
    )
    by_key = jn.in_interval(events, stays, "hadm_id")
    assert found(by_key) == expected
    # Neither multiplied nor dealt by anything but the key: a sum by key and event needs no further shuffle.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = plan(jn.in_interval(events, stays, "hadm_id").groupBy("hadm_id", "id").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate" not in sums and sums.count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(jn, "MOST_COMPARED", 1)
    in_cells = jn.in_interval(events, stays, "hadm_id")
    assert "Generate" in plan(in_cells) and found(in_cells) == expected


def test_busy_encounters_meet_stays_in_cells(spark, small_tasks):
    events, stays = tables(spark)
    many = events.where("hadm_id = 1").crossJoin(spark.range(10).select(F.col("id").alias("n")))
    assert "Generate" in plan(jn.in_interval(many, stays, "hadm_id"))


def test_hot_groups_are_seen_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(sizes, "BUCKETS", 2)
    spark.conf.set(sizes.ROWS_PER_TASK, "50")
    try:
        keys = spark.range(600).select((F.col("id") % 100).alias("k"), F.lit("x").alias("v"))
        assert not sizes.has_hot_group(keys, ["k"])
        assert sizes.has_hot_group(keys, ["k"], 5)
        assert sizes.has_hot_group(keys.unionByName(keys.where("k = 3").crossJoin(spark.range(9)).select("k", "v")), ["k"])
        assert sizes.has_hot_group(keys.withColumn("k", F.lit(None).cast("int")), ["k"])
    finally:
        spark.conf.unset(sizes.ROWS_PER_TASK)


@pytest.mark.parametrize("most", [64, 0])
def test_far_edges_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(gr, "MOST_KINDS", most)
    seen = []
    plain = gr.linked_pairs
    monkeypatch.setattr(gr, "linked_pairs", lambda edges: seen.append(edges.count()) or plain(edges))
    near = [("HA-1", "PA-1"), ("PA-1", "HA-1"), ("HA-1", "HA-2"), ("HA-2", "PA-1"), ("HA-1", "IS-1"), ("PA-1", "IS-1")]
    far = [(f"IS-{n}", f"ID-{n}-D{d}") for n in (1, 2) for d in range(5)]
    edges = spark.createDataFrame(near + far, "src string, dst string")
    seeds = spark.createDataFrame([("HA-1",), ("HA-2",), ("HA-9",), (None,)], "id string")
    rows = {r.seed: (r.n_nodes, r.n_edges, r.max_degree) for r in gr.subgraph_features(seeds, edges).collect()}
    assert rows["HA-1"] == (4, 6, 4) and rows["HA-2"] == (3, 4, 3) and rows["HA-9"] == (1, 0, 0)
    assert seen == ([5, 6] if most else [16, 16])


@pytest.mark.parametrize("missing", [0, 7])
def test_seeds_told_by_kind(spark, missing):
    """where all nodes of a kind are seeds, their neighbourhoods come without a join to the seeds; the same as one by one."""
    rng = random.Random(4)
    edges = [(f"HA-{rng.randrange(30)}", f"{rng.choice(['HA', 'PA', 'IS'])}-{rng.randrange(30)}") for _ in range(150)]
    edges += [(b, a) for a, b in edges[:60]] + [(f"IS-{rng.randrange(30)}", f"{rng.choice(['PA', 'ID'])}-{rng.randrange(30)}") for _ in range(90)]
    df = spark.createDataFrame([(a, "p", b) for a, b in edges], "src string, predicate string, dst string")
    seeds = spark.createDataFrame([(f"HA-{i}",) for i in range(missing, 32)], "id string")
    got = {r["seed"]: tuple(r) for r in gr.subgraph_features(seeds, df).collect()}
    once = {(a, b) for a, b in edges if a != b}
    assert len(got) == 32 - missing
    for seed, row in got.items():
        members = {seed} | {b for a, b in once if a == seed} | {a for a, b in once if b == seed}
        inside = [(a, b) for a, b in once if a in members and b in members]
        assert row[1:3] == (len(members), len(inside))
        degree = {m: sum((a == m) + (b == m) for a, b in inside) for m in members}
        assert row[5] == (max(degree.values()) if len(members) > 1 else 0)


def test_all_seeds_of_a_kind_take_fewer_shuffles(spark, monkeypatch):
    """the pairs are neither joined to the seeds nor to their neighbours; one table is written, not two."""
    written, keep = [], gr.materialise
    monkeypatch.setattr(gr, "materialise", lambda df: written.append(df) or keep(df))
    df = spark.createDataFrame([("HA-1", "p", "PA-1"), ("HA-2", "p", "PA-1")], "src string, predicate string, dst string")
    gr.subgraph_features(spark.createDataFrame([("HA-1",), ("HA-2",)], "id string"), df)
    assert len(written) == 1
