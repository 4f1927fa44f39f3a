import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as gr, joins as jn


def test_neighbourhoods_with_a_hub(spark):
    rng = random.Random(8)
    edges = {(0, i) for i in range(1, 40)} | {(rng.randrange(40), rng.randrange(40)) for _ in range(120)}
    edges = {(a, b) for a, b in edges if a != b}
    df = spark.createDataFrame(sorted((f"n{a:02}", "p", f"n{b:02}") for a, b in edges), "src string, predicate string, dst string")
    seeds = spark.createDataFrame([(f"n{i:02}",) for i in range(41)], "id string")
    got = {r["seed"]: r for r in gr.subgraph_features(seeds, df).collect()}
    for s in range(41):
        members = {s} | {b for a, b in edges if a == s} | {a for a, b in edges if b == s}
        inside = [(a, b) for a, b in edges if a in members and b in members]
        degree = {m: sum((a == m) + (b == m) for a, b in inside) for m in members}
        row = got[f"n{s:02}"]
        assert (row["n_nodes"], row["n_edges"]) == (len(members), len(inside))
        assert row["max_degree"] == (max(degree.values()) if len(members) > 1 else 0)
        if len(members) > 1:
            assert row["density"] == pytest.approx(len(inside) / (len(members) * (len(members) - 1)))
            assert row["mean_degree"] == pytest.approx(sum(degree.values()) / len(members))


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_wider_neighbourhoods(spark, hops):
    """A hub, links both ways, loops, repeated edges, seeds without links or named twice, against a plain search."""
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 15)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    edges += [(7, 0), (70, 71), (71, 70), (72, 72)] + edges[:5]
    df = spark.createDataFrame([(f"n{a:02}", "p", f"n{b:02}") for a, b in edges], "src string, predicate string, dst string")
    seeds = spark.createDataFrame([(f"n{i:02}",) for i in [*range(75), 3]] + [(None,)], "id string")
    got = {r["seed"]: r for r in gr.wider_subgraph_features(seeds, df, hops).collect()}
    assert len(got) == 75
    once = {(a, b) for a, b in edges if a != b}
    for s in range(75):
        members = {s}
        for _ in range(hops):
            members |= {b for a, b in once if a in members} | {a for a, b in once if b in members}
        inside = [(a, b) for a, b in once if a in members and b in members]
        degree = [sum((a == m) + (b == m) for a, b in inside) for m in members]
        row = got[f"n{s:02}"]
        assert (row["n_nodes"], row["n_edges"], row["max_degree"]) == (len(members), len(inside), max(degree))
        possible = len(members) * (len(members) - 1)
        assert row["density"] == pytest.approx(len(inside) / possible if possible else 0.0)
        assert row["mean_degree"] == pytest.approx(sum(degree) / len(members))


def test_hops_are_capped_by_id(spark):
    rows = [("a", "r", "b", "s1", f"h{i}", float(i)) for i in (3, 1, 2)] + [
        ("b", "q", "c", f"h{i}", f"x{j}", None) for i in (1, 2, 3) for j in (9, 7, 8)
    ]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src_id string, dst_id string, delta_days double")
    seeds = spark.createDataFrame([("s1",)], "id string")
    got = gr.hop_neighbours(seeds, edges, [("a", "r", "b"), ("b", "q", "c")], 2).collect()
    assert sorted((r["hop"], r["node"]) for r in got) == [(1, "h1"), (1, "h2"), (2, "x7"), (2, "x8")]


def test_chains_average_the_last_time(spark):
    rows = [("a", "r", "b", "s", m, None) for m in ("m1", "m2")] + [
        ("b", "q", "c", "m1", "z", 1.0), ("b", "q", "c", "m1", "z", 3.0), ("b", "q", "c", "m2", "z", 8.0),
    ]
    edges = spark.createDataFrame(rows, "src_type string, rel string, dst_type string, src_id string, dst_id string, delta_days double")
    row = gr.chain_edges(edges, [("a", "r", "b"), ("b", "q", "c")], "short").first()
    assert (row["src_id"], row["dst_id"], row["rel"], row["delta_days"]) == ("s", "z", "short", 4.0)


@pytest.mark.parametrize("limit", ["100000", "10"])
def test_means_up_to_a_date(spark, limit):
    spark.conf.set("caseweave.rowsPerTask", limit)
    rng = random.Random(6)
    readings = [(1 if i % 3 else 2, date(2150, 1, 1 + rng.randrange(25)), str(i) if i % 7 else "n/a") for i in range(60)]
    visits = [(i, 1 + i % 2, datetime(2150, 1, 1 + i, 13)) for i in range(25)]
    base = spark.createDataFrame(visits, "hadm_id long, subject_id long, admittime timestamp_ntz")
    measures = spark.createDataFrame(readings, "subject_id long, chartdate date, result_value string")
    out = jn.mean_until(base, measures, "subject_id", "admittime", "chartdate",
                        F.col("result_value").try_cast("double"), "hadm_id", "bmi")
    got = {r["hadm_id"]: r["bmi"] for r in out.collect()}
    spark.conf.unset("caseweave.rowsPerTask")
    for hadm, subject, at in visits:
        known = [float(v) for s, d, v in readings if s == subject and d <= at.date() and v != "n/a"]
        assert got.get(hadm) == (pytest.approx(sum(known) / len(known)) if known else None)


def test_typed_edges_of_every_kind(spark):
    """Events without a concept keep a key of their own; short concept ids do not count."""
    frame = spark.createDataFrame
    encounters = frame([(1, 5, "2020-01-01 00:00:00", "2020-01-09 00:00:00")], "hadm_id long, subject_id long, a string, d string").select(
        "hadm_id", "subject_id", F.col("a").cast("timestamp").alias("admittime"), F.col("d").cast("timestamp").alias("dischtime")
    )
    at = F.lit("2020-01-02 12:00:00").cast("timestamp")
    stays = encounters.select(
        F.lit(7).cast("long").alias("stay_id"), "hadm_id", "subject_id",
        F.lit("2020-01-02 00:00:00").cast("timestamp").alias("intime"), F.lit("2020-01-03 00:00:00").cast("timestamp").alias("outtime"),
    )
    items = frame([(1, "Sodium"), (2, "Odd")], "itemid int, label string")
    readings = items.select(
        F.lit(1).cast("long").alias("hadm_id"), F.lit(7).cast("long").alias("stay_id"), "itemid", at.alias("charttime"),
        F.lit(3.0).alias("valuenum"), F.lit("u").alias("valueuom"),
    )
    cultures = frame([("a", 1, "BLOOD", "ESCHERICHIA COLI"), ("b", 1, "BLOOD", None)], "microevent_id string, hadm_id long, spec_type_desc string, org_name string").withColumn("charttime", at)
    drugs = frame([(1, "Vancomycin 1 g", 1.0, "g", "IV"), (1, "Unheard", 1.0, "g", "IV")], "hadm_id long, drug string, dose_val_rx double, dose_unit_rx string, route string").withColumns({"starttime": at, "stoptime": at})
    codes = frame([(1, 1, "I639", 10), (1, 2, "430", 9)], "hadm_id long, seq_num int, icd_code string, icd_version int")
    titles = codes.select("icd_code", "icd_version", F.lit("t").alias("long_title"))
    none = frame([], "category string, weight int, prefix string")
    record = gr.Record(
        frame([(5,)], "subject_id long"), encounters, stays, readings.drop("stay_id"), items, readings, items, drugs, codes, titles, cultures, none
    )
    table = lambda key, rows, kind: frame(rows, f"{key} {kind}, concept_id string, term string")
    concepts = gr.Concepts(
        table("itemid", [(1, "104934005", "Sodium")], "int"), table("itemid", [(1, "12", "short"), (2, "6797001", "x")], "int"),
        table("org_name", [("ESCHERICHIA COLI", "112283007", "E")], "string"), table("name", [("vancomycin", "372735009", "V")], "string"),
        table("code", [("I639", "432504007", "C")], "string"),
    )
    edges = gr.typed_edges(record, concepts).where("rel IN ('has_event', 'has_diagnosis')").collect()
    assert {(r.src_id, r.dst_type, r.dst_id, r.delta_days) for r in edges} == {
        ("ID-7-D1", "lab", "104934005", 1.5), ("ID-7-D1", "lab", "unmapped:lab:2", 1.5),
        ("ID-7-D1", "vital", "unmapped:vital:1", 1.5), ("ID-7-D1", "vital", "6797001", 1.5),
        ("ID-7-D1", "microbiology", "112283007", 1.5), ("ID-7-D1", "microbiology", "unmapped:microbiology:None", 1.5),
        ("ID-7-D1", "drug", "372735009", 1.5), ("ID-7-D1", "drug", "unmapped:drug:unheard", 1.5),
        ("HA-1", "diagnosis", "432504007", None), ("HA-1", "diagnosis", "unmapped:diagnosis:430", None),
    }


@pytest.mark.parametrize("share", [4_000_000, 10])
def test_shared_entities_without_a_distinct_over_pairs(spark, monkeypatch, share):
    """Popular entities dealt over shares, repeated, null and foreign rows; no step groups the pairs."""
    monkeypatch.setattr(gr, "PAIRS_PER_TASK", share)
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(60)}", f"e{min(rng.randrange(12), rng.randrange(12))}") for _ in range(250)]
    rows += rows[:20] + [(None, "e0"), ("n1", None), ("n70", "own"), ("n71", None)]
    edges = spark.createDataFrame(rows, "src_id string, dst_id string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in (0, 1, 2, 2, 3, 70, 71, 99)] + [(None,)], "id string")
    held = {}
    for n, e in rows:
        if n and e:
            held.setdefault(n, set()).add(e)
    want = sorted((s, n) for s in ("n0", "n1", "n2", "n3", "n70") if s in held for n in held if n != s and held[s] & held[n])
    found = gr.shared_entity(seeds, edges)
    assert sorted((r["seed"], r["node"]) for r in found.collect()) == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert gr.shared_entity(seeds.where("id = 'n99'"), edges).collect() == []
