"""Events of stays: met by the encounter alone where stays are plain, on the time line otherwise."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as gr
from caseweave.operators.joins import assign_stay
from caseweave.operators.temporal import with_day

START = datetime(2150, 1, 1)
STAYS = "stay_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz"
LABS = "hadm_id long, itemid int, charttime timestamp_ntz, valuenum double, valueuom string"


def hours(n):
    return None if n is None else START + timedelta(hours=n)


def tables(spark, odd):
    draw = Random(7)
    stays = []
    for h in range(40):
        for k in range(draw.randint(0, 3)):
            a = draw.randint(0, 100)
            end = draw.choice([None, a - 2, a, a + draw.randint(1, 90)])
            stays.append((10 * h + k, h, hours(a), hours(end)))
    stays += [(None, 3, hours(1), hours(50)), (900, None, hours(1), hours(50)), (901, 4, None, hours(50))]
    if odd == "twice":
        stays += stays[:20]
    elif odd == "moved":
        stays += [(s, h + 1, a, b) for s, h, a, b in stays[:20] if h is not None]
    labs = [
        (draw.choice([None, *range(42)]), draw.choice([1, 2, 3, None]), hours(draw.choice([None, *range(-2, 200)])),
         draw.choice([None, 1.0, 2.0, 3.0]), draw.choice([None, "a", "b"]))
        for _ in range(1500)
    ]
    items = spark.createDataFrame([(1, "one"), (2, "two"), (2, "deux"), (9, "nine")], "itemid int, label string")
    return spark.createDataFrame(stays, STAYS), spark.createDataFrame(labs + labs[:100], LABS), items


@pytest.mark.parametrize("odd", ["", "twice", "moved"])
def test_lab_nodes_are_those_of_the_time_line(spark, odd):
    stays, labs, items = tables(spark, odd)
    assert gr.plain_stays(stays) == (not odd)
    placed = with_day(assign_stay(labs.where("valuenum IS NOT NULL").join(items, "itemid"), stays), stays)
    want = {}
    for r in placed.withColumn("stamp", gr.stamp(F.col("charttime"))).collect():
        key = f"BME-{r['stay_id']}-{r['itemid']}-{r['stamp']}"
        row = tuple((v is not None, v) for v in (
            r["hadm_id"], r["stay_id"], r["day_number"], r["label"], r["charttime"], r["valuenum"], r["valueuom"]))
        want[key] = min(row, want.get(key, row))
    got = gr.lab_nodes(labs, items, stays).collect()
    assert len(got) == len(want) > 200
    for r in got:
        fields = ("hadm_id", "stay_id", "day_number", "name", "start_ts", "value", "unit")
        assert tuple((r[c] is not None, r[c]) for c in fields) == want[r["id"]]
        assert (r["type"], r["end_ts"], r["concept_key"]) == ("lab", r["start_ts"], r["id"].split("-")[2])


@pytest.fixture
def sorted_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_events_of_plain_stays_are_shuffled_once(spark, sorted_joins, tmp_path):
    """A reading is dealt by its encounter, and not again by its stay and its id."""
    stays, labs, items = tables(spark, "")
    labs.repartition(3).write.parquet(str(tmp_path / "labs"))
    stays.write.parquet(str(tmp_path / "stays"))
    labs, stays = spark.read.parquet(str(tmp_path / "labs")), spark.read.parquet(str(tmp_path / "stays"))
    named = items.join(labs.where("valuenum IS NOT NULL"), "itemid")
    # Labs and items by item, then labs and stays by encounter.
    assert exchanges(named) == 2 and exchanges(gr.lab_nodes(labs, items, stays)) == 4
    charts = labs.withColumn("stay_id", F.col("hadm_id") * 10)
    assert exchanges(gr.vital_nodes(charts, items, stays)) == 4


def test_titles_of_diagnoses(spark):
    """The least code of a place, with its least title; a code without a title stays."""
    rows = [(1, 1, "B", 10), (1, 1, "A", 10), (1, 2, "C", 9), (1, None, "B", 10), (2, 1, None, 10)]
    titles = [("A", 10, "second"), ("A", 10, "first"), ("B", 10, None), ("B", 10, "named"), ("C", 10, "other version")]
    nodes = gr.diagnosis_nodes(
        spark.createDataFrame(rows, "hadm_id long, seq_num int, icd_code string, icd_version int"),
        spark.createDataFrame(titles, "icd_code string, icd_version int, long_title string"),
    )
    assert {(r["hadm_id"], r["seq_num"], r["icd_code"], r["long_title"]) for r in nodes.collect()} == {
        (1, 1, "A", "first"), (1, 2, "C", None), (1, None, "B", None), (2, 1, None, None),
    }
