"""Shuffle partitions follow the input; edges of events come from one pass."""

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph as gr
from caseweave.plans import sizes
from caseweave.roles import Tables

LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


@pytest.fixture
def settings(spark):
    names = [sizes.ADVISORY, sizes.INITIAL_PARTITIONS, LEAST]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.unset(n)
    yield spark
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def _tables(spark, tmp_path):
    spark.range(5000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")
    ).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    return Tables(spark, str(tmp_path))


def test_partitions_follow_the_input(settings, tmp_path, monkeypatch):
    monkeypatch.setattr(sizes, "TASK_BYTES", 2000)
    monkeypatch.setattr(sizes, "INPUT_BYTES_PER_PARTITION", 1000)
    settings.conf.set(LEAST, "1k")
    counts = _tables(settings, tmp_path).orders.groupBy("o_orderkey").count()
    # Four shuffle partitions are set, and all rows would fit one task of 64 MB.
    assert counts.rdd.getNumPartitions() > 8
    assert counts.agg(F.sum("count")).first()[0] == 5000


def test_small_inputs_keep_the_partitions_of_the_session(settings, tmp_path):
    assert _tables(settings, tmp_path).orders.count() == 5000
    assert settings.conf.get(sizes.INITIAL_PARTITIONS) == "4"


@pytest.mark.parametrize(("given", "kept"), [("8m", 8 << 20), ("1k", 1 << 10), ("64MB", sizes.TASK_BYTES), ("1g", sizes.TASK_BYTES)])
def test_smaller_settings_stay(settings, given, kept):
    settings.conf.set(sizes.ADVISORY, given)
    sizes.deal_by_size(settings, 0)
    assert sizes._bytes(settings.conf.get(sizes.ADVISORY)) == kept


def test_event_edges_read_the_events_once(spark):
    events = spark.createDataFrame([("a", 1, 2), ("b", 1, None), ("c", None, 3)], "id string, stay_id bigint, day_number int")
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    edges = gr.event_edges(events.mapInPandas(look, events.schema))
    found = sorted(map(tuple, edges.collect()), key=str)
    assert seen.value == 3
    assert edges.columns == ["src", "predicate", "dst"]
    stay, day = gr.stay_node(), gr.day_node()
    names = {r["id"]: (r["s"], r["d"]) for r in events.select("id", stay.alias("s"), day.alias("d")).collect()}
    expected = []
    for event, (s, d) in names.items():
        expected += [(event, "associatedWithICUStay", s), (s, "hasICUStayEvent", event)]
        if event != "b":
            expected += [(event, "associatedWithICUDay", d), (d, "hasICUDayEvent", event)]
    assert found == sorted(expected, key=str)
