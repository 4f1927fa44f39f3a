"""J8 on events that come out of a join by encounter."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseweave.operators.joins import assign_stay


def test_time_line_is_dealt_after_the_union(spark):
    """Events and stays that are both dealt by encounter already: the window reads an exchange of its own, not their union."""
    start = datetime(2150, 1, 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.createDataFrame(
            [(h, n, start + timedelta(hours=n)) for h in range(30) for n in range(6)], "hadm_id long, n int, charttime timestamp_ntz"
        ).join(spark.range(30).withColumnRenamed("id", "hadm_id"), "hadm_id")
        stays = spark.createDataFrame(
            [(h, 2 * h + i, start + timedelta(hours=3 * i), start + timedelta(hours=3 * i + 2)) for h in range(30) for i in range(2)],
            "hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz",
        )
        found = assign_stay(events.groupBy("hadm_id", "n").agg(F.max("charttime").alias("charttime")), stays)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        window = next(i for i, line in enumerate(plan) if "Window" in line)
        union = next(i for i, line in enumerate(plan) if "Union" in line and i > window)
        assert any("Exchange" in line for line in plan[window:union])
        assert found.columns == ["hadm_id", "n", "charttime", "stay_id"]
        got = {(r["hadm_id"], r["n"]): r["stay_id"] for r in found.collect()}
        assert got == {(h, n): 2 * h + n // 3 for h in range(30) for n in range(6)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
