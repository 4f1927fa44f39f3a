"""Split plans give what a plain computation gives, with a third of rows in one key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.plans import ordered
from caseweave.plans.sizes import has_hot_group, take_bounded


def rows(n=600, seed=1):
    rng = random.Random(seed)
    return [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(150), i,
         None if rng.random() < 0.4 else float(rng.randrange(50)))
        for i in range(n)
    ]


@pytest.fixture(params=["plain", "split"])
def frame(request, spark):
    if request.param == "split":
        spark.conf.set("caseweave.rowsPerTask", "20")
    data = rows()
    yield spark.createDataFrame(data, "k string, t int, id int, v double"), data
    spark.conf.unset("caseweave.rowsPerTask")


def grouped(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_hot_group_is_seen(small_tasks):
    df = small_tasks.createDataFrame(rows(), "k string, t int, id int, v double")
    assert has_hot_group(df, ["k"])
    assert not has_hot_group(df, ["id"])


def test_neighbours(frame):
    df, data = frame
    got = {
        r["id"]: (r["nxt"], r["prev"])
        for r in ordered.neighbour(
            ordered.neighbour(df, ["k"], ["t", "id"], {"nxt": "id"}),
            ["k"], ["t", "id"], {"prev": "id"}, -1,
        ).collect()
    }
    for group in grouped(data).values():
        ids = [r[2] for r in group]
        for i, x in enumerate(ids):
            want = (ids[i + 1] if i + 1 < len(ids) else None, ids[i - 1] if i else None)
            assert got[x] == want


@pytest.mark.parametrize("how, inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running(frame, how, inclusive):
    df, data = frame
    got = {
        r["id"]: r["x"]
        for r in ordered.running(df, ["k"], ["t", "id"], {"x": "t"}, how, inclusive).collect()
    }
    fold = {"sum": sum, "max": max}[how]
    for group in grouped(data).values():
        for i, r in enumerate(group):
            seen = [g[1] for g in group[: i + 1 if inclusive else i]]
            assert got[r[2]] == (fold(seen) if seen else None)


@pytest.mark.parametrize("backward", [False, True])
def test_carried(frame, backward):
    df, data = frame
    got = {
        r["id"]: r["x"]
        for r in ordered.carried(df, ["k"], ["t", "id"], {"x": "v"}, backward).collect()
    }
    for group in grouped(data).values():
        line = list(reversed(group)) if backward else group
        last = None
        for r in line:
            last = last if r[3] is None else r[3]
            assert got[r[2]] == last


def test_percentiles_and_ranks(frame):
    df, data = frame
    marks = {"low": 0.01, "mid": 0.5, "high": 0.95}
    got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "v", marks).collect()}
    ranks = {
        r["k"]: r for r in ordered.value_at_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    }
    for key, group in grouped(data).items():
        values = sorted(r[3] for r in group if r[3] is not None)
        if not values:
            continue
        for name, p in marks.items():
            assert got[key][name] == pytest.approx(np.percentile(values, 100 * p))
        assert ranks[key]["p50"] == values[len(values) // 2]
        assert ranks[key]["p95"] == values[min(len(values) - 1, int(0.95 * len(values)))]


def test_percentiles_of_everything(frame):
    df, data = frame
    row = ordered.percentiles(df, [], "v", {"mid": 0.5}).first()
    assert row["mid"] == pytest.approx(np.median([r[3] for r in data if r[3] is not None]))


def test_most_common_prefers_the_smaller_value(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", "z")], "k string, v string")
    got = {r["k"]: r["m"] for r in ordered.most_common(df, ["k"], "v", "m").collect()}
    assert got == {"a": "x", "b": "z"}


def test_bounded_fetch_refuses_more(spark):
    with pytest.raises(ValueError):
        take_bounded(spark.range(5), 4, "rows")
    assert len(take_bounded(spark.range(4), 4, "rows")) == 4


def test_numbered_restarts_per_key(frame):
    df, data = frame
    got = ordered.numbered(df, ["k"], ["t", "id"], "n").groupBy("k").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("c")
    ).collect()
    for r in got:
        assert r["lo"] == 1 and r["hi"] == r["c"] == len(grouped(data)[r["k"]])
