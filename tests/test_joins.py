"""Stay assignment against the plain rule."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from caseweave.operators.joins import assign_stay, in_interval

START = datetime(2020, 1, 1)
STAYS = "hadm_id long, stay_id long, intime timestamp, outtime timestamp"
EVENTS = "hadm_id long, id long, charttime timestamp, intime string"


def hour(h):
    return None if h is None else START + timedelta(hours=int(h))


def plain(events, stays):
    found = set()
    for key, number, at, _ in events:
        inside = [
            (start, stay) for own, stay, start, end in stays
            if None not in (key, at, start) and own == key and start <= at and (end is None or at <= end)
        ]
        if inside:
            found.add((number, min(inside)[1]))
    return found


def tables():
    """Overlapping, nested, touching, repeated, open and backward stays; a third of all events in one encounter."""
    draw = np.random.default_rng(3)
    stays = [(1, 1, hour(0), hour(10)), (1, 2, hour(2), hour(4)), (1, 3, hour(10), hour(20)), (1, 4, hour(10), hour(12)),
             (2, 5, hour(5), None), (2, 6, hour(7), hour(9)), (2, 7, hour(1), hour(6)), (3, 8, hour(9), hour(3)),
             (3, 9, hour(4), hour(4)), (4, 10, None, hour(9)), (None, 11, hour(0), hour(99))]
    stays += [(5, 100 + i, hour(s), hour(s + d)) for i, (s, d) in enumerate(draw.integers(0, 60, (80, 2)) % [300, 9])]
    stays += stays[:3]
    events = [(k, 100 * k + h, hour(h), "x") for k in range(1, 5) for h in range(-1, 24)]
    events += [(5, 1000 + i, hour(h), "x") for i, h in enumerate(draw.integers(0, 70, 60))]
    events += [(None, 1, hour(1), "x"), (1, 2, None, "x"), (9, 3, hour(1), "x")]
    return events, stays


@pytest.mark.parametrize("split", [False, True])
def test_assign_stay(spark, split, request):
    if split:
        request.getfixturevalue("small_tasks")
    events, stays = tables()
    got = assign_stay(spark.createDataFrame(events, EVENTS), spark.createDataFrame(stays, STAYS))
    rows = [(r["id"], r["stay_id"]) for r in got.collect()]
    assert got.columns == ["hadm_id", "id", "charttime", "stay_id"]
    assert len(rows) == len(set(rows)) and set(rows) == plain(events, stays)


def test_repeated_events_and_empty_tables(spark):
    events, stays = spark.createDataFrame([(1, 7, hour(1), "x")] * 3, EVENTS), spark.createDataFrame(tables()[1], STAYS)
    assert [r["stay_id"] for r in assign_stay(events, stays).collect()] == [1, 1, 1]
    assert assign_stay(events.limit(0), stays).count() == 0 and assign_stay(events, stays.limit(0)).count() == 0


def test_events_are_read_once(spark, tmp_path):
    events, stays = tables()
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "events"))
    read = spark.read.parquet(str(tmp_path / "events"))
    plan = assign_stay(read, spark.createDataFrame(stays, STAYS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_events_in_intervals_of_any_length(spark, kind):
    """Intervals of minutes to years, both ends counted, before 1970 and without ends, against the plain rule."""
    draw = np.random.default_rng(5)
    first = datetime(1969, 6, 1)
    lengths = [0, 60, 6 * 3600, 6 * 3600 + 1, 86400, 20 * 86400, 400 * 86400, 4000 * 86400]
    intervals = [
        (int(draw.integers(3)), n, s := first + timedelta(seconds=int(draw.integers(500 * 86400))), s + timedelta(seconds=lengths[n % len(lengths)]))
        for n in range(200)
    ]
    events = [(int(draw.integers(3)), n, first + timedelta(seconds=int(draw.integers(500 * 86400)))) for n in range(300)]
    events += [(k, 1000 + n, s) for k, n, s, _ in intervals] + [(k, 2000 + n, e) for k, n, _, e in intervals]
    expected = sorted((e, n) for k, e, at in events for k2, n, s, until in intervals if k == k2 and s <= at <= until)
    intervals += [(0, 900, first, None), (1, 901, None, first), (None, 902, first, datetime(2030, 1, 1)), (2, 903, datetime(1999, 1, 1), first)]
    events += [(0, 5000, None), (None, 5001, datetime(1970, 1, 2))]
    left = spark.createDataFrame(events, f"hadm_id int, id int, charttime {kind}").withColumnRenamed("id", "event_id")
    right = spark.createDataFrame(intervals, f"hadm_id int, stay_id int, intime {kind}, outtime {kind}")
    found = in_interval(left, right, "hadm_id")
    assert found.columns == ["hadm_id", "event_id", "charttime", "stay_id", "intime", "outtime"]
    assert sorted((r.event_id, r.stay_id) for r in found.collect()) == expected
    assert in_interval(left, right.limit(0), "hadm_id").count() == 0
