"""Rows that a model can't tell apart are written once, with the same draws and models as row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.functions.draws import copies, drawn_copies, uniform
from caseweave.operators import causal as cs


def cohort(spark, n=600):
    rows = [(i, i % 3, float(i // 3 % 2), float(i * 7 % 5), i * 11 % 13 % 2) for i in range(n)]
    return spark.createDataFrame(rows, "hadm_id long, T int, g double, y double, died int").coalesce(2), rows


def test_draws_are_those_of_single_replicates(spark):
    df = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"))
    got = df.select(
        drawn_copies(5, [F.col("id")], F.sequence(F.lit(1), F.lit(9))).alias("a"),
        F.array(*[copies(uniform(5, F.col("id"), F.lit(r))) for r in range(1, 10)]).alias("b"),
    ).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and len({c for r in got for c in r["a"]}) > 3


def test_equal_rows_are_written_once(spark):
    df, rows = cohort(spark)
    merged = cs._prepared(df, cs.constant_and(["g"]), F.col("y"), F.col("T"), 4, 1, "hadm_id").collect()
    assert len(merged) <= 2 * len({r[1:4] for r in rows}) < len(rows)
    weights = {r["hadm_id"]: r["_w"] for r in cs.weighted(df, 4, 1).collect()}
    for arm, g, y in {r[1:4] for r in rows}:
        want = np.sum([weights[r[0]] for r in rows if r[1:4] == (arm, g, y)], axis=0)
        found = [r["_w"] for r in merged if (r["_arm"], r["_x"], r["_y"]) == (arm, [1.0, g], y)]
        assert np.sum(found, axis=0).tolist() == want.tolist()


def test_boosting_works_on_cells(spark):
    df, rows = cohort(spark)
    cells = cs._cells(df, cs.placed(df, ["g"]), F.col("y"), 2, 1, "hadm_id").collect()
    assert len(cells) == 6 and sum(c["_w"][0] for c in cells) == len(rows)
    assert sum(c["_wy"][0] for c in cells) == sum(r[3] for r in rows)


def test_rows_that_do_not_fold_are_handed_on(spark, monkeypatch):
    df, rows = cohort(spark)
    want = cs.t_learner(df, ["g"], "died", binary=True, replicates=2).collect()
    monkeypatch.setattr(cs, "MOST_MERGED", 1)
    got = cs.t_learner(df, ["g"], "died", binary=True, replicates=2).collect()
    assert [r["mu"] for r in got] == pytest.approx([r["mu"] for r in want])


def test_cohort_is_computed_once(spark):
    """Newton steps read written rows: a cohort whose rows are counted as they are made is made once."""
    df, rows = cohort(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    cs.t_learner(df.mapInArrow(counted, df.schema), ["g"], "died", binary=True, replicates=2).collect()
    assert made.value == len(rows)
