"""Nearest rows of a whole table against all pairs."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.functions.kernels import Direction, Kind, Missing, Trait
from caseweave.operators import similarity as sm

SCHEMA = "id long, num double, other double, cat string, flag int, grade string"
TRAITS = [
    Trait("num", scale=(0.0, 9.0)), Trait("other", scale=(-1.0, 1.0), weight=0.5), Trait("cat", Kind.NOMINAL, weight=2.0),
    Trait("flag", Kind.BINARY, asymmetric=True), Trait("grade", Kind.ORDINAL, levels=["low", "mid", "high"]),
]


def mixed(spark, n, seed=1):
    """Numbers out of range, missing values in all traits, copies, a value that a third of the rows share."""
    rng = random.Random(seed)

    def gone(value):
        return None if rng.random() < 0.15 else value

    rows = [
        (i, gone(rng.choice([rng.uniform(-2, 11), 3.0, float("nan")])), gone(rng.gauss(0, 1)),
         gone("a" if i % 3 == 0 else rng.choice("bcdefghij")), gone(rng.randrange(2)), gone(rng.choice(["low", "mid", "high", "?"])))
        for i in range(n)
    ]
    rows += [(n + i, *rows[3][1:]) for i in range(5)] + [(n + 9, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df, traits, n, anchors="true"):
    """By all pairs, for a small table."""
    left = df.where(anchors).select(F.col("id").alias("left_id"))
    pairs = left.join(df.select(F.col("id").alias("right_id")), F.lit(True))
    found = {}
    for r in sm.pair_distances(pairs, df, traits, "id").where("left_id <> right_id").collect():
        far = float("inf") if r["distance"] is None else r["distance"]
        found.setdefault(r["left_id"], []).append((far, r["right_id"]))
    return {key: sorted(rows)[:n] for key, rows in found.items()}


def got(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["left_id"], []).append((float("inf") if r["distance"] is None else r["distance"], r["right_id"]))
    return {key: sorted(rows) for key, rows in found.items()}


@pytest.mark.parametrize("change", [
    {}, {"missing": Missing.ZERO}, {"direction": Direction.HIGHER}, {"direction": Direction.LOWER},
])
def test_every_row_is_an_anchor(spark, monkeypatch, change):
    monkeypatch.setattr(sm, "CELL_ROWS", 7)
    df, traits = mixed(spark, 150), [replace(t, **change) for t in TRAITS]
    assert got(sm.nearest(df, df, traits, "id", 4)) == plain(df, traits, 4)


def test_traits_beyond_the_cells(spark, monkeypatch):
    monkeypatch.setattr(sm, "CELL_TRAITS", 2)
    df = mixed(spark, 80)
    assert got(sm.nearest(df, df, TRAITS, "id", 3)) == plain(df, TRAITS, 3)


def test_few_or_no_candidates(spark):
    df = mixed(spark, 4)
    assert got(sm.nearest(df, df, TRAITS, "id", 50)) == plain(df, TRAITS, 50)
    assert sm.nearest(df, df.limit(0), TRAITS, "id", 3).count() == 0
    assert sm.nearest(df.limit(0), df, TRAITS, "id", 3).count() == 0


def test_far_cells_are_left_out(spark):
    """Of 2,000 evenly spread rows few lie in cells that a bound of 0.05 lets through, and the answer is whole."""
    df = spark.range(2000).select("id", (F.col("id") / 2000.0).alias("num"), (F.col("id") * 37 % 2000 / 2000.0).alias("other"))
    traits = [Trait("num", scale=(0.0, 1.0)), Trait("other", scale=(0.0, 1.0))]
    assert got(sm.nearest(df.where("id % 100 = 0"), df, traits, "id", 3)) == plain(df, traits, 3, "id % 100 = 0")
    edge = np.arange(32) / 32
    low = np.array([(a, b) for a in edge for b in edge])
    cells = sm.Cells(traits, 0.0, np.arange(1024), np.full(1024, 2), low, low + 1 / 32)
    x = np.array([[0.5, 0.5], [0.01, 0.99]])
    assert (cells.bounds(x) <= 0.05).mean(axis=1).max() < 0.05
    assert (cells.bounds(x).min(axis=1) == 0).all()
    assert (cells.rows * cells.first(x, 3)).sum(axis=1).tolist() == [4, 4]
