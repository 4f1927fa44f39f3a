"""Boosted trees of all replicates against a plain loop and against a single tree of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from caseweave.operators import causal as cs


def cohort(spark, n=240, missing=False):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(n):
        a, b = int(draw.integers(0, 9)), int(draw.integers(0, 2))
        y = float(3 * (a > 4) + a * b + draw.normal())
        rows.append((i, i % 3 % 2, None if missing and i % 7 == 0 else float(a), float(b), y))
    return spark.createDataFrame(rows, "hadm_id long, T int, a double, b double, y double")


def plain_tree(x, gap, w, depth):
    """Values of the rows of ``x`` by a tree grown row by row; x holds places, missing ones last."""
    def grow(at, depth):
        whole = gap[at].sum() ** 2 / (w[at].sum() + 1.0)
        best = None
        for f in range(x.shape[1]) if depth else ():
            for cut in range(cs.PLACES - 1):
                left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                if w[left].sum() < 1 or w[right].sum() < 1:
                    continue
                gain = sum(gap[s].sum() ** 2 / (w[s].sum() + 1.0) for s in (left, right)) - whole
                if gain > 1e-6 and (best is None or gain > best[0] * (1 + 1e-6)):
                    best = (gain, left, right)
        if best is None:
            value[at] = gap[at].sum() / (w[at].sum() + 1.0)
        else:
            grow(best[1], depth - 1)
            grow(best[2], depth - 1)

    value = np.zeros(len(x))
    grow(np.ones(len(x), bool), depth)
    return value


@pytest.mark.parametrize("missing", [False, True])
def test_matches_plain_boosting(spark, missing):
    df = cohort(spark, missing=missing)
    got = {(r["replicate"], r["T"]): r["mu"] for r in cs.boosted_learner(
        df, ["a", "b"], "y", 2, replicates=2, seed=4, rounds=3, depth=2, write_every=2).collect()}
    drawn = cs.weighted(df.select("*", F.array(*cs.placed(df, ["a", "b"])).alias("x")), 2, 4).orderBy("hadm_id").collect()
    x, y = np.array([r["x"] for r in drawn]), np.array([r["y"] for r in drawn])
    assert len(np.unique(x[:, 0])) == (10 if missing else 9) and len(np.unique(x[:, 1])) == 2
    w, arm = np.array([r["_w"] for r in drawn], dtype=float), np.array([r["T"] for r in drawn])
    assert set(got) == {(r, a) for r in range(3) for a in range(2)}
    for (r, a), mu in got.items():
        own = np.where(arm == a, w[:, r], 0.0)
        said = np.full(len(y), (own * y).sum() / own.sum())
        for _ in range(3):
            said = said + 0.3 * plain_tree(x, own * (y - said), own, 2)
        assert mu == pytest.approx(said.mean(), abs=1e-6)


def test_one_round_is_a_tree_of_the_library(spark):
    """Without shrinkage and at rate 1, replicate 0 is a single regression tree per arm."""
    df = cohort(spark)
    got = {r["T"]: r["mu"] for r in cs.boosted_learner(
        df, ["a", "b"], "y", 2, replicates=0, rounds=1, depth=3, rate=1.0, shrink=0.0).collect()}
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for a in range(2):
        model = DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(vectors.where(F.col("T") == a))
        assert got[a] == pytest.approx(model.transform(vectors).agg(F.avg("prediction")).first()[0], abs=0.02)


def test_estimate_and_odd_inputs(spark):
    df = cohort(spark)
    odd = df.unionByName(spark.createDataFrame(
        [(900, None, 1.0, 1.0, 5.0), (901, 1, float("nan"), None, None), (902, 1, float("nan"), None, 2.0)], df.schema))
    options = {"replicates": 8, "model": "boosted", "rounds": 2, "depth": 2}
    out = {(r["quantity"], r["name"]): r for r in cs.estimate(odd, ["a", "b"], "y", ["low", "high"], **options).collect()}
    assert set(out) == {("mean", "low"), ("mean", "high"), ("contrast", "high|low")}
    for r in out.values():
        assert r["lower"] <= r["point"] <= r["upper"]
    assert cs.boosted_learner(df.limit(0), ["a"], "y", 2, replicates=2, rounds=1, depth=1).count() == 0
    with pytest.raises(ValueError):
        cs.estimate(df, ["a"], "y", ["low", "high"], kind="binary", model="boosted")


def test_published_trees_are_asked_for(spark, monkeypatch):
    """the query grows 200 trees of depth 6 in each of 200 replicates, as published."""
    from caseweave import registry

    asked = {}

    def stop(frame, *args, **options):
        asked.update(options)
        raise InterruptedError

    monkeypatch.setattr(cs, "boosted_learner", stop)
    with pytest.raises(InterruptedError):
        registry.all_queries()["e4_boosted"](spark, "/root/testdata/sf0.001")
    assert (asked["replicates"], asked.get("rounds", 200), asked.get("depth", 6)) == (200, 200, 6)


@pytest.mark.parametrize("missing", [False, True])
def test_models_of_a_task_are_those_of_all_tasks(spark, monkeypatch, missing):
    """trees grown whole in a task for some replicates are the trees grown level by level over all tasks."""
    df, options = cohort(spark, missing=missing), {"replicates": 6, "seed": 4, "rounds": 4, "depth": 3, "write_every": 2}
    apart = {(r["replicate"], r["T"]): r["mu"] for r in cs.boosted_learner(df, ["a", "b"], "y", 2, **options).collect()}
    monkeypatch.setattr(cs, "MOST_CELLS", 0)
    together = {(r["replicate"], r["T"]): r["mu"] for r in cs.boosted_learner(df, ["a", "b"], "y", 2, **options).collect()}
    assert set(apart) == {(r, a) for r in range(7) for a in range(2)}
    assert apart == pytest.approx(together, abs=1e-6)


def test_boosted_means_of_merged_rows(spark, monkeypatch):
    """rows of equal arm and covariates reach the boosting as one, and the means are those of all rows."""
    from pyspark.ml.regression import GBTRegressor

    df, sizes = cohort(spark), []

    class Counted(GBTRegressor):
        def fit(self, rows, params=None):
            sizes.append(rows.count())
            return super().fit(rows, params)

    monkeypatch.setattr(cs, "GBTRegressor", Counted)
    got = {r["T"]: r["mu"] for r in cs.boosted_means(df, ["a", "b"], "y", 2, rounds=5, depth=3).collect()}
    assert sum(sizes) == df.select("T", "a", "b").distinct().count() < df.count()
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for a in range(2):
        model = GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, stepSize=0.3, seed=a).fit(vectors.where(F.col("T") == a))
        assert got[a] == pytest.approx(model.transform(vectors).agg(F.avg("prediction")).first()[0], abs=1e-9)
