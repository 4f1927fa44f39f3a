import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.functions.kernels import Direction, Kind, Missing, Trait
from caseweave.operators import causal as cs, evaluation as ev, similarity as sm


def mixed(spark, n=25, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([
        (i, None if rng.random() < 0.2 else rng.uniform(0, 9), rng.choice("abc"), rng.randrange(2))
        for i in range(n)
    ], "id long, num double, cat string, flag int")


TRAITS = [Trait("num", scale=(0.0, 9.0)), Trait("cat", Kind.NOMINAL, weight=2.0),
          Trait("flag", Kind.BINARY, asymmetric=True)]


def all_pairs(spark, df):
    ids = [r["id"] for r in df.select("id").collect()]
    return spark.createDataFrame([(a, b) for a in ids for b in ids], "left_id long, right_id long")


def test_distance_properties(spark):
    df = mixed(spark)
    rows = sm.pair_distances(all_pairs(spark, df), df, TRAITS, "id").collect()
    got = {(r["left_id"], r["right_id"]): r["distance"] for r in rows}
    for (a, b), value in got.items():
        assert value == got[(b, a)]
        assert 0.0 <= value <= 1.0
        if a == b:
            assert value == 0.0


def test_missing_and_directions(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, 9.0)], "hadm_id long, x double")
    def scores(trait, reference):
        rows = sm.score_against(df, [trait], {"x": reference}).collect()
        return {r["hadm_id"]: r["distance"] for r in rows}
    assert scores(Trait("x", scale=(0.0, 10.0)), 6.0) == {1: None, 2: pytest.approx(0.2), 3: pytest.approx(0.3)}
    assert scores(Trait("x", scale=(0.0, 10.0), missing=Missing.ZERO), 6.0)[1] == 1.0
    high = scores(Trait("x", scale=(0.0, 10.0), direction=Direction.HIGHER), 6.0)
    assert (high[2], high[3]) == (pytest.approx(0.2), 0.0)
    assert scores(Trait("x", scale=(5.0, 5.0)), 4.0)[2] == 0.0
    with pytest.raises(ValueError):
        sm.profile_cohort(df.withColumn("subject_id", F.lit(1)), [Trait("x", reference=1.0)], 1.0)


def test_nearest_matches_pairs(spark):
    df = mixed(spark)
    rows = sm.pair_distances(all_pairs(spark, df), df, TRAITS, "id").collect()
    want = {}
    for r in rows:
        if r["left_id"] < 3 and r["left_id"] != r["right_id"]:
            want.setdefault(r["left_id"], []).append((r["distance"], r["right_id"]))
    got = {}
    for r in sm.nearest(df.where("id < 3"), df, TRAITS, "id", 4).collect():
        got.setdefault(r["left_id"], []).append((r["distance"], r["right_id"]))
    for key, found in got.items():
        assert sorted(found) == sorted(want[key])[:4]


def test_trajectories(spark):
    def bucket_rows(rows):
        return spark.createDataFrame(rows, "hadm_id long, bucket string, code string, first_at int")
    anchor = bucket_rows([(9, "d0", "a", 0), (9, "d1", "b", 1)])
    others = bucket_rows([(1, "d0", "a", 0), (1, "d1", "b", 1), (2, "d0", "z", 0), (3, "d0", "a", 0), (3, "d7", "q", 9)])
    pool = spark.createDataFrame([(1,), (2,), (3,), (4,)], "hadm_id long")
    got = {r["hadm_id"]: r for r in sm.trajectory_scores(anchor, others, pool).collect()}
    assert got[1]["temporal"] == 1.0 and got[2]["temporal"] == 0.0 and got[4]["temporal"] == 0.0
    assert got[3]["temporal"] == pytest.approx(1 / (1 + 0.9 + 0.81)) and got[3]["los_gap_days"] == 0
    empty = sm.trajectory_scores(anchor.where("1 = 0"), others, pool).first()
    assert empty["temporal"] is None and not empty["temporal_available"]


def test_group_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        sm.contextual_scores(mixed(spark), {}, weights={"severity": 0.4})


def area(labels, scores, weights):
    top = bottom = 0.0
    for i in range(len(labels)):
        for j in range(len(labels)):
            if labels[i] == 1 and labels[j] == 0:
                pair = weights[i] * weights[j]
                bottom += pair
                top += pair * (1.0 if scores[i] > scores[j] else 0.5 if scores[i] == scores[j] else 0.0)
    return top / bottom


@pytest.fixture
def scored(spark):
    rng = random.Random(4)
    data = [(i, int(rng.random() < 0.4), round(rng.random(), 1), round(rng.random(), 2), f"g{i % 4}") for i in range(120)]
    return spark.createDataFrame(data, "id long, label int, a double, b double, g string"), data


def test_areas_and_bootstrap(spark, scored):
    df, data = scored
    labels, a = [r[1] for r in data], [r[2] for r in data]
    got = ev.areas(ev.curve(df, score="a")).first()["auroc"]
    assert got == pytest.approx(area(labels, a, [1] * len(a)))
    hashes = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], dtype=np.int64)
    copies = ev.replicate_copies(hashes, 5, 7)
    boot = {r["replicate"]: r["auroc"] for r in ev.bootstrap_areas(df, "id", "label", "a", 5, 7).collect()}
    for b in range(5):
        assert boot[b] == pytest.approx(area(labels, a, copies[:, b]))


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_tied_scores_go_over_several_tasks(spark, scored, digits):
    """With no digits there are two scores; slices end inside of them."""
    _, data = scored
    rows = [(r[0], r[1], round(r[3], digits)) for r in data]
    df = spark.createDataFrame(rows, "id long, label int, a double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        boot = {r["replicate"]: r["auroc"] for r in ev.bootstrap_areas(df, "id", "label", "a", 5, 7).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hashes = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], dtype=np.int64)
    copies = ev.replicate_copies(hashes, 5, 7)
    for b in range(5):
        assert boot[b] == pytest.approx(area([r[1] for r in rows], [r[2] for r in rows], copies[:, b]))


def test_copies_average_one():
    copies = ev.replicate_copies(np.arange(4000, dtype=np.int64), 20, 1)
    assert abs(copies.mean() - 1.0) < 0.02 and abs(copies.var() - 1.0) < 0.05


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.7), (1, 0.2)], "label int, score double")
    points = ev.curve(df)
    assert np.isnan(ev.areas(points).first()["auroc"])
    row = ev.threshold_metrics(points).first()
    assert row["threshold"] == 0.5 and (row["tp"], row["fn"]) == (1, 1) and np.isnan(row["f1"])


def test_split_keeps_subjects_and_shares(spark):
    rows = [(i, i // 2, int(i % 8 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "hadm_id long, subject_id long, y int")
    out = ev.split_subjects(df, "y")
    assert out.groupBy("subject_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    counts = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("subject_id").alias("n")).collect()}
    assert counts == {"train": 280, "validation": 60, "test": 60}


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.11), (1, 1.0)], "label int, score double")
    assert sorted((r["bin"], r["n"]) for r in ev.calibration(df).collect()) == [(0, 2), (1, 1), (9, 1)]


@pytest.fixture
def trial(spark):
    rng = np.random.default_rng(1)
    n = 300
    x, t = rng.normal(size=n), rng.integers(0, 3, n)
    y = 2.0 + 0.5 * x + 1.5 * (t == 1) - 1.0 * (t == 2) * x
    died = (rng.random(n) < 1 / (1 + np.exp(-(x + t - 1)))).astype(int)
    rows = [(i, float(x[i]), int(t[i]), float(y[i]), int(died[i])) for i in range(n)]
    return spark.createDataFrame(rows, "hadm_id long, x double, T int, y double, died int"), x, t, y, died


def test_linear_learners(trial):
    df, x, t, y, _ = trial
    want = []
    for arm in range(3):
        design = np.column_stack([np.ones((t == arm).sum()), x[t == arm]])
        beta = np.linalg.lstsq(design, y[t == arm], rcond=None)[0]
        want.append(beta[0] + beta[1] * x.mean())
    got = {r["T"]: r["mu"] for r in cs.t_learner(df, ["x"], "y").collect()}
    assert [got[a] for a in range(3)] == pytest.approx(want)
    effects = {r["T"]: r["effect"] for r in cs.x_learner(df, ["x"], "y", 3).collect()}
    assert effects == {1: pytest.approx(want[1] - want[0]), 2: pytest.approx(want[2] - want[0])}


def test_narrowed_cohort(trial):
    df, *_ = trial
    some = df.where("hadm_id % 3 = 0")
    asked = {"learner": "t_learner", "replicates": 4}
    got = cs.estimate(df, ["x"], "y", ["a", "b", "c"], within=some, **asked)
    want = cs.estimate(some, ["x"], "y", ["a", "b", "c"], **asked)
    key = lambda r: (r["quantity"], r["name"])
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["point"] == pytest.approx(b["point"]) and a["upper"] == pytest.approx(b["upper"])


def test_logistic_learner(trial):
    df, x, t, _, died = trial
    got = {r["T"]: r["mu"] for r in cs.t_learner(df, ["x"], "died", binary=True).collect()}
    for arm in range(3):
        design, target = np.column_stack([np.ones((t == arm).sum()), x[t == arm]]), died[t == arm]
        beta = np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-design @ beta))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0, 1])
            beta += np.linalg.solve(hessian, design.T @ (target - p) - np.array([0, 1]) * beta)
        assert got[arm] == pytest.approx((1 / (1 + np.exp(-(beta[0] + beta[1] * x)))).mean(), abs=1e-6)


def test_estimate_and_guards(trial):
    df = trial[0]
    out = cs.estimate(df, ["x"], "y", ["a", "b", "c"], replicates=30)
    rows = {(r["quantity"], r["name"]): r for r in out.collect()}
    assert set(n for q, n in rows if q == "contrast") == {"a|b", "a|c", "b|c"}
    for r in rows.values():
        assert r["lower"] <= r["point"] <= r["upper"]
    assert rows[("contrast", "a|b")]["upper"] < 0
    for bad in ({"kind": "time_to_event"}, {"learner": "z"}, {"replicates": 0}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            cs.estimate(df, ["x"], "y", ["a", "b", "c"], **bad)
    with pytest.raises(ValueError):
        cs.estimate(df, ["x"], "y", ["a", "a", "c"])


# --- ordinal outcomes -----------------------------------------------------------------------


@pytest.fixture
def arms(spark):
    rng = random.Random(8)
    data = []
    for i in range(400):
        arm, g, x = rng.randrange(3), rng.randrange(2), rng.gauss(0, 1)
        data.append((i, arm, g, x, min(3, max(0, round(1 + arm * 0.7 + g * 0.5 + 0.5 * x + rng.gauss(0, 0.7))))))
    return spark.createDataFrame(data, "hadm_id long, T int, g int, x double, y int"), data


def test_models_of_levels_are_at_the_optimum(spark, arms):
    """The slope of the penalised likelihood is nought, for every replicate and arm."""
    df, data = arms
    x = cs.constant_and(["g", "x"])
    rows = cs._prepared(df, x, F.col("y").cast("double"), F.col("T"), 3, 2, "hadm_id")
    models = cs.fit_levels(rows, [0.0, 1.0, 2.0, 3.0], 3)
    weights = {r["hadm_id"]: r["_w"] for r in cs.weighted(df, 3, 2).collect()}
    assert set(models) == {(r, a) for r in range(4) for a in range(3)}
    for (r, a), model in models.items():
        own = [d for d in data if d[1] == a]
        features = np.array([[1.0, d[2], d[3]] for d in own])
        w, y = np.array([weights[d[0]][r] for d in own], float), np.array([d[4] for d in own])
        live = np.isfinite(model[:, 0])
        assert live.tolist() == [bool(w[y == v].sum()) for v in range(4)]
        p = cs._shares(features, model)
        slope = ((np.eye(4)[y] - p) * w[:, None]).T @ features
        slope[:, 1:] -= np.where(live[:, None], model[:, 1:], 0.0)
        assert np.abs(slope[live]).max() < 1e-3


def test_ordinal_effects(spark, arms):
    df, _ = arms
    found = cs.estimate(df, ["g", "x"], "y", ["a", "b", "c"], kind="ordinal", learner="x_learner", replicates=5)
    rows = {(r["quantity"], r["name"]): r for r in found.collect()}
    assert set(rows) == {("mean", n) for n in "abc"} | {("contrast", n) for n in ("a|b", "a|c", "b|c")} | {("effect", n) for n in ("b|a", "c|a")}
    assert 0.3 < rows["effect", "b|a"]["point"] < 1.1 < rows["effect", "c|a"]["point"] + 0.2
    with pytest.raises(ValueError):
        cs.levels_of(spark.range(60).withColumn("y", F.col("id")), "y")


def test_x_learner_blends_by_the_chance_of_the_arm(spark):
    """Unequal arms and a curved outcome: the two models of an effect differ, so the chance of the arm matters."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    arm = (rng.random(600) < 1 / (1 + np.exp(1.5 - x))).astype(int)
    y = x**2 + arm * (1 + x) + rng.normal(size=600) * 0.1
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(arm, x, y))], "hadm_id long, T int, x double, y double")
    one = np.column_stack([np.ones(600), x])
    fit = lambda at, v: np.linalg.lstsq(one[at], v, rcond=None)[0]
    mu0, mu1 = fit(arm == 0, y[arm == 0]), fit(arm == 1, y[arm == 1])
    tau1 = fit(arm == 1, y[arm == 1] - one[arm == 1] @ mu0)
    tau0 = fit(arm == 0, one[arm == 0] @ mu1 - y[arm == 0])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ beta))
        beta += np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag([0, 1.0]), one.T @ (arm - p) - np.array([0, 1.0]) * beta)
    e = 1 / (1 + np.exp(-one @ beta))
    got = cs.x_learner(df, ["x"], "y", 2).first()["effect"]
    assert got == pytest.approx(float((e * (one @ tau0) + (1 - e) * (one @ tau1)).mean()), abs=1e-6)


def test_distances_are_read_once(spark):
    """Size, spread and median of a cohort from one pass over its members, with ties and missing distances."""
    passes = spark.sparkContext.accumulator(0)
    values = [0.1, 0.2, 0.2, 0.5, None, 0.4]

    def seen(rows):
        for batch in rows:
            passes.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(v,) for v in values], "distance double").mapInArrow(seen, "distance double")
    row = sm.cohort_distances(rows).first()
    assert (row["n_returned"], row["min"], row["max"], row["median"]) == (6, 0.1, 0.5, 0.2)
    assert abs(row["mean"] - 0.28) < 1e-12 and passes.value == 6
    none = sm.cohort_distances(rows.where("distance > 1")).first()
    assert none["n_returned"] == 0 and none["median"] is None and none["mean"] is None
