"""Splits, classifiers, and metrics of scores against 0/1 labels.

Curves are built from counts per distinct score.  The running totals over them
go through :mod:`caseweave.plans.ordered`, so a curve with more points than one
task should sort is accumulated in slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.draws import POISSON_ONE, uniform
from caseweave.operators.aggregates import any_positive, unpivoted
from caseweave.plans.ordered import neighbour, numbered, percentiles, running

# --- splits --------------------------------------------------------------------------


def split_subjects(
    rows: DataFrame, label: str, subject: str = "subject_id", test: float = 0.15,
    validation: float = 0.15, seed: int = 42,
) -> DataFrame:
    """M1: add ``split`` (train, validation, test), all rows of a subject together.

    Subjects are stratified by whether any of their rows is positive and ordered
    by a hash within each stratum, so the shares hold and the split repeats.
    """
    subjects = any_positive(rows, subject, label, "_positive").withColumn(
        "_draw", uniform(seed, F.col(subject))
    )
    placed = numbered(subjects, ["_positive"], ["_draw", subject], "_place")
    sizes = subjects.groupBy("_positive").agg(F.count(F.lit(1)).alias("_size"))
    n_test = F.round(F.col("_size") * test)
    n_validation = F.round(F.col("_size") * validation)
    part = (
        F.when(F.col("_place") <= n_test, "test")
        .when(F.col("_place") <= n_test + n_validation, "validation")
        .otherwise("train")
    )
    parts = placed.join(sizes, "_positive").select(subject, part.alias("split"))
    return rows.join(parts, subject)


# --- curves and metrics -----------------------------------------------------------------


def curve(
    rows: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """Points of the score's curve, highest score first within each group.

    ``pos`` and ``neg`` count the rows at a score, ``tp`` and ``fp`` those at it or
    above, ``all_pos`` and ``all_neg`` the whole group.
    """
    keys = list(keys)
    positive = F.col(label).cast("bigint")
    counts = rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    ).withColumn("_down", -F.col("score"))
    points = running(counts, keys, ["_down"], {"tp": "pos", "fp": "neg"})
    totals = counts.groupBy(*keys).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")
    )
    if keys:
        return points.join(totals, keys)
    return points.withColumns({
        "all_pos": totals.select("all_pos").scalar(), "all_neg": totals.select("all_neg").scalar(),
    })


def _area() -> Column:
    """Area under the receiver curve; ties count half."""
    half = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / 2.0
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return F.when(pairs > 0, half / F.when(pairs > 0, pairs)).otherwise(F.lit(float("nan")))


def _recall_area() -> Column:
    """Area under the precision-recall points, from (0, 1), by trapezoids."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    here = tp / (tp + fp)
    above = tp - pos + fp - neg
    before = F.when(above > 0, (tp - pos) / F.when(above > 0, above)).otherwise(1.0)
    area = F.sum(pos * (here + before) / 2.0)
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return F.when(both, area / F.when(F.max("all_pos") > 0, F.max("all_pos"))).otherwise(
        F.lit(float("nan"))
    )


def areas(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M5: areas under the receiver and the precision-recall curve."""
    return points.groupBy(*keys).agg(_area().alias("auroc"), _recall_area().alias("auprc"))


def threshold_metrics(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M6: the threshold with the largest tpr - fpr and the metrics there.

    Among equal ones the highest threshold counts.  With one class only, the
    threshold is 0.5 and the metrics are NaN.
    """
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    gain = tp * F.col("all_neg") - fp * F.col("all_pos")
    half = F.col("score") >= 0.5
    best = points.groupBy(*keys).agg(
        F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"),
        F.max(gain).alias("_gain"),
        F.max_by(F.struct("score", "tp", "fp"), F.struct(gain, "score")).alias("_best"),
        F.coalesce(F.sum(F.when(half, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(half, F.col("neg"))), F.lit(0)).alias("_fp"),
    )
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    some = F.col("_gain") > 0  # otherwise no threshold beats predicting nothing
    zero = F.lit(0).cast("bigint")
    found = best.select(
        *keys, "all_pos", "all_neg", both.alias("_both"),
        F.when(~both, F.lit(0.5)).when(some, F.col("_best.score"))
        .otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(~both, F.col("_tp")).when(some, F.col("_best.tp")).otherwise(zero).alias("tp"),
        F.when(~both, F.col("_fp")).when(some, F.col("_best.fp")).otherwise(zero).alias("fp"),
    ).withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})

    def ratio(top: Column, bottom: Column) -> Column:
        value = F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(F.lit(0.0))
        return F.when(F.col("_both"), value).otherwise(F.lit(float("nan")))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return found.select(
        *keys, "threshold", "tp", "fp", "tn", "fn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def calibration(
    rows: DataFrame, label: str = "label", score: str = "score", bins: int = 10
) -> DataFrame:
    """M7: share of positives and mean score per equal-width bin.

    A score on a bin's upper edge belongs to that bin.
    """
    edges = [i / bins for i in range(1, bins)]
    place = reduce(
        lambda a, b: a + b, [(F.col(score) > e).cast("int") for e in edges], F.lit(0)
    )
    return rows.groupBy(place.alias("bin")).agg(
        F.avg(F.col(label)).alias("fraction_of_positives"),
        F.avg(F.col(score)).alias("mean_predicted_value"), F.count(F.lit(1)).alias("n"),
    )


def corner_points(points: DataFrame) -> DataFrame:
    """The curve without points on a straight line between their neighbours."""
    following = neighbour(points, [], ["_down"], {"_pos": "pos", "_neg": "neg"})
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return following.where(
        first | F.col("_pos").isNull() | (F.col("_pos") != F.col("pos"))
        | (F.col("_neg") != F.col("neg"))
    )


def extended_metrics(
    rows: DataFrame, label: str = "label", score: str = "score",
    specificities: Sequence[float] = (0.90, 0.95),
) -> DataFrame:
    """M8: Brier score, and sensitivity at given specificities."""
    points = corner_points(curve(rows, label, score))
    rate = F.col("fp") / F.col("all_neg")
    columns = [
        F.coalesce(
            F.max(F.when(rate <= 1.0 - s, F.col("tp") / F.col("all_pos"))), F.lit(0.0)
        ).alias(f"sensitivity_at_{round(100 * s)}_specificity")
        for s in specificities
    ]
    gap = F.col(score) - F.col(label)
    base = rows.agg(
        F.avg(gap * gap).alias("brier_score"), F.count(F.lit(1)).alias("n_test"),
        F.sum(F.col(label).cast("bigint")).alias("n_positive"),
    ).withColumn("n_negative", F.col("n_test") - F.col("n_positive"))
    found = points.agg(*columns)
    return base.withColumns({c: found.select(c).scalar() for c in found.columns})


def subgroup_metrics(
    rows: DataFrame, group: str, label: str = "label", score: str = "score", min_n: int = 5
) -> DataFrame:
    """M9: size, area and mean score per group with enough rows; no area for one class."""
    sizes = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_proba")
    ).where(F.col("n") >= min_n)
    found = areas(curve(rows, label, score, [group]), [group]).select(
        group, F.when(~F.isnan("auroc"), F.col("auroc")).alias("auroc")
    )
    return sizes.join(found, group)


# --- bootstrap of the area --------------------------------------------------------------


#: A draw is below the k-th chance exactly when its 53 bits are below the k-th of these.
_LIMITS = np.array([math.ceil(p * (1 << 53)) for p in POISSON_ONE], dtype=np.uint64)
#: Copies by the first 16 of the 53 bits, and the few beginnings that have a limit among them, where all bits are asked.
_COPIES = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), side="right").astype(np.uint16)
_OPEN = np.unique(_LIMITS >> np.uint64(37))
_IS_OPEN = np.isin(np.arange(1 << 16, dtype=np.uint64), _OPEN)
#: Rows whose draws are made at once: they and what is made of them stay in a core's cache.
_BLOCK = 64


def replicate_copies(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Copies of each row in each replicate: Poisson(1) draws from a hash of both."""
    with np.errstate(over="ignore"):
        steps = np.arange(replicates, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
        x = ids.astype(np.uint64)[:, None] + steps[None, :] * np.uint64(0x9E3779B97F4A7C15)
        moved = np.empty_like(x)
        # Two rounds of xor, shift and multiply spread neighbouring inputs.
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=moved)
            x ^= moved
            x *= np.uint64(factor)
        np.right_shift(x, np.uint64(31), out=moved)
        x ^= moved
    starts = np.right_shift(x, np.uint64(48), out=moved)
    copies = _COPIES[starts]
    unsure = np.flatnonzero(_IS_OPEN[starts])
    copies.reshape(-1)[unsure] = np.searchsorted(_LIMITS, x.reshape(-1)[unsure] >> np.uint64(11), side="right")
    return copies


#: What a sorted slice says per replicate: weights of both classes at its first and last score, and in between, with
#: the pairs won there.
_PARTS = ("first_pos", "first_neg", "pos", "neg", "won", "last_pos", "last_neg")


def _slice_concordance(replicates: int, seed: int):
    """Per sorted slice, _PARTS of every replicate; the scores at both ends stay open, other slices may have them, too."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg, won = (np.zeros(replicates) for _ in range(3))
        first, tie, tie_score, slice_id, scores = None, None, None, None, []

        def close(ones: np.ndarray, zeros: np.ndarray) -> None:
            """Take in scores that are passed, in order: a row of weights of each class per score."""
            nonlocal pos, neg, won, first
            if first is None:
                first, ones, zeros = np.stack([ones[0], zeros[0]]), ones[1:], zeros[1:]
            passed = zeros.cumsum(axis=0)
            won = won + (ones * (neg + passed - 0.5 * zeros)).sum(axis=0)
            pos, neg = pos + ones.sum(axis=0), neg + zeros.sum(axis=0)

        def weights(ids: np.ndarray, positive: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Copies per score (``place``) and class; sums of a block's copies fit 16 bits."""
            order = np.lexsort((positive, place))
            cell = (2 * place + positive)[order]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            table = np.zeros((2 * n, replicates))
            table[cell[starts]] = np.add.reduceat(replicate_copies(ids[order], replicates, seed), starts, axis=0)
            return table[1::2], table[::2]

        for batch in batches:
            if batch.empty:
                continue
            slice_id = int(batch["_slice"].iloc[0])
            all_ids, labels = batch["_id"].to_numpy(np.int64), batch["_label"].to_numpy() == 1
            all_values = batch["_score"].to_numpy()
            for begin in range(0, len(all_values), _BLOCK):
                at = slice(begin, begin + _BLOCK)
                values = all_values[at]
                place = np.append(0, np.cumsum(values[1:] != values[:-1]))
                ones, zeros = weights(all_ids[at], labels[at].astype(np.int64), place, int(place[-1]) + 1)
                if tie is not None and values[0] == tie_score:
                    ones[0] += tie[0]
                    zeros[0] += tie[1]
                elif tie is not None:
                    close(tie[:1], tie[1:])
                if len(ones) > 1:
                    close(ones[:-1], zeros[:-1])
                scores = [scores[0] if scores else values[0], values[-1]]
                tie, tie_score = np.stack([ones[-1], zeros[-1]]), values[-1]
        if slice_id is not None:
            one = first is None
            ends = (tie, np.zeros((2, replicates))) if one else (first, tie)
            yield pd.DataFrame({
                "_slice": slice_id, "replicate": np.arange(replicates, dtype=np.int64), "low": scores[0], "high": scores[1],
                **dict(zip(_PARTS, (*ends[0], pos, neg, won, *ends[1]), strict=True)),
            })

    return fold


def _joined_slices(slices: pd.DataFrame) -> pd.DataFrame:
    """The area of one replicate from its slices in order: a score that goes on into the next slice stays open."""
    pos = neg = won = 0.0
    score, tie_pos, tie_neg = None, 0.0, 0.0
    for s in slices.sort_values("_slice").itertuples():
        for value, p, n in ((s.low, s.first_pos, s.first_neg), (s.high, s.last_pos, s.last_neg)):
            if value != score:
                won, pos, neg = won + tie_pos * (neg + 0.5 * tie_neg), pos + tie_pos, neg + tie_neg
                score, tie_pos, tie_neg = value, 0.0, 0.0
                if value == s.high and s.low != s.high:
                    won, pos, neg = won + s.won + s.pos * neg, pos + s.pos, neg + s.neg
            tie_pos, tie_neg = tie_pos + p, tie_neg + n
    won, pos, neg = won + tie_pos * (neg + 0.5 * tie_neg), pos + tie_pos, neg + tie_neg
    area = won / (pos * neg) if pos * neg > 0 else None
    return pd.DataFrame({"replicate": slices["replicate"].iloc[:1], "auroc": pd.array([area], dtype="Float64")})


def bootstrap_areas(
    rows: DataFrame, row_id: str, label: str, score: str, replicates: int, seed: int
) -> DataFrame:
    """Area under the receiver curve of each bootstrap replicate.

    The rows are range-partitioned by score and row once, so that a score with very many rows goes over several
    tasks.  Each task walks its sorted slice and keeps a few numbers per replicate, so no row is copied per
    replicate; the slices are then joined in order, a score that two of them share as one.
    """
    numbers = ", ".join(f"{c} double" for c in ("low", "high", *_PARTS))
    slices = (
        rows.select(
            F.xxhash64(F.col(row_id)).alias("_id"), F.col(label).cast("int").alias("_label"),
            F.col(score).cast("double").alias("_score"),
        )
        .where("_score IS NOT NULL AND _label IS NOT NULL")
        .repartitionByRange("_score", "_id")
        .withColumn("_slice", F.spark_partition_id())
        .sortWithinPartitions("_score")
        .mapInPandas(_slice_concordance(replicates, seed), f"_slice int, replicate bigint, {numbers}")
    )
    # One row per slice and replicate.
    return slices.groupBy("replicate").applyInPandas(_joined_slices, "replicate bigint, auroc double")


def compare_areas(
    rows: DataFrame, row_id: str, label: str, first: str, second: str,
    replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """Difference of two scores' areas with a bootstrap interval and p value.

    Both scores see the same copies of each row, so the difference is paired.
    """
    a = areas(curve(rows, label, first)).select("auroc").scalar()
    b = areas(curve(rows, label, second)).select("auroc").scalar()
    one = bootstrap_areas(rows, row_id, label, first, replicates, seed)
    two = bootstrap_areas(rows, row_id, label, second, replicates, seed)
    gaps = one.alias("x").join(two.alias("y"), "replicate").select(
        (F.col("y.auroc") - F.col("x.auroc")).alias("gap")
    ).where(F.col("gap").isNotNull())
    return gaps.agg(
        F.percentile("gap", F.lit(0.025)).alias("auroc_diff_ci_lower"),
        F.percentile("gap", F.lit(0.975)).alias("auroc_diff_ci_upper"),
        F.avg((F.col("gap") <= 0).cast("int")).alias("auroc_diff_p_value"),
        F.count(F.lit(1)).alias("n_replicates"),
    ).withColumns({"first_auroc": a, "second_auroc": b}).withColumn(
        "auroc_delta", F.col("second_auroc") - F.col("first_auroc")
    )


# --- classifiers ------------------------------------------------------------------------


def with_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a vector of the features; rows that miss one are left out."""
    return VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="skip"
    ).transform(rows)


def train_logistic(rows: DataFrame, features: Sequence[str], label: str) -> Model:
    """M2: logistic regression with balanced class weights and a unit ridge."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")
    ).first()
    n, p = counts["n"], counts["p"]
    if not 0 < (p or 0) < n:
        raise ValueError(f"{label}: both classes are needed")
    weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * p))).otherwise(F.lit(n / (2.0 * (n - p))))
    return LogisticRegression(
        labelCol=label, weightCol="_weight", regParam=1.0 / n, standardization=False, maxIter=1000
    ).fit(with_features(rows, features).withColumn("_weight", weight))


def train_boosted(
    rows: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 6,
    step: float = 0.1, seed: int = 42,
) -> Model:
    """M3: boosted trees; a positive weighs negatives over positives."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")
    ).first()
    ratio = (counts["n"] - counts["p"]) / counts["p"] if counts["p"] else 1.0
    weight = F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0))
    return GBTClassifier(
        labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=step,
        seed=seed,
    ).fit(with_features(rows, features).withColumn("_weight", weight))


def predicted(model: Model, rows: DataFrame, features: Sequence[str], name: str = "score") -> DataFrame:
    """Rows with the model's probability of the positive class."""
    out = model.transform(with_features(rows, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def feature_importance(model: Model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """M4: features by absolute coefficient or tree importance, largest first."""
    if hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        values = model.featureImportances.toArray()
    table = [(f, float(v)) for f, v in zip(features, values)]
    return rows.sparkSession.createDataFrame(table, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def compare_models(
    rows: DataFrame, label: str, first: str, second: str,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9),
) -> DataFrame:
    """Metrics, score quantiles and correlation of two scores, one row a score."""
    long = unpivoted(rows, [first, second], [label])
    points = curve(long, label, "value", ["feature"])
    metrics = areas(points, ["feature"]).join(threshold_metrics(points, ["feature"]), "feature")
    marks = percentiles(
        long, ["feature"], "value", {f"q{round(100 * q)}": q for q in quantiles}
    )
    agreement = rows.agg(F.corr(first, second)).scalar()
    return metrics.join(marks, "feature").withColumn("correlation", agreement)
