"""Regularised quadratic discriminant on transformed text statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and a scaled identity.
The score is the difference of the two log densities, from Mahalanobis distances by the inverse
Cholesky factors, which are computed once and sent with the task; a logistic curve fitted to a
histogram of training differences turns it into a number between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import fold, labelled
from caseweave.llm.statistics import with_statistics
from caseweave.session import materialise


def transformed() -> dict[str, Column]:
    """Statistics on a scale where classes look more like normal distributions."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    lifted = lambda part, whole: F.log(F.col(part) / whole + 0.01)
    return {
        "words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.log(F.col("word_chars") / words + 0.5),
        "line_length": F.log1p(F.col("n_words") / lines),
        "symbols": lifted("n_symbols", words),
        "repeated_lines": lifted("n_dup_lines", lines),
        "repeated_words": lifted("n_repeat_words", words),
        "upper": lifted("n_upper", chars),
        "exclaims": lifted("n_exclaim", words),
        "stops": lifted("n_stops", words),
        # The share of distinct words falls with the length; the exponent of Herdan does so less.
        "distinct": F.log1p(F.col("n_distinct_words").cast("double")) / F.log1p(words.cast("double")),
        "short": lifted("n_short_words", words),
    }


@dataclass(frozen=True)
class Discriminant:
    names: tuple[str, ...]
    means: np.ndarray  # class x feature
    factors: np.ndarray  # inverse Cholesky factors, class x feature x feature
    offset: float  # log prior ratio less half the log determinant ratio
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0)."""
        squares = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (squares[0] - squares[1]) + self.offset

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.shift, -500, 500)))


def fit_discriminant(
    rows: DataFrame, label: str, names: tuple[str, ...], pooled: float = 0.3, ridge: float = 0.05
) -> Discriminant | None:
    """Class moments in one aggregate of feature sums and products; None unless both classes occur."""
    d = len(names)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy(F.col(label).alias("_y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(n) for n in names]).alias("s"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in upper]).alias("q"),
    ).collect()
    by = {r["_y"]: r for r in sums}
    if set(by) != {0, 1}:
        return None
    means, scatters = np.zeros((2, d)), np.zeros((2, d, d))
    counts = np.array([by[k]["n"] for k in (0, 1)], dtype=float)
    for k in (0, 1):
        means[k] = np.array(by[k]["s"]) / counts[k]
        for (i, j), total in zip(upper, by[k]["q"], strict=True):
            scatters[k, i, j] = scatters[k, j, i] = total / counts[k] - means[k, i] * means[k, j]
    both = (counts[:, None, None] * scatters).sum(axis=0) / counts.sum()
    factors, logdets = np.zeros((2, d, d)), np.zeros(2)
    scale = np.diag(np.maximum(np.diag(both), 1e-4))
    for k in (0, 1):
        shrunk = (1 - ridge) * ((1 - pooled) * scatters[k] + pooled * both) + ridge * scale
        lower = np.linalg.cholesky(shrunk)
        factors[k] = np.linalg.inv(lower)
        logdets[k] = 2 * np.log(np.diag(lower)).sum()
    offset = np.log(counts[1] / counts[0]) - 0.5 * (logdets[1] - logdets[0])
    return Discriminant(names, means, factors, float(offset))


def with_difference(rows: DataFrame, model: Discriminant, out: str) -> DataFrame:
    @F.pandas_udf("double")
    def difference(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(model.difference(x))

    return rows.withColumn(out, difference(*model.names))


def calibrated(rows: DataFrame, label: str, model: Discriminant, bins: int = 400) -> Discriminant:
    """Fit slope and shift by Newton steps on a histogram of clipped, compressed differences."""
    # The signed square root keeps far outliers from taking all the bins.
    root = F.signum("_d") * F.sqrt(F.abs("_d"))
    place = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), root)) * (bins / 40)).cast("int")
    found = (
        with_difference(rows, model, "_d").groupBy(place.alias("b"))
        .agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    )
    centre = np.array([r["b"] for r in found]) * 40 / bins
    x = np.column_stack([np.sign(centre) * centre**2, np.ones(len(found))])
    p, n = np.array([float(r["p"]) for r in found]), np.array([float(r["n"]) for r in found])
    beta = np.array([0.2, 0.0])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - n * mu) - 1e-2 * beta
        hessian = (x * (n * mu * (1 - mu))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Discriminant(model.names, model.means, model.factors, model.offset, max(float(beta[0]), 1e-3), float(beta[1]))


def score_quality(
    docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, threshold: float = 0.3
) -> DataFrame:
    """Per document: doc_id, held_out, score (higher: good likelier), predicted.

    The fold of a document is crc32 of its id as text modulo ``folds``; rows of the held-out fold
    give no label.  A null text counts as empty and is scored like any other.  With labels of one
    class or none, every score is 0.5.
    """
    columns = transformed()
    stats = with_statistics(docs.select("doc_id", "text")).withColumn(
        "held_out", fold("doc_id", folds) == held_out_fold
    )
    rows = materialise(stats.select("doc_id", "held_out", *[c.cast("double").alias(n) for n, c in columns.items()]))
    known = materialise(labelled(rows.where(~F.col("held_out")), labels, "quality"))
    model = fit_discriminant(known, "_label", tuple(columns))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.5))
    else:
        model = calibrated(known, "_label", model)
        z = F.lit(model.slope) * F.col("_d") + F.lit(model.shift)
        scored = with_difference(rows, model, "_d").withColumn(
            "score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
        )
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
