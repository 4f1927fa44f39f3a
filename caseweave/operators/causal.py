"""Treatment contrasts: outcome models per arm, bootstrap, propensity overlap.

A linear outcome model needs only the sums of x xᵀ and x y, so one aggregate over
the cohort gives the models of all arms and all bootstrap replicates at once: a
row enters replicate b with a number of copies drawn from its own key, the copies
are summed on the map side, and what is shuffled is one small matrix per
replicate and arm.  Binary outcomes use the same sums in a few Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.draws import copies, drawn_copies, uniform
from caseweave.plans.ordered import percentiles
from caseweave.plans.sizes import fits, take_bounded
from caseweave.session import materialise

KEY, ARM, REPLICATE = "hadm_id", "T", "replicate"


def replicated(frame: DataFrame, replicates: int, seed: int, key: str = KEY) -> DataFrame:
    """Rows with their copies in replicate 0 (all rows once) and 1..B.

    Copies are Poisson draws from a hash of seed, row key and replicate: each row
    is drawn on its own, within its arm, so no arm is gathered to be resampled.
    """
    spread = frame.withColumn(REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    draw = copies(uniform(seed, F.col(key), F.col(REPLICATE)))
    weight = F.when(F.col(REPLICATE) == 0, F.lit(1)).otherwise(draw)
    return spread.withColumn("copies", weight.cast("double")).where(F.col("copies") > 0)


def weighted(frame: DataFrame, replicates: int, seed: int, key: str = KEY) -> DataFrame:
    """Rows with ``_w``, their copies in replicates 0 to B as one array; the draws of :func:`replicated`, rows not multiplied."""
    drawn = drawn_copies(seed, [F.col(key)], F.sequence(F.lit(1), F.lit(replicates))) if replicates else F.array()
    return frame.withColumn("_w", F.concat(F.array(F.lit(1)), drawn).cast("array<tinyint>"))


# --- rows of all replicates -----------------------------------------------------------------

#: Stands for a row without an arm.
NO_ARM = -(2**31)
#: Merged rows that a task holds before it hands them on.
MOST_MERGED = 20_000
_ROWS = "_arm int, _x array<double>, _y double, _w array<int>"

#: Arm (or another place of a table), covariates, outcome and copies by replicate.
Part = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arm, covariates, outcome and copies of a batch; the last as one column per replicate."""
    arm, y = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_arm", "_y"))
    x, w = (batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("_x", "_w"))
    return arm, x, y, w.astype(float)


def _lists(table: np.ndarray) -> pa.ListArray:
    """One list per row of a table."""
    ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(table).reshape(-1)))


def _folded(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal keys as one, their sums added."""
    order = np.lexsort(keys.T)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[starts], np.add.reduceat(sums[order], starts, axis=0)


def _cut(held: tuple[np.ndarray, np.ndarray], made: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(held[0]), 4096):
        yield made(held[0][i : i + 4096], held[1][i : i + 4096])


def _folding(
    split: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], made: Callable[[np.ndarray, np.ndarray], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold the rows of a task by their keys; what does not fold is handed on, so a task holds a bounded number of rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _folded(*split(batch))
            held = own if held is None else _folded(*(np.concatenate(both) for both in zip(held, own, strict=True)))
            if len(held[0]) > MOST_MERGED:
                yield from _cut(held, made)
                held = None
        if held is not None:
            yield from _cut(held, made)

    return fold


def _row_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    arm, x, y, w = _columns_of(batch)
    return np.column_stack([arm, x, y]), w


def _merged_rows(keys: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[:, 0].astype(np.int32)), _lists(keys[:, 1:-1]), pa.array(keys[:, -1]), _lists(w.astype(np.int32))],
        names=["_arm", "_x", "_y", "_w"],
    )


def _prepared(known: DataFrame, x: Sequence[Column], y: Column, arm: Column, replicates: int, seed: int, key: str) -> DataFrame:
    """The rows that batches are made of; written, since every Newton step reads them.

    A model can't tell rows of equal arm, covariates and outcome apart: a task hands them on as one, their copies
    summed.  Replicate 0 has every row once, so its copies are the number of rows.
    """
    return materialise(weighted(known, replicates, seed, key).select(
        F.coalesce(arm.cast("int"), F.lit(NO_ARM)).alias("_arm"), F.array(*x).cast("array<double>").alias("_x"),
        y.cast("double").alias("_y"), "_w",
    ).mapInArrow(_folding(_row_keys, _merged_rows), _ROWS))


def _by_arm(batch: pa.RecordBatch) -> Iterator[Part]:
    arm, x, y, w = _columns_of(batch)
    for a in np.unique(arm).tolist():
        at = arm == a
        yield a, x[at], y[at], w[at]


def _summed(rows: DataFrame, of: Callable[[pa.RecordBatch, dict], None], width: int) -> dict[tuple, np.ndarray]:
    """Sums by (replicate, arm) of what ``of`` adds to a task's table of arrays; one row per model and task is shuffled."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                of(batch, table)
        keys = list(table)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([table[k].tolist() for k in keys], pa.list_(pa.float64())),
        ], names=["r", "a", "s"])

    sums = rows.mapInArrow(made, "r int, a int, s array<double>").groupBy("r", "a").agg(
        F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")
    )
    return {(row["r"], row["a"]): np.array(row["s"], dtype=float) for row in sums.collect()}


def _add(table: dict, place: int, sums: np.ndarray) -> None:
    """Add one column of sums per replicate."""
    for r, found in enumerate(sums.T):
        table[r, place] = table.get((r, place), 0) + found


# --- linear and logistic models -------------------------------------------------------------


def _matrix(upper: np.ndarray, k: int) -> np.ndarray:
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = upper
    return full + np.triu(full, 1).T


def _known(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _products(x: np.ndarray) -> np.ndarray:
    """The upper half of x xᵀ of each row; a missing covariate adds nothing."""
    first, second = np.triu_indices(x.shape[1])
    known = _known(x)
    return known[:, first] * known[:, second]


def solved(sums: dict[tuple, np.ndarray], k: int) -> dict[tuple, np.ndarray]:
    """Least-squares coefficients from sums of x xᵀ and x y."""
    m = k * (k + 1) // 2
    return {key: np.linalg.lstsq(_matrix(s[:m], k), s[m : m + k], rcond=None)[0] for key, s in sums.items()}


def fit_linear(rows: DataFrame, k: int, parts: Callable[[pa.RecordBatch], Iterator[Part]] = _by_arm) -> dict[tuple, np.ndarray]:
    """Least-squares coefficients per (replicate, place) of :func:`_prepared` rows, from one pass."""

    def add(batch: pa.RecordBatch, table: dict) -> None:
        for a, x, y, w in parts(batch):
            _add(table, a, np.concatenate([_products(x).T @ w, (_known(x) * y[:, None]).T @ w, w.sum(axis=0)[None, :]]))

    found = _summed(rows, add, k * (k + 1) // 2 + k + 1)
    return solved({key: s for key, s in found.items() if s[-1] > 0}, k)


def sigmoid(z: np.ndarray) -> np.ndarray:
    # Beyond 700 the exponential leaves a double's range; the chance is 0 there, too.
    return 1.0 / (1.0 + np.exp(np.minimum(-z, 700.0)))


def fit_logistic(
    rows: DataFrame, k: int, parts: Callable[[pa.RecordBatch], Iterator[Part]] = _by_arm,
    ridge: float = 1.0, tolerance: float = 1e-9, free: Sequence[int] = (0,),
) -> dict[tuple, np.ndarray]:
    """Logistic coefficients per (replicate, place) of :func:`_prepared` rows, by Newton steps with a unit ridge.

    The coefficients of all replicates go to the tasks with the step; a batch is multiplied with all of them at once, and
    only one small matrix per model and task is shuffled.  Steps end when no coefficient moves by more than ``tolerance``,
    and it is an error if a hundred don't get there.  Columns listed in ``free`` (the constant) are not penalised.
    """
    m = k * (k + 1) // 2
    penalty = np.full(k, float(ridge))
    penalty[list(free)] = 0.0

    def count(batch: pa.RecordBatch, table: dict) -> None:
        for a, _, _, w in parts(batch):
            _add(table, a, w.sum(axis=0)[None, :])

    betas = {key: np.zeros(k) for key, s in _summed(rows, count, 1).items() if s[0] > 0}

    def stepped(current: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
        def add(batch: pa.RecordBatch, table: dict) -> None:
            for a, x, y, w in parts(batch):
                beta = np.stack([current.get((r, a), np.zeros(k)) for r in range(w.shape[1])], axis=1)
                p = sigmoid(x @ beta)
                _add(table, a, np.concatenate([_products(x).T @ (w * p * (1 - p)), x.T @ (w * (y[:, None] - p))]))

        new = {}
        for key, totals in _summed(rows, add, m + k).items():
            if key in current:
                beta, xx = current[key], _matrix(totals[:m], k) + np.diag(penalty)
                new[key] = beta + np.linalg.lstsq(xx, totals[m:] - penalty * beta, rcond=None)[0]
        return new

    for _ in range(100):
        before, betas = betas, stepped(betas)
        if all(np.abs(betas[g] - before[g]).max() <= tolerance for g in betas):
            return betas
    raise RuntimeError("the logistic model did not settle in 100 steps")


def constant_and(covariates: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]


def _table(frame: DataFrame, values: dict[tuple, float], name: str) -> DataFrame:
    """(replicate, T, value) rows; one per replicate and arm, as many as the caller asked for."""
    kind = dict(frame.dtypes)[ARM]
    rows = [(r, None if a == NO_ARM else a, float(v)) for (r, a), v in sorted(values.items())]
    return frame.sparkSession.createDataFrame(rows, f"{REPLICATE} int, {ARM} int, {name} double").withColumn(
        ARM, F.col(ARM).cast(kind)
    )


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def mean_prediction(
    rows: DataFrame, models: dict[tuple, np.ndarray], k: int, binary: bool,
    features: Callable[[np.ndarray], np.ndarray] = lambda x: x,
) -> dict[tuple, float]:
    """Mean over the cohort of each (replicate, arm) model's prediction; ``features`` makes the model's ``k`` from a row's covariates.

    A linear mean is the prediction at the mean, so it needs k numbers of the
    cohort.  A logistic mean takes one pass, in which a batch of rows is multiplied
    with the models of all replicates.
    """
    if not models:
        return {}
    if not binary:
        def add_means(batch: pa.RecordBatch, table: dict) -> None:
            _, x, _, w = _columns_of(batch)
            x, n = features(x), w[:, 0]
            sums = np.concatenate([_known(x).T @ n, (~np.isnan(x)).T @ n])
            table[0, 0] = table.get((0, 0), 0) + sums

        sums = _summed(rows, add_means, 2 * k)[0, 0]
        return {key: float(sums[:k] / sums[k:] @ beta) for key, beta in models.items()}
    keys, table_of = list(models), np.array(list(models.values())).T

    def add(batch: pa.RecordBatch, table: dict) -> None:
        _, x, _, w = _columns_of(batch)
        n = w[:, 0]
        for key, total in zip(keys, n @ sigmoid(features(x) @ table_of), strict=True):
            table[key] = table.get(key, 0) + np.array([total, n.sum()])

    return {key: float(s[0] / s[1]) for key, s in _summed(rows, add, 2).items()}


# --- ordinal outcomes ----------------------------------------------------------------------

#: Levels of an ordinal outcome; more is an error, since every level has its own coefficients.
MOST_LEVELS = 50
#: Chances that differ by less count as equal; the lowest level wins.
EVEN = 1e-6


def levels_of(frame: DataFrame, outcome: str) -> list[float]:
    """The distinct values of an ordinal outcome, ascending."""
    rows = frame.where(F.col(outcome).isNotNull()).select(F.col(outcome).cast("double").alias("v")).distinct()
    return sorted(r["v"] for r in take_bounded(rows, MOST_LEVELS, f"levels of {outcome}"))


def _shares(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The chance of every level for the rows of ``x``; absent levels have an infinite constant."""
    z = x @ np.where(np.isfinite(model), model, 0.0).T + np.where(np.isfinite(model[:, 0]), 0.0, -np.inf)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def level_values(x: np.ndarray, model: np.ndarray, levels: Sequence[float], expected: bool) -> np.ndarray:
    """The most likely level of each row, or the mean level."""
    p = _shares(x, model)
    if expected:
        return p @ np.asarray(levels)
    return np.asarray(levels)[np.argmax(p >= p.max(axis=1, keepdims=True) - EVEN, axis=1)]


def fit_levels(
    rows: DataFrame, levels: Sequence[float], k: int, *, ridge: float = 1.0, free: Sequence[int] = (0,), tolerance: float = 1e-10,
) -> dict[tuple, np.ndarray]:
    """Multinomial models of (``_arm``, ``_x``, ``_y``, ``_w``) rows: per (replicate, arm) one row of coefficients per level.

    Newton steps with the whole Hessian (levels x covariates), summed in the tasks for all replicates at once.  The
    ridge is on all coefficients but those of ``free``; levels that a replicate's arm lacks have no chance
    there.  Steps end when none promises to raise a log-likelihood by more than ``tolerance``: a level that a
    corner of the covariates lacks moves its coefficients on and on, to no effect.  What reaches the driver
    is one small matrix per replicate and arm.
    """
    n, size = len(levels), len(levels) * k
    upper = np.triu_indices(size)
    known = {v: i for i, v in enumerate(levels)}

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        arm, x, y, w = _columns_of(batch)
        own = np.eye(n)[[known[v] for v in y.tolist()]]
        for a in np.unique(arm).tolist():
            at = arm == a
            yield a, x[at], own[at], w[at]

    def count(batch: pa.RecordBatch, table: dict) -> None:
        for a, _, own, w in parts(batch):
            for r, found in enumerate(w.T @ own):
                table[r, a] = table.get((r, a), 0) + found

    present = {key: found > 0 for key, found in _summed(rows, count, n).items()}
    penalty = np.full(k, float(ridge))
    penalty[list(free)] = 0.0
    models = {key: np.where(has[:, None], 0.0, -np.inf) * np.ones((1, k)) for key, has in present.items() if has.any()}

    for _ in range(200):
        current = models

        def step(batch: pa.RecordBatch, table: dict) -> None:
            for a, x, own, w in parts(batch):
                outer = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
                for r in range(w.shape[1]):
                    used = w[:, r] > 0
                    if (r, a) not in current or not used.any():
                        continue
                    p, weight = _shares(x[used], current[r, a]), w[used, r]
                    slope = ((own[used] - p) * weight[:, None]).T @ x[used]
                    second = np.einsum("nc,nd->ncd", p, -p)
                    second[:, range(n), range(n)] += p
                    bend = ((second * weight[:, None, None]).reshape(len(p), -1).T @ outer[used]).reshape(n, n, k, k)
                    bend = bend.transpose(0, 2, 1, 3).reshape(size, size)
                    table[r, a] = table.get((r, a), 0) + np.concatenate([slope.ravel(), bend[upper]])

        models, gained = {}, 0.0
        for key, found in _summed(rows, step, size + len(upper[0])).items():
            model = current[key]
            live = np.repeat(np.isfinite(model[:, 0]), k)
            flat = np.where(live, model.ravel(), 0.0)
            bend = np.zeros((size, size))
            bend[upper] = found[size:]
            bend = bend + np.triu(bend, 1).T + np.diag(np.tile(penalty, n))
            slope = found[:size] - np.tile(penalty, n) * flat
            change = np.zeros(size)
            change[live] = np.linalg.lstsq(bend[np.ix_(live, live)], slope[live], rcond=1e-12)[0]
            gained = max(gained, float(slope @ change))
            # Far from the optimum a whole step may overshoot.
            change *= min(1.0, 5.0 / max(np.abs(change).max(), 1e-300))
            models[key] = np.where(live, flat + change, -np.inf).reshape(n, k)
        if gained <= tolerance:
            return models
    raise RuntimeError("the model of levels did not settle in 200 steps")


def mean_levels(
    rows: DataFrame, models: dict[tuple, np.ndarray], levels: Sequence[float], expected: bool,
    features: Callable[[np.ndarray], np.ndarray] = lambda x: x,
) -> dict[tuple, float]:
    """Mean over the cohort of each (replicate, arm) model's level."""
    def add(batch: pa.RecordBatch, table: dict) -> None:
        _, x, _, w = _columns_of(batch)
        x, n = features(x), w[:, 0]
        for key, model in models.items():
            table[key] = table.get(key, 0) + np.array([n @ level_values(x, model, levels, expected), n.sum()])

    return {key: float(s[0] / s[1]) for key, s in _summed(rows, add, 2).items()}


def _ordinal(frame: DataFrame, values: dict[tuple, float]) -> DataFrame:
    return _table(frame.withColumn(ARM, F.lit(0)), values, "mu")


def ordinal_learner(
    frame: DataFrame, covariates: Sequence[str], outcome: str, n_arms: int, *, single: bool = False,
    replicates: int = 0, seed: int = 0, key: str = KEY, ridge: float = 1.0, expected: bool = False,
) -> DataFrame:
    """E1 and E2 for an ordinal outcome: (replicate, T, mu), mu the mean of the levels given to the cohort's rows.

    A row is given its most likely level under the arm's model, or with ``expected`` the mean of the
    levels by their chances.  ``single`` fits one model with the arm as 0/1 columns in place of one per arm.
    """
    known = frame.where(F.col(outcome).isNotNull())
    y, plain = F.col(outcome).cast("double"), constant_and(covariates)
    if not single:
        rows = _prepared(known, plain, y, F.col(ARM), replicates, seed, key)
        levels = levels_of(rows.withColumnRenamed("_y", outcome), outcome)
        return _ordinal(frame, mean_levels(rows, fit_levels(rows, levels, len(plain), ridge=ridge), levels, expected))
    marks = [(F.col(ARM) == a).cast("double") for a in range(n_arms)]
    rows = _prepared(known, [*marks, *plain[1:]], y, F.lit(0), replicates, seed, key)
    levels = levels_of(rows.withColumnRenamed("_y", outcome), outcome)
    both = fit_levels(rows, levels, n_arms + len(covariates), ridge=ridge, free=range(n_arms))
    # With the arm fixed, its column is the constant.
    models = {(r, a): np.delete(m, [i for i in range(n_arms) if i != a], axis=1) for (r, _), m in both.items() for a in range(n_arms)}
    return _ordinal(frame, mean_levels(rows, models, levels, expected, lambda x: _with_constant(x[:, n_arms:])))


def t_learner(
    frame: DataFrame, covariates: Sequence[str], outcome: str, *, binary: bool = False,
    replicates: int = 0, seed: int = 0, key: str = KEY,
) -> DataFrame:
    """(replicate, T, mu) from one outcome model per arm."""
    known = frame.where(F.col(outcome).isNotNull())
    x, k = constant_and(covariates), 1 + len(covariates)
    rows = _prepared(known, x, F.col(outcome), F.col(ARM), replicates, seed, key)
    models = (fit_logistic if binary else fit_linear)(rows, k)
    return _table(frame, mean_prediction(rows, models, k, binary), "mu")


def s_learner(
    frame: DataFrame, covariates: Sequence[str], outcome: str, n_arms: int, *,
    binary: bool = False, replicates: int = 0, seed: int = 0, key: str = KEY,
) -> DataFrame:
    """(replicate, T, mu) from one model with the arm as 0/1 columns.

    The arm is then set to each value in turn for every row.
    """
    known, n = frame.where(F.col(outcome).isNotNull()), len(covariates)
    marks = [F.coalesce(F.col(ARM) == a, F.lit(False)).cast("double") for a in range(n_arms)]
    x = [*constant_and(covariates)[1:], *marks]
    rows = _prepared(known, x, F.col(outcome), F.lit(0), replicates, seed, key)
    models = fit_logistic(rows, len(x), free=range(n, len(x))) if binary else fit_linear(rows, len(x))
    # With the arm fixed, its coefficient is the constant.
    one_arm = {(r, a): np.append(beta[n + a], beta[:n]) for (r, _), beta in models.items() for a in range(n_arms)}
    means = mean_prediction(rows, one_arm, 1 + n, binary, lambda x: _with_constant(x[:, :n]))
    return _table(known.withColumn(ARM, F.lit(0)), means, "mu")


def x_learner(
    frame: DataFrame, covariates: Sequence[str], outcome: str, n_arms: int, *,
    binary: bool = False, replicates: int = 0, seed: int = 0, key: str = KEY, ordinal: bool = False, ridge: float = 1.0,
) -> DataFrame:
    """(replicate, T, effect) of each arm against arm 0, propensity-blended.

    Treated rows impute their effect with the control model, control rows with the
    arm's model; a linear model of each is averaged with the chance of the arm.
    All models are small and go to the tasks: the rows are read once for the sums of all replicates and
    arms, and once for the means, and are never joined or multiplied.
    """
    known = frame.where(F.col(outcome).isNotNull())
    x, k = constant_and(covariates), 1 + len(covariates)
    rows = _prepared(known, x, F.col(outcome), F.col(ARM), replicates, seed, key)
    levels = levels_of(rows.withColumnRenamed("_y", outcome), outcome) if ordinal else []
    if ordinal:
        models = fit_levels(rows, levels, k, ridge=ridge)
    else:
        models = (fit_logistic if binary else fit_linear)(rows, k)
    arms, size = range(1, n_arms), replicates + 1

    def values(features: np.ndarray, place: int) -> np.ndarray:
        """What each replicate's model of an arm says of the rows; nought where there is none."""
        out = np.zeros((len(features), size))
        has = [r for r in range(size) if (r, place) in models]
        if ordinal:
            for r in has:
                out[:, r] = level_values(features, models[r, place], levels, False)
        elif has:
            z = features @ np.stack([models[r, place] for r in has], axis=1)
            out[:, has] = sigmoid(z) if binary else z
        return out

    def gains(batch: pa.RecordBatch, table: dict) -> None:
        arm, features, own, copies_ = _columns_of(batch)

        def add(place: int, other: int, at: np.ndarray, sign: int) -> None:
            has = np.array([(r, other) in models for r in range(size)])
            if at.any() and has.any():
                w, z = copies_[at], features[at]
                gain = sign * (own[at][:, None] - values(z, other))
                found = np.concatenate([_products(z).T @ w, z.T @ (w * gain)])
                for r in np.flatnonzero(has).tolist():
                    table[r, place] = table.get((r, place), 0) + found[:, r]

        # Place 2a holds what arm a's rows say of its effect, 2a + 1 what the controls say.
        for a in arms:
            add(2 * a, 0, arm == a, 1)
            add(2 * a + 1, a, arm == 0, -1)

    effects = solved(_summed(rows, gains, k * (k + 1) // 2 + k), k)

    def against(batch: pa.RecordBatch) -> Iterator[Part]:
        arm, features, _, copies_ = _columns_of(batch)
        for a in arms:
            at = (arm == 0) | (arm == a)
            if at.any():
                yield a, features[at], (arm[at] > 0).astype(float), copies_[at][:, :1]

    # Chance of each arm against the control, on the cohort as it is.
    chance = {a: beta for (_, a), beta in fit_logistic(rows, k, against).items()}

    def by_chance(batch: pa.RecordBatch, table: dict) -> None:
        _, features, _, copies_ = _columns_of(batch)
        n = copies_[:, 0]
        for a in arms:
            if a in chance:
                e = sigmoid(features @ chance[a])
                found = np.concatenate([features.T @ (n * e), features.T @ (n * (1 - e)), [n.sum()]])
                table[0, a] = table.get((0, a), 0) + found

    # An effect is linear in the covariates, so its mean needs their sums, weighted by the chance.
    means = {
        (r, a): (s[:k] @ effects[r, 2 * a + 1] + s[k : 2 * k] @ effects[r, 2 * a]) / s[-1]
        for (_, a), s in _summed(rows, by_chance, 2 * k + 1).items() for r in range(size)
        if (r, 2 * a) in effects and (r, 2 * a + 1) in effects
    }
    return _table(frame.withColumn(ARM, F.lit(0)), means, "effect")


def boosted_means(
    frame: DataFrame, covariates: Sequence[str], outcome: str, n_arms: int, rounds: int = 200,
    depth: int = 6, step: float = 0.3, seed: int = 0,
) -> DataFrame:
    """E1 with boosted trees per arm, for a point estimate of a continuous outcome.

    Squared error tells rows of equal arm and covariates apart by nothing but their number and mean, so such rows are one,
    weighted by their number.
    """
    # Written once: the boosting of every arm reads it, and the means do.
    merged = frame.where(F.col(outcome).isNotNull()).groupBy(ARM, *dict.fromkeys(covariates)).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(F.col(outcome).cast("double")).alias("_y")
    )
    known = materialise(VectorAssembler(inputCols=list(covariates), outputCol="features").transform(merged).select(
        ARM, "_n", "_y", "features"
    ))
    mean = (F.sum(F.col("prediction") * F.col("_n")) / F.sum("_n")).alias("mu")
    parts = []
    for arm in range(n_arms):
        model = GBTRegressor(
            labelCol="_y", weightCol="_n", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed + arm
        ).fit(known.where(F.col(ARM) == arm))
        parts.append(model.transform(known).agg(mean).select(F.lit(arm).alias(ARM), "mu"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- boosted trees of all replicates --------------------------------------------------------

#: Places of a covariate: up to 30 quantiles cut it, and the last place is that of missing values.
PLACES = 32
#: A child node needs this many copies.
LEAST_COPIES = 1.0
#: So many cells fit a task that grows whole models; a task grows those of so many replicates.
MOST_CELLS, MODELS_PER_TASK = 50_000, 4


@dataclass(frozen=True)
class Forest:
    """The trees of one round: per level and arm, covariate and cut by (replicate, node), then the leaves' values."""

    levels: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    leaves: dict[int, np.ndarray]

    def nodes(self, x: np.ndarray, arm: int, replicates: int) -> np.ndarray:
        """(rows, replicates): the node that the levels grown so far lead to."""
        node, own = np.zeros((len(x), replicates), dtype=np.int64), np.arange(replicates)[None, :]
        rows = np.arange(len(x))[:, None]
        for level in self.levels:
            covariate, cut = level[arm]
            node = 2 * node + (x[rows, covariate[own, node]] > cut[own, node])
        return node

    def values(self, x: np.ndarray, arm: int, replicates: int) -> np.ndarray:
        return self.leaves[arm][np.arange(replicates)[None, :], self.nodes(x, arm, replicates)]


def placed(frame: DataFrame, covariates: Sequence[str]) -> list[Column]:
    """The place of each covariate among its quantiles, found by one aggregate; what is missing has the last place."""
    shares = F.lit([(i + 1) / (PLACES - 1) for i in range(PLACES - 2)])
    values = [F.col(c).cast("double") for c in covariates]
    found = frame.agg(*[
        F.percentile_approx(F.when(~F.isnan(v), v), shares, F.lit(10_000)).alias(f"c{i}") for i, v in enumerate(values)
    ]).first()

    def place(v: Column, cuts: Sequence[float]) -> Column:
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < v))
        return F.when(v.isNull() | F.isnan(v), F.lit(PLACES - 1)).otherwise(below).cast("double")

    return [place(v, sorted(set(cuts or []))) for v, cuts in zip(values, found, strict=True)]


def _cell_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arm and places of a batch of cells, their copies and sums of outcomes; the last two as one column per replicate."""
    x, w, wy = (batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for n in ("_x", "_w", "_wy"))
    return batch.column("_arm").to_numpy(zero_copy_only=False), x.astype(np.int64), w, wy


def _cells(known: DataFrame, x: Sequence[Column], y: Column, replicates: int, seed: int, key: str) -> DataFrame:
    """Rows of equal arm and places as one, with ``_w`` and ``_wy``: their copies and sums of outcomes by replicate."""
    size, schema = replicates + 1, "_arm int, _x array<double>, _w array<double>, _wy array<double>"

    def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        arm, places, y_, w = _columns_of(batch)
        return np.column_stack([arm, places]), np.concatenate([w, w * y_[:, None]], axis=1)

    def of_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        arm, places, w, wy = _cell_columns(batch)
        return np.column_stack([arm, places]).astype(float), np.concatenate([w, wy], axis=1)

    def made(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0].astype(np.int32)), _lists(keys[:, 1:]), _lists(sums[:, :size]), _lists(sums[:, size:])],
            names=["_arm", "_x", "_w", "_wy"],
        )

    rows = weighted(known, replicates, seed, key).select(
        F.col(ARM).cast("int").alias("_arm"), F.array(*x).alias("_x"), y.cast("double").alias("_y"), "_w"
    )
    cells = rows.mapInArrow(_folding(of_rows, made), schema).repartition("_arm", "_x")
    return materialise(cells.mapInArrow(_folding(of_cells, made), schema))


def _best_cuts(sums: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut, gain and the means on both sides, from rows of residual and copy sums per place."""
    left = sums.cumsum(axis=2)[:, :, :-1]
    whole = sums.sum(axis=2)
    g, h, (g_all, h_all) = left[:, 0], left[:, 1], whole.T
    g_right, h_right = g_all[:, None] - g, h_all[:, None] - h
    # A cut with no copy on one side is none; a float hides the order in which sums were added.
    real = (h >= LEAST_COPIES) & (h_right >= LEAST_COPIES)
    h, h_right = np.where(real, h, 1.0), np.where(real, h_right, 1.0)
    gain = g**2 / (h + shrink) + g_right**2 / (h_right + shrink) - (g_all**2 / (h_all + shrink))[:, None]
    gain = np.where(real, gain, -1.0).astype(np.float32)
    cut = gain.argmax(axis=1)
    at = np.arange(len(gain)), cut
    best, small = gain[at], 1e-9 * np.maximum(1.0, np.abs(g_all))
    split = best > small
    return (
        np.where(split, cut, PLACES).astype(np.int32), np.where(split, best, 0.0).astype(float),
        np.where(split, g[at] / (h[at] + shrink), g_all / (h_all + shrink)),
        np.where(split, g_right[at] / (h_right[at] + shrink), 0.0),
    )


def _splits(shrink: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best cut of each (arm, replicate, node, covariate) row of residual and copy sums per place."""

    def best_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, 2, PLACES)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("a", "r", "node", "f")], *[pa.array(v) for v in _best_cuts(sums, shrink)]],
                names=["a", "r", "node", "f", "cut", "gain", "low", "high"],
            )

    return best_cuts


def _histogram(x: np.ndarray, gap: np.ndarray, copies_: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
    """Sums of residuals and copies by (covariate, which, replicate, node, place)."""
    models, k = node.shape[1], x.shape[1]
    node = node + width * np.arange(models)[None, :]
    table = np.empty((k, 2, models * width * PLACES))
    for f in range(k):
        place = (node * PLACES + x[:, f][:, None]).ravel()
        for i, what in enumerate((gap, copies_)):
            table[f, i] = np.bincount(place, what.ravel(), minlength=models * width * PLACES)
    return table


def _node_sums(table: np.ndarray, models: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replicate and node of the nodes that hold copies, and their sums by (covariate, node, which, place)."""
    cells = table.reshape(len(table), 2, models, width, PLACES)
    r, node = np.nonzero(cells[0, 1].sum(axis=2) > 0)
    return r, node, cells[:, :, r, node].transpose(0, 2, 1, 3)


def _boosted_apart(
    rows: DataFrame, start: dict[tuple, float], arms: Sequence[int], size: int, rounds: int, depth: int, rate: float, shrink: float,
) -> dict[tuple, float]:
    """What boosting adds to the mean of each (replicate, arm): the cells are few, so a task grows whole models of some replicates."""
    tasks = -(-size // MODELS_PER_TASK)

    def own_part(name: str, b: int) -> Column:
        return F.slice(name, b * MODELS_PER_TASK + 1, MODELS_PER_TASK).alias(name)

    dealt = rows.select("_arm", "_x", F.element_at("_w", 1).alias("n"), F.inline(F.array(*[
        F.struct(F.lit(b).alias("b"), own_part("_w", b), own_part("_wy", b)) for b in range(tasks)
    ]))).repartition(2 * tasks, "b")

    def grow(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        arm, x, w, wy = _cell_columns(batch)
        n, first, models = batch.column("n").to_numpy(zero_copy_only=False), batch.column("b")[0].as_py() * MODELS_PER_TASK, w.shape[1]
        out = []
        for a in arms:
            at = arm == a
            own, copies_, outcomes = x[at], w[at], wy[at]
            said = np.tile([start.get((first + r, a), 0.0) for r in range(models)], (len(x), 1))
            total = np.zeros(models)
            for _ in range(rounds):
                gap, tree = outcomes - copies_ * said[at], Forest([], {})
                for level in range(depth):
                    width = 2**level
                    r, node, sums = _node_sums(_histogram(own, gap, copies_, tree.nodes(own, a, models), width), models, width)
                    found = [v.reshape(len(sums), -1) for v in _best_cuts(sums.reshape(-1, 2, PLACES), shrink)]
                    # Of equal gains the first covariate's counts.
                    best = found[1].argmax(axis=0), np.arange(len(r))
                    covariate, cut = np.zeros((models, width), np.int64), np.full((models, width), PLACES, np.int64)
                    value = np.zeros((models, width, 2))
                    covariate[r, node], cut[r, node] = best[0], found[0][best]
                    value[r, node] = np.stack([found[2][best], found[3][best]], axis=1)
                    tree = Forest([*tree.levels, {a: (covariate, cut)}], {a: rate * value.reshape(models, 2 * width)})
                added = tree.values(x, a, models)
                said += added
                total += n @ added / n.sum()
            out += [(first + r, a, float(total[r])) for r in range(models)]
        return pa.table({"r": pa.array([o[0] for o in out], pa.int32()), "a": pa.array([o[1] for o in out], pa.int32()),
                         "mu": pa.array([o[2] for o in out], pa.float64())})

    grown = dealt.groupBy("b").applyInArrow(grow, "r int, a int, mu double").collect()
    return {(row["r"], row["a"]): row["mu"] for row in grown}


def boosted_learner(
    frame: DataFrame, covariates: Sequence[str], outcome: str, n_arms: int, *, replicates: int = 200, seed: int = 0,
    key: str = KEY, rounds: int = 200, depth: int = 6, rate: float = 0.3, shrink: float = 1.0, write_every: int = 5,
) -> DataFrame:
    """E1 and E4 with boosted trees for a continuous outcome: (replicate, T, mu) from one model per arm and replicate.

    Trees tell rows apart by arm and places only, so rows of equal ones are a cell that holds, per replicate, their
    copies and the sum of their outcomes; there are at most as many cells as rows.
    Where the cells are few enough for a task, tasks grow the whole models of some replicates each.  Otherwise
    all trees of a round grow at once: a level is one pass over the cells, in which a task sums residuals and copies by
    (arm, replicate, node, covariate, place), and Spark adds up those sums and picks the best cut of each
    node.  Rows are never multiplied.  What reaches the driver is one cut per node of the level.  Every ``write_every`` rounds the
    cells are written with what the trees say of them, so no more rounds than that go to the tasks.

    Means of nodes are shrunk as by ``shrink`` rows of no residual.  Cuts are quantiles of the cohort.  Rows that lack
    the outcome or the arm are left out; missing covariates go to the right of every cut.  An arm without
    rows has no model; a replicate that draws none of an arm's rows has no model of that arm.
    """
    wanted = dict.fromkeys([key, ARM, outcome, *covariates])
    known = materialise(frame.where(F.col(outcome).isNotNull() & F.col(ARM).isNotNull()).select(*wanted))
    size, k = replicates + 1, len(covariates)
    rows = _cells(known, placed(known, covariates), F.col(outcome), replicates, seed, key)

    def add_outcomes(batch: pa.RecordBatch, table: dict) -> None:
        arm, _, w, wy = _cell_columns(batch)
        for a in np.unique(arm).tolist():
            at = arm == a
            _add(table, a, np.stack([wy[at].sum(axis=0), w[at].sum(axis=0)]))

    start = {place: s[0] / s[1] for place, s in _summed(rows, add_outcomes, 2).items() if s[1] > 0}
    arms = sorted({a for _, a in start if 0 <= a < n_arms})
    constant = {a: np.array([start.get((r, a), 0.0) for r in range(size)]) for a in arms}
    added: dict[tuple, float] = dict.fromkeys(start, 0.0)
    apart = fits(rows, MOST_CELLS)
    if apart:
        added |= _boosted_apart(rows, start, arms, size, rounds, depth, rate, shrink)
    fitted: DataFrame = rows.where(F.col("_arm").isin(arms)).withColumn("_f", F.lit(None).cast("array<double>"))
    sums = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(2 * PLACES)]).alias("s")
    best = F.max_by(F.struct("f", "cut", "low", "high"), F.struct("gain", -F.col("f"))).alias("b")

    def said(batch: pa.RecordBatch, a: int, at: np.ndarray, x: np.ndarray, forests: Sequence[Forest]) -> np.ndarray:
        """What the models so far say of arm ``a``'s rows, by replicate."""
        before = batch.column("_f")
        if before.null_count:
            out = np.tile(constant[a], (len(x), 1))
        else:
            out = before.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[at].copy()
        for forest in forests:
            out += forest.values(x, a, size)
        return out

    def grown(rows_: DataFrame, forests: Sequence[Forest], tree: Forest) -> pd.DataFrame:
        width = 2 ** len(tree.levels)

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                arm, x, w, wy = _cell_columns(batch)
                for a in np.unique(arm).tolist():
                    at = arm == a
                    copies_, own = w[at], x[at]
                    gap = wy[at] - copies_ * said(batch, a, at, own, forests)
                    tables[a] = tables.get(a, 0) + _histogram(own, gap, copies_, tree.nodes(own, a, size), width)
            for a, table in tables.items():
                r, node, values = _node_sums(table, size, width)
                n = k * len(r)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, a, np.int32)), pa.array(np.tile(r, k).astype(np.int32)),
                    pa.array(np.tile(node, k).astype(np.int32)), pa.array(np.repeat(np.arange(k), len(r)).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * PLACES, pa.int32()), pa.array(values.reshape(-1))),
                ], names=["a", "r", "node", "f", "s"])

        found = rows_.mapInArrow(histograms, "a int, r int, node int, f int, s array<double>")
        cuts = found.groupBy("a", "r", "node", "f").agg(sums).mapInArrow(
            _splits(shrink), "a int, r int, node int, f int, cut int, gain double, low double, high double"
        )
        return cuts.groupBy("a", "r", "node").agg(best).select("a", "r", "node", "b.*").toPandas()

    forests: list[Forest] = []
    for done in range(1, 1 if apart else rounds + 1):
        tree = Forest([], {})
        for level in range(depth):
            found, width = grown(fitted, forests, tree), 2**level
            cuts, leaves = {}, {}
            for a in arms:
                covariate, cut = np.zeros((size, width), np.int64), np.full((size, width), PLACES, np.int64)
                value = np.zeros((size, width, 2))
                part = found[found["a"] == a]
                at = part["r"].to_numpy(), part["node"].to_numpy()
                covariate[at], cut[at] = part["f"].to_numpy(), part["cut"].to_numpy()
                value[at] = part[["low", "high"]].to_numpy()
                cuts[a], leaves[a] = (covariate, cut), rate * value.reshape(size, 2 * width)
            tree = Forest([*tree.levels, cuts], leaves)
        forests.append(tree)
        if done % write_every and done < rounds:
            continue
        latest = forests

        def add_means(batch: pa.RecordBatch, table: dict) -> None:
            _, x, w, _ = _cell_columns(batch)
            n = w[:, 0]
            for a in arms:
                total = n @ sum(forest.values(x, a, size) for forest in latest)
                _add(table, a, np.stack([total, np.full(size, n.sum())]))

        for place, s in _summed(rows, add_means, 2).items():
            if place in added:
                added[place] += s[0] / s[1]

        def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arm, x, _, _ = _cell_columns(batch)
                out = np.empty((batch.num_rows, size))
                for a in np.unique(arm).tolist():
                    at = arm == a
                    out[at] = said(batch, a, at, x[at], latest)
                yield batch.set_column(4, "_f", _lists(out))

        if done < rounds:
            fitted, forests = materialise(fitted.mapInArrow(carry, fitted.schema)), []
    return frame.sparkSession.createDataFrame(
        [(r, a, float(start[r, a] + added[r, a])) for r, a in sorted(start) if a in arms],
        f"{REPLICATE} int, {ARM} int, mu double",
    )


# --- summaries ----------------------------------------------------------------------------


def arm_means(mu: DataFrame, labels: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Mean and interval of each arm's outcome over the replicates."""
    rows = mu.where(F.col(REPLICATE) > 0)
    points = rows.groupBy(ARM).agg(F.avg("mu").alias("point"))
    marks = percentiles(rows, [ARM], "mu", {"lower": alpha / 2, "upper": 1 - alpha / 2})
    names = F.array(*[F.lit(x) for x in labels])
    return points.join(marks, ARM).select(
        ARM, F.get(names, F.col(ARM)).alias("label"), "point", "lower", "upper"
    )


def contrasts(mu: DataFrame, labels: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """E5: differences between arms within each replicate, with intervals.

    The joined rows are one per replicate and arm, so this is small.
    """
    names = F.array(*[F.lit(x) for x in labels])
    rows = mu.where(F.col(REPLICATE) > 0).withColumn("label", F.get(names, F.col(ARM)))
    gaps = rows.alias("a").join(
        rows.alias("b"),
        (F.col(f"a.{REPLICATE}") == F.col(f"b.{REPLICATE}")) & (F.col("a.label") < F.col("b.label")),
    ).select(
        F.concat_ws("|", "a.label", "b.label").alias("contrast"),
        (F.col("a.mu") - F.col("b.mu")).alias("gap"),
    )
    points = gaps.groupBy("contrast").agg(F.avg("gap").alias("point"))
    marks = percentiles(gaps, ["contrast"], "gap", {"lower": alpha / 2, "upper": 1 - alpha / 2})
    return points.join(marks, "contrast")


def ranking(means: DataFrame, higher_is_better: bool = False) -> DataFrame:
    """E5: arms from best to worst."""
    order = F.col("point").desc() if higher_is_better else F.col("point").asc()
    return means.orderBy(order, "label")


def overlap(frame: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Smallest and largest propensity of each arm over the cohort."""
    rows = VectorAssembler(
        inputCols=list(covariates), outputCol="features", handleInvalid="skip"
    ).transform(frame.where(F.col(ARM).isNotNull()))
    n = rows.count()
    model = LogisticRegression(
        labelCol=ARM, family="multinomial", regParam=1.0 / n, standardization=False, maxIter=1000
    ).fit(rows)
    chances = model.transform(rows).select(vector_to_array("probability").alias("p"))
    return chances.select(F.posexplode("p").alias(ARM, "p")).groupBy(ARM).agg(
        F.min("p").alias("min_propensity"), F.max("p").alias("max_propensity")
    )


LEARNERS = ("t_learner", "s_learner", "x_learner")
OUTCOMES = ("binary", "continuous", "ordinal")


def estimate(
    frame: DataFrame, covariates: Sequence[str], outcome: str, labels: Sequence[str], *,
    kind: str = "continuous", learner: str = "t_learner", replicates: int = 200, seed: int = 0,
    alpha: float = 0.05, key: str = KEY, within: DataFrame | None = None, ridge: float = 1.0,
    model: str = "linear", rounds: int = 200, depth: int = 6,
) -> DataFrame:
    """Arm means and contrasts with intervals, one row per quantity.

    ``model`` is ``linear`` or, for the T-learner of a continuous outcome, ``boosted``: ``rounds`` trees of ``depth``.

    ``within`` narrows the cohort to its keys, such as the members of a similarity cohort.

    The X-learner's arm means are those of its outcome models, one per arm; it adds its blended effects
    (:func:`x_learner`) of each arm against the first, as quantity ``effect``.  ``ridge`` is that of ordinal models.
    """
    if len(labels) < 2 or len(set(labels)) != len(labels):
        raise ValueError("at least two arms with different labels are needed")
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    if kind not in OUTCOMES:
        raise ValueError(f"outcomes of kind {kind!r} are not supported")
    if replicates < 1 or not 0.0 < alpha < 1.0:
        raise ValueError("replicates must be positive and alpha between 0 and 1")
    if model not in ("linear", "boosted") or model == "boosted" and (kind, learner) != ("continuous", "t_learner"):
        raise ValueError(f"model {model!r} is not supported for {kind} outcomes of the {learner}")
    options = {"binary": kind == "binary", "replicates": replicates, "seed": seed, "key": key}
    if within is not None:
        frame = materialise(frame.join(within.select(key).distinct(), key, "left_semi"))
    if model == "boosted":
        mu = boosted_learner(
            frame, covariates, outcome, len(labels), replicates=replicates, seed=seed, key=key, rounds=rounds, depth=depth,
        )
    elif kind == "ordinal":
        mu = ordinal_learner(
            frame, covariates, outcome, len(labels), single=learner == "s_learner", replicates=replicates, seed=seed,
            key=key, ridge=ridge,
        )
    elif learner == "s_learner":
        mu = s_learner(frame, covariates, outcome, len(labels), **options)
    else:
        mu = t_learner(frame, covariates, outcome, **options)
    mu = materialise(mu)
    means = arm_means(mu, labels, alpha).select(
        F.lit("mean").alias("quantity"), F.col("label").alias("name"), "point", "lower", "upper"
    )
    gaps = contrasts(mu, labels, alpha).select(
        F.lit("contrast").alias("quantity"), F.col("contrast").alias("name"), "point", "lower",
        "upper",
    )
    if learner != "x_learner":
        return means.unionByName(gaps)
    blended = x_learner(frame, covariates, outcome, len(labels), **options, ordinal=kind == "ordinal", ridge=ridge)
    effects = arm_means(blended.withColumnRenamed("effect", "mu"), labels, alpha).select(
        F.lit("effect").alias("quantity"), F.concat_ws("|", "label", F.lit(labels[0])).alias("name"), "point", "lower", "upper"
    )
    return means.unionByName(gaps).unionByName(effects)
