"""Similarity of encounters: mixed-type distance, contextual score, trajectories.

A comparison with one profile is Column arithmetic over the candidates, so it is
a scan without any join.  The nearest rows of a table's rows are looked for in cells that bound the
distance from below; other comparisons take the pairs the caller names.  All pairs of a table are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions import kernels as kn
from caseweave.functions.kernels import Direction, Kind, Trait
from caseweave.operators.aggregates import reference_ranges
from caseweave.operators.cohorts import gender_flags
from caseweave.operators.filters import keep
from caseweave.operators.windows import set_members, top_per_group, top_scored
from caseweave.plans.ordered import numbered, percentiles, percentiles_of_counts
from caseweave.plans.sizes import take_bounded
from caseweave.session import materialise

# --- mixed-type distance -----------------------------------------------------------------


def fit_scales(df: DataFrame, traits: Sequence[Trait]) -> list[Trait]:
    """Quantitative traits without a scale get the data's low and high.

    One aggregate gives all of them; ordinal traits without levels get their
    sorted values, of which there may be at most 200.
    """
    open_ = [t for t in traits if t.kind is Kind.QUANTITATIVE and t.scale is None]
    scales: dict[str, tuple[float, float]] = {}
    if open_:
        row = df.agg(
            *[F.min(F.col(t.name).cast("double")).alias(f"{t.name}_low") for t in open_],
            *[F.max(F.col(t.name).cast("double")).alias(f"{t.name}_high") for t in open_],
        ).first()
        scales = {
            t.name: (row[f"{t.name}_low"] or 0.0, row[f"{t.name}_high"] or 0.0) for t in open_
        }
    fitted = []
    for t in traits:
        if t.name in scales:
            t = t.with_scale(*scales[t.name])
        elif t.kind is Kind.ORDINAL and t.levels is None:
            found = df.select(t.name).where(F.col(t.name).isNotNull()).distinct().orderBy(t.name)
            levels = [r[0] for r in take_bounded(found, 200, f"levels of {t.name}")]
            t = Trait(**{**t.__dict__, "levels": levels})
        fitted.append(t)
    return fitted


Part = tuple[Trait, Column, Column]


def compared(traits: Sequence[Trait], left: Mapping[str, Column], right: Mapping[str, Column]) -> list[Part]:
    """Similarity and participation of every trait."""
    return [(t, *kn.compare_trait(t, left[t.name], right[t.name])) for t in traits]


def distance_of(parts: Sequence[Part]) -> Column:
    """The weighted distance; NULL when no trait takes part."""
    return kn.distance([(t.weight, s, p) for t, s, p in parts])


def contributions_of(parts: Sequence[Part]) -> Column:
    """Per trait its similarity, signed pull, weight and whether it took part."""
    return F.array(
        *[
            F.struct(
                F.lit(t.name).alias("name"),
                F.when(p, s).alias("similarity"),
                kn.contribution(t.weight, s, p).alias("signed"),
                F.lit(float(t.weight)).alias("weight"),
                p.alias("included"),
            )
            for t, s, p in parts
        ]
    )


def literal(trait: Trait, value: Any) -> Column:
    if value is None:
        kind = "double" if trait.kind is Kind.QUANTITATIVE else "string"
        return F.lit(None).cast(kind)
    return F.lit(value)


def score_against(
    candidates: DataFrame, traits: Sequence[Trait], profile: Mapping[str, Any], key: str = "hadm_id",
    keep_columns: Sequence[str] = (),
) -> DataFrame:
    """Distance of every candidate to one profile, with contributions."""
    parts = compared(
        traits, {t.name: literal(t, profile.get(t.name)) for t in traits},
        {t.name: F.col(t.name) for t in traits},
    )
    return candidates.select(
        key, *keep_columns, distance_of(parts).alias("distance"),
        contributions_of(parts).alias("contributions"),
    )


def pair_distances(
    pairs: DataFrame, rows: DataFrame, traits: Sequence[Trait], key: str, similarity: bool = False
) -> DataFrame:
    """Distance of the named pairs (left_id, right_id).

    Both rows come by equality joins, so the work is linear in the pairs asked
    for.  Distances are symmetric and 0 for a row with itself.
    """
    names = [t.name for t in traits]
    left = rows.select(F.col(key).alias("left_id"), *[F.col(n).alias(f"l_{n}") for n in names])
    right = rows.select(F.col(key).alias("right_id"), *[F.col(n).alias(f"r_{n}") for n in names])
    joined = pairs.join(left, "left_id").join(right, "right_id")
    value = distance_of(
        compared(traits, {n: F.col(f"l_{n}") for n in names}, {n: F.col(f"r_{n}") for n in names})
    )
    name = "similarity" if similarity else "distance"
    return joined.select("left_id", "right_id", (1.0 - value if similarity else value).alias(name))


#: Cells that the candidates are laid in, at most; as many traits set the cells, the heaviest ones.
MOST_CELLS, CELL_TRAITS = 4096, 6
#: Candidates of one cell that a task compares; a fuller cell is dealt out by the hash of the key.
CELL_ROWS = 100_000


def _coordinate(trait: Trait, column: Column, places: int) -> Column:
    """A trait's value as a number; of a nominal one, a hash below ``places``.  NULL where it is missing."""
    if trait.kind is Kind.BINARY:
        return (column == F.lit(trait.present)).cast("double")
    if trait.kind is Kind.ORDINAL:
        return kn.level(column, trait.levels)
    if trait.kind is Kind.NOMINAL:
        return F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(places)).cast("double"))
    return F.when(~F.isnan(column.cast("double")), column.cast("double"))


def _range(trait: Trait) -> tuple[float, float]:
    if trait.kind is Kind.ORDINAL:
        return 0.0, float(max(len(trait.levels) - 1, 1))
    if trait.kind is Kind.QUANTITATIVE:
        low, high = trait.scale
        return low, (high if high != low else low + 1.0)
    return 0.0, 1.0


def _place(trait: Trait, coordinate: Column, places: int) -> Column:
    """The part of the trait's range that a value lies in, 1 to ``places``; 0 where it is missing."""
    low, high = _range(trait)
    if trait.kind is Kind.NOMINAL:
        part = coordinate
    else:
        share = (coordinate - F.lit(low)) / F.lit(high - low)
        part = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(places - 1.0), share * places)))
    return F.when(coordinate.isNull(), F.lit(0)).otherwise(part + 1).cast("long")


@dataclass(frozen=True)
class Cells:
    """The cells of the candidates: id, rows, and per trait the smallest and largest number (NaN: missing)."""

    traits: Sequence[Trait]
    beyond: float
    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """(anchors, cells): no row of the cell is nearer to the anchor than this.

        A cell's rows lack the same traits, so it is known which ones take part; traits that set no cell
        count with their weight and no gap.
        """
        top, weight = np.zeros((len(x), len(self.ids))), np.full((len(x), len(self.ids)), self.beyond)
        for i, t in enumerate(self.traits):
            own, low, high = x[:, i][:, None], self.low[None, :, i], self.high[None, :, i]
            gone = np.isnan(own) | np.isnan(low)
            if t.kind in (Kind.NOMINAL, Kind.BINARY):
                far = (own != low).astype(float)
            else:
                short, over = np.maximum(low - own, 0.0), np.maximum(own - high, 0.0)
                gap = {Direction.SYMMETRIC: short + over, Direction.HIGHER: over, Direction.LOWER: short}[t.direction]
                first, last = _range(t)
                far = np.minimum(gap / (last - first), 1.0)
            part = ~gone
            if t.asymmetric and t.kind is Kind.BINARY:
                part = part & ~((own == 0.0) & (low == 0.0))
            if t.missing is kn.Missing.ZERO:
                far, part = np.where(gone, 1.0, far), part | gone
            top += np.where(part, t.weight * far, 0.0)
            weight += np.where(part, t.weight, 0.0)
        return np.where(weight > 0, top / np.where(weight > 0, weight, 1.0), np.inf)

    def first(self, x: np.ndarray, n: int) -> np.ndarray:
        """(anchors, cells): the cells with the lowest bounds that hold more than ``n`` rows together."""
        order = np.argsort(self.bounds(x), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(chosen, order, before <= n, axis=1)
        return chosen


def nearest(
    anchors: DataFrame, candidates: DataFrame, traits: Sequence[Trait], key: str, n: int,
) -> DataFrame:
    """The n nearest candidates of each anchor row, undefined distances last, ties to the smaller key.

    Candidates lie in cells, one per combination of parts of the traits' ranges.  An anchor is compared with
    the cells of the lowest bounds until they hold more than n rows; then only with cells whose bound does not exceed
    the distance of its n-th row so far.  The result is that of comparing all.  Both tables may be of any
    size: only the cells, 4,096 at most, reach the driver, and a full cell is dealt out.  Keys are unique;
    rows without a key are left out.
    """
    names = [t.name for t in traits]
    tracked = sorted(traits, key=lambda t: -t.weight)[:CELL_TRAITS]
    places = max(int(MOST_CELLS ** (1 / len(tracked)) + 1e-9) - 1, 1)
    numbers = [_coordinate(t, F.col(t.name), places) for t in tracked]
    cell = F.lit(0).cast("long")
    for t, number in zip(tracked, numbers, strict=True):
        cell = cell * F.lit(places + 1) + _place(t, number, places)
    own = candidates.select(F.col(key).alias("right_id"), *names, cell.alias("_cell")).where("right_id IS NOT NULL")
    rows = own.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in numbers]).alias("low"),
        F.array(*[F.max(c) for c in numbers]).alias("high"),
    ).collect()
    cells = Cells(
        tracked, float(sum(t.weight for t in traits) - sum(t.weight for t in tracked)),
        np.array([r["_cell"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64),
        np.array([r["low"] for r in rows], dtype=float).reshape(-1, len(tracked)),
        np.array([r["high"] for r in rows], dtype=float).reshape(-1, len(tracked)),
    )
    parts = -(-cells.rows // CELL_ROWS)
    full = {int(c): int(p) for c, p in zip(cells.ids, parts, strict=True) if p > 1}
    dealt = F.lit(1)
    if full:
        table = F.create_map(*[F.lit(v) for pair in full.items() for v in pair])
        dealt = F.coalesce(table[F.col("_cell")], F.lit(1))
    own = own.withColumn("_part", F.pmod(F.xxhash64("right_id"), dealt).cast("int"))

    asked = anchors.select(
        F.col(key).alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in names], F.array(*numbers).alias("_x")
    )

    def visits(table: DataFrame, chosen: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
        """The rows of ``table`` with the cells, and parts of cells, that are chosen for them."""

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 256):
                    block = batch.iloc[start : start + 256]
                    x = np.array([[np.nan if v is None else v for v in r] for r in block["_x"]], dtype=float)
                    row, at = np.nonzero(chosen(x, block))
                    again = np.repeat(np.arange(len(row)), parts[at])
                    part = np.arange(len(again)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
                    yield pd.DataFrame({
                        "left_id": block["left_id"].to_numpy()[row[again]], "_cell": cells.ids[at[again]],
                        "_part": part.astype(np.int32),
                    })

        kind = dict(table.dtypes)["left_id"]
        return table.mapInPandas(made, f"left_id {kind}, _cell long, _part int")

    value = distance_of(compared(traits, {c: F.col(f"l_{c}") for c in names}, {c: F.col(c) for c in names}))

    def best(found: DataFrame) -> DataFrame:
        return top_per_group(found, ["left_id"], [F.col("distance").asc_nulls_last(), "right_id"], n)

    def scored(pairs: DataFrame) -> DataFrame:
        with_values = pairs.join(asked.drop("_x"), "left_id")
        return with_values.join(own, ["_cell", "_part"]).where(F.col("left_id") != F.col("right_id")).select(
            "left_id", "right_id", value.alias("distance")
        )

    head = asked.select("left_id", "_x")
    early = materialise(best(scored(visits(head, lambda x, block: cells.first(x, n)))))
    # Without n defined distances every cell may still hold one of the n.
    reach = early.groupBy("left_id").agg(F.count("distance").alias("_n"), F.max("distance").alias("_far"))
    left = head.join(reach, "left_id", "left").select(
        "left_id", "_x", F.when(F.col("_n") >= n, F.col("_far")).otherwise(F.lit(float("inf"))).alias("_far")
    )

    def rest(x: np.ndarray, block: pd.DataFrame) -> np.ndarray:
        # What rounding may take from a bound.
        return (cells.bounds(x) <= block["_far"].to_numpy()[:, None] + 1e-9) & ~cells.first(x, n)

    return best(early.unionByName(scored(visits(left, rest))))


# --- contextual score ------------------------------------------------------------------------


def encounter_features(
    encounters: DataFrame, subjects: DataFrame, stays: DataFrame, labs: DataFrame,
    comorbidities: DataFrame | None = None,
) -> DataFrame:
    """Demographics, stay hours and three laboratory values per encounter.

    Missing numbers take the median over the encounters.  Comorbidity flags are
    joined when given and 0 otherwise.
    """
    people = subjects.select("subject_id", "gender", F.col("anchor_age").alias("age"))
    base = encounters.select("hadm_id", "subject_id", "admission_type").join(people, "subject_id")
    hours = stays.groupBy("hadm_id").agg((F.sum("los") * 24.0).alias("icu_los_hours"))
    value, item = F.col("valuenum"), F.col("itemid")
    values = labs.groupBy("hadm_id").agg(
        F.max(F.when(item == rules.CREATININE, value)).alias("creatinine_max"),
        F.avg(F.when(item == rules.SODIUM, value)).alias("sodium_mean"),
        F.min(F.when(item == rules.PLATELETS, value)).alias("platelet_min"),
    )
    # Written once: the medians and the filled rows read it back.
    wide = materialise(base.join(hours, "hadm_id", "left").join(values, "hadm_id", "left"))
    names = ["creatinine_max", "sodium_mean", "platelet_min"]
    long = wide.select("hadm_id", *names).unpivot(["hadm_id"], names, "feature", "value")
    medians = {
        r["feature"]: r["median"]
        for r in percentiles(long, ["feature"], "value", {"median": 0.5}).collect()
    }
    columns = {
        "icu_los_hours": F.coalesce("icu_los_hours", F.lit(0.0)),
        **{n: F.coalesce(F.col(n), F.lit(medians.get(n))) for n in names},
        **gender_flags(),
    }
    filled = wide.withColumns(columns)
    if comorbidities is None:
        return filled.withColumn("charlson_index", F.lit(0))
    flags = [c for c in comorbidities.columns if c != "hadm_id"]
    return filled.join(comorbidities, "hadm_id", "left").fillna(0, flags)


def _scaled(a: Column, c: Column, scale: float) -> Column:
    """Similarity of two numbers; a missing one counts as unlike."""
    return F.coalesce(kn.quantitative(a, c, scale), F.lit(0.0))


def _equal(a: Column, c: Column) -> Column:
    return F.coalesce((a == c).cast("double"), F.lit(0.0))


def _overlap(
    anchor: Mapping[str, Any], flags: Mapping[str, float]
) -> tuple[Column, dict[str, tuple[Column, Column]]]:
    """Weighted overlap of 0/1 flags; two empty sets are alike."""
    shared, either = F.lit(0.0), F.lit(0.0)
    states = {}
    for name, weight in flags.items():
        mine = F.lit(int(anchor.get(name) or 0) == 1)
        theirs = F.coalesce(F.col(name) == 1, F.lit(False))
        states[name] = (mine & theirs, (mine | theirs) & ~(mine & theirs))
        shared = shared + F.when(mine & theirs, F.lit(float(weight))).otherwise(0.0)
        either = either + F.when(mine | theirs, F.lit(float(weight))).otherwise(0.0)
    score = F.when(either > 0, shared / F.when(either > 0, either)).otherwise(F.lit(1.0))
    return score, states


Weighted = tuple[str, Column, Column]  # feature, contribution within its group, counts at all


def contextual_scores(
    candidates: DataFrame, anchor: Mapping[str, Any],
    weights: Mapping[str, float] = rules.GROUP_WEIGHTS,
    burden: Mapping[str, float] | None = None, concepts: Sequence[str] = (),
    social: Sequence[str] = ("language_barrier", "is_neuro_service"), top: int = 5,
) -> DataFrame:
    """Five group scores, their weighted sum, and the strongest features.

    ``burden`` maps comorbidity flag columns to weights and ``concepts`` lists
    concept flag columns; an absent social flag counts as 0.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("group weights must sum to 1")
    weight = {g: float(weights.get(g, 0.0)) for g in rules.GROUP_WEIGHTS}
    columns = set(candidates.columns)

    def mine(name: str) -> Column:
        return F.lit(anchor.get(name))

    def theirs(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(0)

    def mean_group(parts: Sequence[tuple[str, Column]]) -> tuple[Column, list[Weighted]]:
        n = max(len(parts), 1)
        total = sum((s for _, s in parts), F.lit(0.0)) / n
        return total, [(f, (2.0 * s - 1.0) / n, F.lit(True)) for f, s in parts]

    both_gender = F.lit(False)
    for flag in ("gender_M", "gender_F", "gender_unknown"):
        if int(anchor.get(flag) or 0) == 1:
            both_gender = both_gender | F.coalesce(theirs(flag) == 1, F.lit(False))
    demographics = mean_group([
        ("age", _scaled(mine("age"), theirs("age"), rules.AGE_SCALE)),
        ("gender", both_gender.cast("double")),
        ("admission_type", _equal(mine("admission_type"), theirs("admission_type"))),
    ])

    flags = dict(burden or {})
    index = _scaled(mine("charlson_index"), theirs("charlson_index"), rules.BURDEN_SCALE)
    overlap, states = _overlap(anchor, flags)
    share = 0.5 / max(len(flags), 1)
    comorbidity = (
        0.5 * index + 0.5 * overlap,
        [("charlson_index", (2.0 * index - 1.0) * 0.5, F.lit(True))]
        + [(f, F.when(both, share).otherwise(-share), both | one)
           for f, (both, one) in states.items()],
    )

    overlap, states = _overlap(anchor, {c: 1.0 for c in concepts})
    share = 1.0 / max(len(concepts), 1)
    concept_set = (
        overlap,
        [(f, F.when(both, share).otherwise(-share), both | one)
         for f, (both, one) in states.items()],
    )

    severity = mean_group([
        (n, _scaled(mine(n), theirs(n), s)) for n, s in rules.SEVERITY_SCALES.items()
    ])
    social_group = mean_group([
        (n, _equal(F.lit(int(anchor.get(n) or 0)), F.coalesce(theirs(n), F.lit(0))))
        for n in social
    ])
    groups = {
        "demographics": demographics, "comorbidity_burden": comorbidity,
        "comorbidity_set": concept_set, "severity": severity, "social": social_group,
    }
    pulls = F.array(
        *[
            F.struct(
                (F.when(counts, pull).otherwise(0.0) * weight[g]).alias("pull"),
                F.lit(feature).alias("feature"),
            )
            for g, (_, parts) in groups.items() for feature, pull, counts in parts
        ]
    )

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    overall = sum((clip(s) * weight[g] for g, (s, _) in groups.items()), F.lit(0.0))
    scored = candidates.select(
        "hadm_id", "subject_id", clip(overall).alias("contextual"),
        *[clip(s).alias(g) for g, (s, _) in groups.items()], pulls.alias("_pulls"),
    )
    up = F.slice(F.sort_array(F.filter("_pulls", lambda p: p["pull"] > 1e-9), asc=False), 1, top)
    down = F.slice(F.sort_array(F.filter("_pulls", lambda p: p["pull"] < -1e-9)), 1, top)
    return scored.withColumns({"contributors": up, "detractors": down}).drop("_pulls")


# --- trajectories ------------------------------------------------------------------------------


def trajectory_scores(
    anchor: DataFrame, buckets: DataFrame, candidates: DataFrame, decay: float = 0.9
) -> DataFrame:
    """Decay-weighted overlap of bucketed events with an anchor's.

    ``anchor`` and ``buckets`` are rows of bucket, code and first_at (buckets also
    of hadm_id).  The anchor's buckets come first, in time order, with weights
    1, d, d²…; buckets only the candidate has follow.  Those overlap by 0, so only
    their number matters, and the weights sum to (1 - d^n) / (1 - d).
    """
    # The rows of one encounter, used three times below.
    anchor = materialise(anchor.select("bucket", "code", "first_at"))
    order = anchor.groupBy("bucket").agg(
        F.min("first_at").alias("_at"), F.count_distinct("code").alias("_n_anchor")
    )
    # Position of each bucket: the anchor is one encounter, so this list is short.
    place = F.row_number().over(Window.orderBy("_at", "bucket")) - 1
    positions = order.select("bucket", "_n_anchor", place.alias("_place"))
    n_anchor = positions.agg(F.count(F.lit(1))).scalar()
    known = anchor.select("bucket", "code").distinct().withColumn("_shared", F.lit(1))
    rows = buckets.select("hadm_id", "bucket", "code").distinct().join(
        known, ["bucket", "code"], "left"
    )
    per_bucket = rows.groupBy("hadm_id", "bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_shared").alias("_both")
    ).join(positions, "bucket", "left")
    both = F.coalesce("_both", F.lit(0))
    overlap = both / (F.col("_n") + F.col("_n_anchor") - both)
    weighted = F.pow(F.lit(float(decay)), F.col("_place")) * overlap
    sums = per_bucket.groupBy("hadm_id").agg(
        F.sum(weighted).alias("_top"), F.count(F.lit(1)).alias("_n_buckets"),
        F.count_if(F.col("_place").isNull()).alias("_n_new"),
    )
    joined = candidates.select("hadm_id").distinct().join(sums, "hadm_id", "left")
    length = n_anchor + F.coalesce("_n_new", F.lit(0))
    total = length if decay == 1.0 else (
        (1.0 - F.pow(F.lit(float(decay)), length)) / F.lit(1.0 - decay)
    )
    score = F.coalesce("_top", F.lit(0.0)) / F.when(total > 0, total)
    return joined.select(
        "hadm_id",
        F.when(n_anchor > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("temporal"),
        F.abs(n_anchor - F.coalesce("_n_buckets", F.lit(0))).alias("los_gap_days"),
        (n_anchor > 0).alias("temporal_available"),
    )


def trajectory_members(anchor: DataFrame, buckets: DataFrame, hadm_ids: DataFrame) -> DataFrame:
    """Shared, anchor-only and candidate-only events of chosen candidates.

    The anchor is one encounter; its events go to the rows of the candidates as one array, and any number of
    candidates may be asked for.
    """
    own = anchor.agg(F.collect_set(F.struct("bucket", "code"))).scalar()
    left = hadm_ids.select("hadm_id").distinct().select("hadm_id", F.explode(own).alias("_e")).select("hadm_id", "_e.*")
    right = keep(buckets, hadm_ids).select("hadm_id", "bucket", "code")
    return set_members(left, right, ["hadm_id", "bucket"], "code")


def combined(contextual: DataFrame, temporal: DataFrame | None, weight: float = 0.5) -> DataFrame:
    """Weighted mean of both scores; the contextual one alone without a trajectory."""
    if temporal is None:
        return contextual.withColumns({
            "temporal": F.lit(None).cast("double"), "combined": F.col("contextual"),
        })
    joined = contextual.join(temporal, "hadm_id", "left")
    mixed = F.lit(weight) * F.col("temporal") + F.lit(1.0 - weight) * F.col("contextual")
    value = F.coalesce(mixed, F.col("contextual"))
    return joined.withColumn(
        "combined", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    )


def latest_encounter(encounters: DataFrame, subject_id: int) -> int:
    """The encounter that stands for a subject."""
    row = encounters.where(F.col("subject_id") == subject_id).agg(
        F.max_by("hadm_id", F.struct("admittime", "hadm_id")).alias("hadm_id")
    ).first()
    if row["hadm_id"] is None:
        raise ValueError(f"subject {subject_id} has no encounter")
    return row["hadm_id"]


def rank_similar(
    features: DataFrame, buckets: DataFrame, *, hadm_id: int | None = None,
    template: Mapping[str, Any] | None = None, weight: float = 0.5, decay: float = 0.9,
    top_k: int | None = 20, at_least: float | None = None,
    burden: Mapping[str, float] | None = None, concepts: Sequence[str] = (),
) -> DataFrame:
    """Candidates ranked by similarity to an encounter or a template.

    The anchor is one row, fetched once; everything else is one pass over the
    candidates.  A template has no trajectory, so its ranking is contextual.
    """
    if (hadm_id is None) == (template is None):
        raise ValueError("give an encounter or a template")
    if template is not None:
        scores = combined(contextual_scores(features, template, burden=burden, concepts=concepts), None)
        return top_scored(scores, "combined", top_k, at_least)
    row = features.where(F.col("hadm_id") == hadm_id).first()
    if row is None:
        raise ValueError(f"no encounter {hadm_id}")
    others = features.where(F.col("hadm_id") != hadm_id)
    context = contextual_scores(others, row.asDict(), burden=burden, concepts=concepts)
    temporal = trajectory_scores(
        buckets.where(F.col("hadm_id") == hadm_id),
        buckets.where(F.col("hadm_id") != hadm_id), others, decay,
    )
    return top_scored(combined(context, temporal, weight), "combined", top_k, at_least)


# --- cohort around a profile ------------------------------------------------------------------------


def pinned(traits: Sequence[Trait]) -> list[Trait]:
    """A directional trait without a value is pinned to its scale's extreme."""
    out = []
    for t in traits:
        if t.reference is None and t.direction is not Direction.SYMMETRIC and t.scale:
            low, high = t.scale
            value = high if t.direction is Direction.HIGHER else low
            t = Trait(**{**t.__dict__, "reference": value})
        out.append(t)
    return out


def profile_cohort(
    features: DataFrame, traits: Sequence[Trait], threshold: float, top_k: int | None = None
) -> DataFrame:
    """Encounters within a distance of a profile, nearest first.

    Every quantitative trait needs a frozen scale: none is learned from the rows
    that are scored.
    """
    ready = pinned(traits)
    for t in ready:
        if t.kind is Kind.QUANTITATIVE and t.scale is None:
            raise ValueError(f"quantitative trait {t.name!r} needs a frozen scale")
    scored = score_against(
        features, ready, {t.name: t.reference for t in ready}, keep_columns=["subject_id"]
    ).where(F.col("distance") <= threshold)
    ranked = scored.orderBy("distance", "hadm_id")
    return ranked if top_k is None else ranked.limit(top_k)


def cohort_quantities(members: DataFrame) -> DataFrame:
    """Per trait, mean similarity and pull over the members it took part for."""
    long = members.select(F.explode("contributions").alias("c")).where(F.col("c.included"))
    return long.groupBy(F.col("c.name").alias("name"), F.col("c.weight").alias("weight")).agg(
        F.avg("c.similarity").alias("mean_similarity"), F.avg("c.signed").alias("mean_signed"),
        F.count(F.lit(1)).alias("included_count"),
    )


def cohort_distances(members: DataFrame) -> DataFrame:
    """Size and spread of the members' distances."""
    # Written once, in any order: the median reads the distances several times.
    counts = materialise(members.groupBy("distance").agg(F.count(F.lit(1)).alias("_n")))
    median = percentiles_of_counts(counts, [], "distance", {"median": 0.5}).select("median").scalar()
    known = F.when(F.col("distance").isNotNull(), F.col("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_returned"), F.min("distance").alias("min"),
        (F.sum(F.col("distance") * F.col("_n")) / F.sum(known)).alias("mean"), F.max("distance").alias("max"),
    ).withColumn("median", median)


def ranked_members(members: DataFrame) -> DataFrame:
    """IO13: rank, subject, encounter and distance of every member."""
    return numbered(members, [], ["distance", "hadm_id"], "rank").select(
        "rank", "subject_id", "hadm_id", F.round("distance", 6).alias("distance")
    )


def derived_ranges(encounters: DataFrame, build: Any, columns: Sequence[str]) -> DataFrame:
    """Robust ranges of derived features, fitted on all encounters.

    ``build`` makes the feature frame of a cohort.
    """
    reference = encounters.select("hadm_id").distinct()
    return reference_ranges(build(reference), columns).where(F.col("n") >= 2)
