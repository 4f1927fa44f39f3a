"""First, last, next, top and binned rows of a group; unions and set comparison.

Where one row per group is wanted, a ``min_by``/``max_by`` aggregate replaces a
sort of the group.  Where neighbours or running state are wanted, the work goes
through :mod:`caseweave.plans.ordered`, which splits hot groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.draws import uniform
from caseweave.functions.times import boundaries, plus_hours
from caseweave.operators.filters import first_stays
from caseweave.plans.ordered import neighbour

__all__ = [
    "first_stays", "distinct_on", "first_and_last", "next_row", "score_totals", "score_drops",
    "with_share", "in_first_hours", "binned_means", "followed_by", "top_per_group", "top_scored",
    "sample", "stack", "merge_by_key", "set_members",
]


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in the given order."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_and_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Each value at the group's first and last row."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(v, place).alias(f"{v}_first") for v in values],
        *[F.max_by(v, place).alias(f"{v}_last") for v in values],
    )


def next_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Columns of the group's next row."""
    return neighbour(df, keys, order, values, 1)


def score_totals(charts: DataFrame, aggregate: str = "max") -> DataFrame:
    """Score components of one stay and time side by side, and their total.

    A component that was not read counts as 0 in the total.
    """
    pick = {"max": F.max, "min": F.min}[aggregate]
    parts = {"eye": rules.SCORE_EYE, "verbal": rules.SCORE_VERBAL, "motor": rules.SCORE_MOTOR}
    wide = (
        charts.where(F.col("itemid").isin(list(rules.SCORE_ITEMS)))
        .groupBy("stay_id", "charttime")
        .agg(*[pick(F.when(F.col("itemid") == i, F.col("valuenum"))).alias(n)
               for n, i in parts.items()])
    )
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in parts])
    return wide.withColumn("total", total)


def score_drops(totals: DataFrame, drop: float = -2.0) -> DataFrame:
    """Readings whose total fell by at least ``-drop`` since the one before."""
    before = neighbour(totals, ["stay_id"], ["charttime"], {"previous": "total"}, -1)
    change = F.col("total") - F.col("previous")
    return before.where(change <= drop).select("stay_id", "charttime", change.alias("change"))


def with_share(
    counts: DataFrame, count: str = "count", within: Sequence[str] = (), name: str = "fraction"
) -> DataFrame:
    """Each count as a share of its group's total.

    ``counts`` is already aggregated, so a group's window sees one row per value.  Without groups
    the total is a scalar, not a window over everything.
    """
    if not within:
        whole = counts.agg(F.sum(count)).scalar()
        return counts.withColumn(name, F.col(count) / F.when(whole != 0, whole))
    total = F.sum(count).over(Window.partitionBy(*within))
    return counts.withColumn(name, F.col(count) / F.when(total != 0, total))


def in_first_hours(
    events: DataFrame, stays: DataFrame, hours: float, time: str = "charttime",
    key: str = "stay_id",
) -> DataFrame:
    """Events from a stay's start to ``hours`` later, with the stay's ``intime``."""
    starts = stays.select(key, "intime") if key == "stay_id" else stays.select(
        key, "stay_id", "intime"
    )
    own = events.drop(*[c for c in ("intime", "stay_id") if c in events.columns and c != key])
    joined = own.join(starts, key)
    return joined.where(F.col(time).between(F.col("intime"), plus_hours("intime", hours)))


def binned_means(
    charts: DataFrame, stays: DataFrame, itemid: int, name: str,
    width: int = 12, hours: int = 48,
) -> DataFrame:
    """Mean of one item per time bin after the stay's start, one column a bin.

    Bins count hour boundaries; what lies past the last bin's start goes there.
    """
    rows = in_first_hours(
        charts.where((F.col("itemid") == itemid) & F.col("valuenum").isNotNull()), stays, hours
    )
    last = hours // width - 1
    place = F.least(
        F.floor(boundaries("hour", "intime", "charttime") / F.lit(width)), F.lit(last)
    )
    columns = [
        F.avg(F.when(place == b, F.col("valuenum"))).alias(
            f"{name}_{b * width}_{(b + 1) * width}h"
        )
        for b in range(last + 1)
    ]
    return rows.groupBy("stay_id").agg(*columns)


def followed_by(encounters: DataFrame) -> DataFrame:
    """(encounter, next encounter of the subject), with both start times."""
    pairs = neighbour(
        encounters.select("subject_id", "hadm_id", "admittime"),
        ["subject_id"], ["admittime", "hadm_id"],
        {"next_hadm_id": "hadm_id", "next_admittime": "admittime"},
    )
    return pairs.where(F.col("next_hadm_id").isNotNull())


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark limits each map task's share of a group to ``n`` rows before the
    shuffle, so a hot group moves ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top_scored(
    df: DataFrame, score: str, k: int | None = None, at_least: float | None = None,
    tie: str = "hadm_id",
) -> DataFrame:
    """L3: rows above a score, best first, at most ``k``."""
    kept = df if at_least is None else df.where(F.col(score) >= at_least)
    ranked = kept.orderBy(F.col(score).desc_nulls_last(), tie)
    return ranked if k is None else ranked.limit(k)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of their key, the same for the same seed."""
    return df.orderBy(uniform(seed, F.col(key)), key).limit(n)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, keeping duplicates."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_by_key(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union keeping one row per key, from the earliest frame that has it."""
    marked = stack([f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)])
    columns = [c for c in marked.columns if c not in (*keys, "_from")]
    row = F.struct(*columns)
    best = marked.groupBy(*keys).agg(F.min_by(row, F.struct("_from", row)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def set_members(
    left: DataFrame, right: DataFrame, keys: Sequence[str], item: str
) -> DataFrame:
    """U4: each item of two sets, marked shared, left_only or right_only.

    The sets stay in long form (one row per member), so a set has no size limit.
    """
    a = left.select(*keys, item).distinct().withColumn("_left", F.lit(True))
    b = right.select(*keys, item).distinct().withColumn("_right", F.lit(True))
    where = (
        F.when(F.col("_left") & F.col("_right"), "shared")
        .when(F.col("_left"), "left_only")
        .otherwise("right_only")
    )
    return a.join(b, [*keys, item], "full").select(*keys, item, where.alias("member_of"))
