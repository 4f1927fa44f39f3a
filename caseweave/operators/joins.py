"""Join shapes the other operators are built from.

Join strategy is left to Spark: with adaptive execution a side is broadcast only
when its measured size is below the threshold, and a skewed partition of a
sorted join is split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.filters import keep
from caseweave.plans.ordered import carried, running
from caseweave.plans.sizes import has_hot_group


def with_dimension(facts: DataFrame, dimension: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Facts with the columns of their dimension row."""
    return facts.join(dimension, keys if isinstance(keys, str) else list(keys))


def with_defaults(
    base: DataFrame, extra: DataFrame, key: str, defaults: Mapping[str, Any]
) -> DataFrame:
    """Left join, missing values replaced by defaults."""
    joined = base.join(extra, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_matching(
    base: DataFrame, facts: DataFrame, key: str, condition: Column, within: Column | None = None
) -> DataFrame:
    """Left join with extra predicates on the right side.

    ``condition`` looks at the facts alone and is applied before the join;
    ``within`` compares both sides and stays in the join condition.
    """
    right = facts.where(condition).withColumnRenamed(key, "_key")
    on = base[key] == right["_key"]
    return base.join(right, on if within is None else on & within, "left").drop("_key")


matching = keep  # J5: semi join


def not_matching(base: DataFrame, matches: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Rows whose key does not occur in ``matches`` (a control group)."""
    return base.join(matches.select(key).distinct(), key, "left_anti")


#: Most intervals of one key that an event is compared with.
MOST_COMPARED = 16
#: Cells of time: 6 hours, and 8 times as long at each further level; what is longer than the last has one cell.
CELL_SECONDS = tuple(6 * 3600 * 8**level for level in range(5))


def _cell(seconds: Column, level: Column) -> Column:
    width = F.get(F.array(*[F.lit(w).cast("bigint") for w in CELL_SECONDS]), level)
    return F.coalesce(F.floor(seconds / width), F.lit(0))


def few_per_key(events: DataFrame, intervals: DataFrame, key: str) -> bool:
    """True when no key has many intervals, nor more events than one task should take."""
    return not has_hot_group(intervals.select(key), [key], MOST_COMPARED) and not has_hot_group(events.select(key), [key])


def in_interval(
    events: DataFrame, intervals: DataFrame, key: str, time: str = "charttime",
    start: str = "intime", end: str = "outtime", few: bool | None = None,
) -> DataFrame:
    """Events joined to the intervals of the same key that contain them.

    Where every key has few intervals and no more events than one task should take (:func:`few_per_key`, unless the
    caller knows it), they meet by the key alone: events are neither multiplied nor shuffled apart from what else has
    the key.  Otherwise they meet in cells of time.

    An interval lies in the one or two cells of the first level whose cells are no shorter than itself, and an event
    looks into its own cell at each level that has intervals, so a pair is met once.  An event is compared with the
    intervals near it, whatever the number of its key's intervals, and a busy key goes over many tasks.  Rows without
    a time, and intervals without an end, contain or meet nothing.
    """
    bounds = intervals.drop(*[c for c in intervals.columns if c in events.columns and c != key])
    inside = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))
    if few_per_key(events, intervals, key) if few is None else few:
        return events.join(bounds, key).where(inside)
    kinds = {dict(events.dtypes)[time], dict(bounds.dtypes)[start], dict(bounds.dtypes)[end]}

    def seconds(column: str) -> Column:
        # Whole seconds since 1970 that never run backwards: instants, or wall times where there is no zone.
        if kinds <= {"timestamp_ntz", "date"}:
            return F.timestamp_diff(
                "SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")
            )
        return F.unix_seconds(F.col(column).cast("timestamp"))

    length = seconds(end) - seconds(start)
    level = F.lit(len(CELL_SECONDS))
    for n, width in reversed(list(enumerate(CELL_SECONDS))):
        level = F.when(length <= width, n).otherwise(level)
    placed = bounds.where(F.col(start) <= F.col(end)).withColumn("_level", level).withColumn("_cell", F.explode(
        F.sequence(_cell(seconds(start), F.col("_level")), _cell(seconds(end), F.col("_level")))
    ))
    levels = placed.agg(F.collect_set("_level")).scalar()
    asked = events.where(F.col(time).isNotNull()).withColumn("_level", F.explode(levels)).withColumn(
        "_cell", _cell(seconds(time), F.col("_level"))
    )
    return asked.join(placed, [key, "_level", "_cell"]).where(inside).drop("_level", "_cell")


def first_claims(stays: DataFrame) -> DataFrame:
    """The stretch of time in which each stay is the earliest one of its encounter that lasts.

    A stay that started before lasts still at a time exactly if its end is not passed, so a stay's stretch
    begins at its start, or just after the latest end among the stays before it.  Stretches of an encounter do
    not overlap.  ``_side`` is 0 where the beginning belongs to the stretch and 2 where it doesn't.
    """
    kind = dict(stays.dtypes)["outtime"]
    known = stays.where("hadm_id IS NOT NULL AND intime IS NOT NULL").select(
        "hadm_id", "stay_id", "intime",
        F.coalesce("outtime", F.lit("9999-12-31 00:00:00").cast(kind)).alias("_until"),
    )
    line = running(known, ["hadm_id"], ["intime", "stay_id"], {"_taken": "_until"}, how="max", inclusive=False)
    free = F.col("_taken").isNull() | (F.col("_taken") < F.col("intime"))
    return line.where(
        (free & (F.col("_until") >= F.col("intime"))) | (~free & (F.col("_until") > F.col("_taken")))
    ).select(
        "hadm_id", F.when(free, F.col("intime")).otherwise(F.col("_taken")).alias("_at"),
        F.when(free, 0).otherwise(2).alias("_side"), F.struct("stay_id", "_until").alias("_claim"),
    )


def assign_stay(events: DataFrame, stays: DataFrame, time: str = "charttime") -> DataFrame:
    """Events with the earliest stay of their encounter that contains them; a stay without end is open.

    Events without such a stay are left out.  Events and the stretches of :func:`first_claims` lie on one time line
    and every event carries the stretch that began last: events are read once and compared with one stretch
    each, however many stays an encounter has, and an encounter with very many events is cut into slices.
    """
    own = events.drop("stay_id", "intime", "outtime").where(
        F.col("hadm_id").isNotNull() & F.col(time).isNotNull()
    )
    asked = own.withColumns({"_at": F.col(time), "_side": F.lit(1)})
    # The key of the line is a struct: with the plain column Spark may take both sides for dealt alike and plan no exchange
    # above their union, yet chain their partitions when one side's exchange is reused, so that a window misses rows.
    sides = [
        rows.withColumn("_key", F.struct("hadm_id")).drop("hadm_id") for rows in (asked, first_claims(stays))
    ]
    line = carried(
        sides[0].unionByName(sides[1], allowMissingColumns=True), ["_key"], ["_at", "_side"], {"_held": "_claim"},
    )
    return line.where((F.col("_side") == 1) & (F.col("_at") <= F.col("_held._until"))).select(
        *[F.col("_key.hadm_id").alias("hadm_id") if c == "hadm_id" else F.col(c) for c in own.columns],
        F.col("_held.stay_id").alias("stay_id"),
    )


def merge_features(base: DataFrame, frames: Sequence[DataFrame], key: str = "hadm_id") -> DataFrame:
    """Feature frames joined to the base rows one after the other.

    All joins share the key, so after the first shuffle the frames stay
    partitioned alike.
    """
    return reduce(lambda a, b: a.join(b, key, "left"), frames, base)


def mean_until(
    base: DataFrame, readings: DataFrame, key: str, until: str, on: str, value: Column,
    by: str, name: str,
) -> DataFrame:
    """Mean of a text reading taken on or before a date of the base row.

    Texts that are not numbers are left out.  Readings are summed per day and
    accumulated along the subject's days, and each base row takes the totals of
    its date, so no pairs of rows and readings are formed.
    """
    numbers = readings.select(
        F.col(key).alias("_key"), F.col(on).cast("date").alias("_at"), value.alias("_value")
    ).where(F.col("_value").isNotNull())
    days = numbers.groupBy("_key", "_at").agg(
        F.sum("_value").alias("_sum"), F.count(F.lit(1)).alias("_n")
    ).withColumns({"_side": F.lit(0), by: F.lit(None).cast(dict(base.dtypes)[by])})
    asked = base.select(
        F.col(key).alias("_key"), F.to_date(F.col(until)).alias("_at"), F.lit(1).alias("_side"), by
    )
    line = running(
        days.unionByName(asked, allowMissingColumns=True), ["_key"], ["_at", "_side", by],
        {"_total": "_sum", "_count": "_n"},
    )
    return line.where((F.col("_side") == 1) & (F.col("_count") > 0)).select(
        by, (F.col("_total") / F.col("_count")).alias(name)
    )
