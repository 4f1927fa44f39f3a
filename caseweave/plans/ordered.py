"""Ordered work within groups (next row, running totals, ranks, percentiles)
that does not need a whole group in one task.

Each function first counts the rows per group.  When no group is larger than
``caseweave.rowsPerTask`` the plan is a plain window.  Otherwise the rows are
range-partitioned by group and order, written to the checkpoint folder so that
the cut points stay the same for every later use, and the window runs per
(group, slice); one row per slice carries the state across slice borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from caseweave.plans.sizes import has_hot_group
from caseweave.session import materialise

SLICE = "_slice"


def range_slices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_slice``: the number of the row's range partition over ``columns``."""
    ordered = df.repartitionByRange(*[F.col(c) for c in columns])
    return materialise(ordered.withColumn(SLICE, F.spark_partition_id()))


def _slices_if_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    if not has_hot_group(df, keys):
        return None
    return range_slices(df, [*keys, *order])


def _sized(ladder: DataFrame, counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows of ``ladder`` with the size of their group; without keys the size is a scalar."""
    if not keys:
        return ladder.select(value, "_upto", counts.agg(F.sum("_n")).scalar().alias("_size"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    return (
        ladder.alias("l")
        .join(sizes.alias("s"), _same(ladder, sizes, keys), "left")
        .select(*[F.col(f"l.{k}") for k in keys], F.col(f"l.{value}"), "l._upto", "s._size")
    )


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    step: int = 1,
) -> DataFrame:
    """Add columns of the next (``step=1``) or previous (``step=-1``) row.

    ``values`` maps a new column name to the neighbour's column it copies.
    """
    packed = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    move = F.lead if step > 0 else F.lag
    cut = _slices_if_hot(df, keys, order)
    if cut is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        joined = df.withColumn("_next", move(packed, 1).over(window))
    else:
        window = Window.partitionBy(*keys, SLICE).orderBy(*order)
        inside = cut.withColumn("_inside", move(packed, 1).over(window))
        pick = F.min_by if step > 0 else F.max_by
        edges = cut.groupBy(*keys, SLICE).agg(
            pick(packed, F.struct(*order)).alias("_edge")
        )
        across = Window.partitionBy(*keys).orderBy(SLICE)
        edges = edges.select(*keys, SLICE, move("_edge", 1).over(across).alias("_across"))
        joined = (
            inside.alias("i")
            .join(edges.alias("e"), _same(inside, edges, [*keys, SLICE]), "left")
            .select(
                *[F.col(f"i.{c}") for c in df.columns],
                F.coalesce("i._inside", "e._across").alias("_next"),
            )
        )
    return joined.select(*df.columns, *[F.col(f"_next.{name}").alias(name) for name in values])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, str | Column],
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums (or maxima) up to and, if inclusive, with each row.

    ``totals`` maps a new column to what is accumulated.  Without earlier rows an
    exclusive total is NULL.
    """
    columns = {name: F.col(v) if isinstance(v, str) else v for name, v in totals.items()}
    fold = {"sum": F.sum, "max": F.max}[how]
    until = Window.currentRow if inclusive else -1

    def join_totals(own: Column, before: Column) -> Column:
        if how == "max":
            return F.greatest(own, before)
        return F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0)))

    cut = _slices_if_hot(df, keys, order)
    if cut is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, until
        )
        return df.withColumns({name: fold(c).over(window) for name, c in columns.items()})
    window = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, until
    )
    inside = cut.withColumns({name: fold(c).over(window) for name, c in columns.items()})
    slices = cut.groupBy(*keys, SLICE).agg(*[fold(c).alias(n) for n, c in columns.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*keys, SLICE, *[fold(n).over(before).alias(n) for n in columns])
    return (
        inside.alias("i")
        .join(carry.alias("c"), _same(inside, carry, [*keys, SLICE]), "left")
        .select(
            *[F.col(f"i.{c}") for c in df.columns],
            *[join_totals(F.col(f"i.{n}"), F.col(f"c.{n}")).alias(n) for n in columns],
        )
    )


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    backward: bool = False,
) -> DataFrame:
    """Add the nearest non-null value at or before each row (after, if backward).

    With the two sides of an as-of join stacked and ordered by time, this is the
    join: each row of one side carries the latest value of the other.
    """
    def sort(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if backward else F.col(c).asc() for c in columns]

    def so_far(window: WindowSpec) -> WindowSpec:
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    cut = _slices_if_hot(df, keys, order)
    if cut is None:
        window = so_far(Window.partitionBy(*keys).orderBy(*sort(order)))
        return df.withColumns(
            {n: F.last(v, ignorenulls=True).over(window) for n, v in values.items()}
        )
    window = so_far(Window.partitionBy(*keys, SLICE).orderBy(*sort(order)))
    inside = cut.withColumns(
        {n: F.last(v, ignorenulls=True).over(window) for n, v in values.items()}
    )
    pick = F.min_by if backward else F.max_by
    edges = cut.groupBy(*keys, SLICE).agg(
        *[
            pick(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(n)
            for n, v in values.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(*sort([SLICE])).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = edges.select(
        *keys, SLICE, *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in values]
    )
    return (
        inside.alias("i")
        .join(carry.alias("c"), _same(inside, carry, [*keys, SLICE]), "left")
        .select(
            *[F.col(f"i.{c}") for c in df.columns],
            *[F.coalesce(f"i.{n}", f"c.{n}").alias(n) for n in values],
        )
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of each row within its group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    """Exact interpolated percentiles per group, one column per entry.

    Groups that fit a task use the built-in aggregate.  Larger ones are reduced
    to counts per distinct value, written once, accumulated across slices, and the two values
    that surround each position are picked by an ordinary aggregate.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    if not has_hot_group(known, keys):
        return known.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(p)).alias(n) for n, p in probabilities.items()]
        )
    counts = materialise(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    return _climbed(counts, keys, value, probabilities)


def percentiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """As :func:`percentiles`, of values that stand with their number ``_n``."""
    known = counts.where(F.col(value).isNotNull()).select(*keys, value, "_n")
    if has_hot_group(known, keys):
        return _climbed(known, keys, value, probabilities)
    return known.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p), F.col("_n")).alias(n) for n, p in probabilities.items()]
    )


def _climbed(
    counts: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Percentiles of (keys, value, ``_n``) with one row per value, from running counts."""
    ladder = running(counts, keys, [value], {"_upto": "_n"})
    placed = _sized(ladder, counts, keys, value)
    picks = []
    for name, p in probabilities.items():
        place = (F.col("_size") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
    picked = placed.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")
            ).cast("double").alias(n)
            for n in probabilities
        ],
    )


def value_at_rank(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]
) -> DataFrame:
    """Values at 0-based position ``floor(share * n)`` of the sorted group."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ladder = running(counts, keys, [value], {"_upto": "_n"})
    placed = _sized(ladder, counts, keys, value)
    def place(share: float) -> Column:
        return F.least(F.col("_size") - 1, F.floor(F.col("_size") * F.lit(float(share))))
    return placed.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_upto") > place(s), F.col(value))).alias(n)
            for n, s in shares.items()
        ]
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value.

    Counting by (group, value) first keeps the second step to one row per value.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name)
    )
