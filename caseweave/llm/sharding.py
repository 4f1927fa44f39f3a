"""Rendezvous hashing of records over weighted shards, as column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a draw; a double holds them exactly.
DRAW_BITS = 52


def draw(*parts: Column) -> Column:
    """A whole number below 2**52 from the MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) with the highest score for ``key``; equal scores: the lower shard.

    The score of a shard is weight / -ln(u), with u drawn from key and shard.  Only that shard's own
    number enters its score, so adding a shard moves no record between the others.
    """
    best = F.array_max(F.array(*[
        F.struct(
            (F.lit(float(w)) / -F.log((draw(key, F.lit(s)) + 0.5) / F.lit(float(1 << DRAW_BITS)))).alias("score"),
            F.lit(-s).alias("shard"),
        )
        for s, w in enumerate(weights)
    ]))
    return (-best["shard"]).cast("int")


def assign_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0,
    id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 250_000,
) -> DataFrame:
    """One row per record: (id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text plus 1, ``grown_shard`` the shard once another one of
    weight ``added`` exists.  The law is ``key``: only the id and the shards decide.  A null id is a
    key of its own ('null'), a null text counts as empty.  Other columns of the input are ignored.

    ``slot`` numbers the records of a shard without gaps, in the order of a hash of (id, size, crc).
    The hash range of every shard is cut into slices of about ``rows_per_slice`` records; a slice is
    numbered on its own and starts after the sum of those before it, so no task holds a whole shard.
    The numbers don't depend on the cut.  Equal rows are counted before the shuffle and unfolded at
    the end, so that copies, however many, are one row on the way.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"), key.alias("_key"),
    )
    counted = rows.groupBy("_id", "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    dealt = (
        counted.withColumn("shard", rendezvous(F.col("_key"), weights))
        .withColumn("grown_shard", rendezvous(F.col("_key"), [*weights, added]))
        .withColumn("_order", draw(F.col("_key"), F.col("size"), F.col("text_crc32")))
    )
    slices = max(32, -(-docs.count() // (rows_per_slice * len(weights))))
    dealt = dealt.withColumn("_slice", F.floor(F.col("_order") / F.lit(float(1 << DRAW_BITS)) * slices).cast("int"))

    sums = dealt.groupBy("shard", "_slice").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    within = (
        Window.partitionBy("shard", "_slice").orderBy("_order", "_key", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    return (
        dealt.join(starts, ["shard", "_slice"])
        .withColumn("_first", first)
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"),
            "grown_shard",
        )
    )
