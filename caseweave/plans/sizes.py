"""Checks of size that decide between two plans, and the size of a task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = "caseweave.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000
#: Most shuffled bytes that adaptive execution gathers for one task, and bytes of input files per shuffle partition.
TASK_BYTES = 16 << 20
INPUT_BYTES_PER_PARTITION = 4 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Groups are counted together in so many buckets first.
BUCKETS = 1 << 12
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def rows_per_task(spark: SparkSession) -> int:
    """Most rows of one group that a single task may sort or hold."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some group of ``keys`` holds more rows than one task should take, or more than ``limit``.

    Runs one count with map-side combine; only a flag reaches the driver.  Where a task takes many rows, whole buckets of
    groups are counted first, which shuffles next to nothing: mostly none of them holds too many.
    """
    limit = rows_per_task(df.sparkSession) if limit is None else limit
    if keys and limit >= BUCKETS:
        buckets = df.groupBy(F.pmod(F.hash(*keys), F.lit(BUCKETS)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        if buckets.where(F.col("_n") > limit).isEmpty():
            return False
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > limit).isEmpty()


def take_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Bring at most ``limit`` rows to the driver, refusing anything larger."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def deal_by_size(spark: SparkSession, input_bytes: int) -> None:
    """Let the number of shuffle partitions follow the input, so that a task's share, and its memory, does not grow.

    Rows of keys and times shrink well in a shuffle: the 64 MB that Spark gathers by default for a task are millions of
    rows, which a chain of joins and aggregates by one key sorts and holds side by side.  Smaller settings stay as they are.
    """
    if _bytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, str(max(least, -(-input_bytes // INPUT_BYTES_PER_PARTITION))))
