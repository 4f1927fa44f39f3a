"""Columns and sampling that several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.session import checkpoint_dir

#: White space that separates words, as the body of a character class of Java and DuckDB.
BLANK = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` as Parquet in the shared checkpoint folder and read them again."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Send rows to Python in smaller Arrow batches, for eager steps on wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % F.lit(folds)).cast("int")


def bounded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, chosen by a hash of ``key``; all of them if there are fewer.

    No sort: rows are kept below a hash threshold that follows from one count.
    Rows with equal keys stay or go together.
    """
    total = rows.count()
    if total <= limit:
        return rows
    steps = 1 << 30
    share = int(steps * limit / total)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(steps)) < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``docs`` with a non-null ``label`` column; a document labelled twice gets the larger label."""
    marks = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    return docs.join(marks, "doc_id")
