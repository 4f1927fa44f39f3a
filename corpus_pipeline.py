"""A corpus pipeline of five stages over the documents table.

Every stage reads what the one before kept, as Parquet in the shared folder, and all but the last return
the columns of documents.  Language identification drops documents without a language, line removal takes
boilerplate out of the texts, near-duplicate removal keeps one document of each group, decontamination
drops documents that hold a benchmark item, and packing makes the training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import decontamination, language_id, line_dedup, near_dedup, packing
from caseweave.llm.queries import tokenizer_path
from caseweave.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; a null text or one without a letter has none."""
    found = language_id.identify_languages(docs.select(*COLUMNS), keep_rows=True)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by what is left without cross-site boilerplate, and its length with it."""
    cleaned = line_dedup.remove_boilerplate(docs, also=("lang", "source"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With _key, the id as text, or for rows without an id a hash of the text; equal texts without an id share it."""
    own = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("t"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return docs.withColumn("_key", F.coalesce(own, text))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group, by five-word shingles.

    An id stands for one document: if any text under it is not kept, the id goes.  Of rows with equal id and
    text one stays.  Rows without an id come after all ids, in the order of the hashes of their texts.
    """
    keyed = _keyed(docs)
    # Ids as text sort otherwise than ids, so they are linked as numbers, and only then rows without an id.
    linked = near_dedup.link_near_duplicates(docs, k=5).where(~F.col("kept"))
    gone = linked.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("_key")).distinct()
    left = keyed.join(gone, "_key", "left_anti")
    if not docs.where(F.col("doc_id").isNull()).isEmpty():
        # A first letter "i" sorts before "t": a document with an id is kept before one without.
        linked = near_dedup.link_near_duplicates(left.where("text IS NOT NULL"), k=5, id_col="_key")
        nameless = linked.where(~F.col("kept") & F.col("_key").startswith("t")).select("_key").distinct()
        left = left.join(nameless, "_key", "left_anti")
    mark = F.xxhash64("text", F.lit("row"))
    repeated = written(
        left.groupBy("_key", mark.alias("_mark")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", "_mark"),
        "repeated",
    )
    left = left.withColumn("_mark", mark)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    again = (
        left.join(repeated, ["_key", "_mark"], "left_semi").groupBy("_key", "text")
        .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(*others)).alias("_rest")).select("*", "_rest.*")
    )
    once = left.join(repeated, ["_key", "_mark"], "left_anti")
    return once.select(*COLUMNS).unionByName(again.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold an item of the benchmark; rows without an id are judged text by text."""
    keyed = _keyed(docs)
    rows = keyed.select(F.col("_key").alias("doc_id"), "text")
    hit = decontamination.find_contamination(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key"))
    return keyed.join(hit.distinct(), "_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; one row per piece."""
    return packing.pack_documents(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("line_dedup", remove_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The tokenizer of the last stage, and hashing before it, are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
