"""The registered queries of this package: one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseweave.llm import (
    checks,
    decontamination,
    fingerprints,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    spelling,
    toxicity,
)
from caseweave.llm.shared import table

#: The vocabulary of the packing query.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, folder, "documents"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, folder, "documents"))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.link_near_duplicates(table(spark, folder, "documents"), k=4)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_spellings(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_packing, op4_quality_classifier, op5_line_dedup, op6_pii,
        op7_near_dedup, op8_language_id, op9_decontamination, op10_sharding, op11_prefix_trie, op12_fingerprints, op13_spelling_variants,
    )
}
CHECKS: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL, "op7_near_dedup": checks.NEAR_DEDUP, "op11_prefix_trie": checks.PREFIX_TRIE,
    "op12_fingerprints": checks.FINGERPRINTS,
    "op13_spelling_variants": checks.SPELLING,
}
