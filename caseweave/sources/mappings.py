"""Mapping tables: JSON files and the built-in ones as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave import rules


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as (name, body) rows; names that start with ``_`` are notes.

    The file is one object, so it is read whole; mapping files are small.
    """
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return text.select(F.explode(entries).alias("name", "body")).where(~F.col("name").startswith("_"))


def read_prefix_categories(spark: SparkSession, path: str) -> DataFrame:
    """IO14: (category, weight, prefix) from objects with weight and icd10_prefixes."""
    body = F.from_json("body", "weight int, icd10_prefixes array<string>")
    return read_mapping(spark, path).select(
        F.col("name").alias("category"), body.alias("b")
    ).select("category", F.col("b.weight").alias("weight"),
             F.explode("b.icd10_prefixes").alias("prefix"))


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """IO14: (cohort, version, prefix) from named cohorts; dots are dropped."""
    body = F.from_json("body", "icd10_prefixes array<string>, icd9_prefixes array<string>")
    rows = read_mapping(spark, path).select(F.col("name").alias("cohort"), body.alias("b"))
    parts = [
        rows.select("cohort", F.lit(v).alias("icd_version"), F.explode(f"b.icd{v}_prefixes").alias("prefix"))
        for v in (10, 9)
    ]
    return parts[0].unionByName(parts[1]).withColumn(
        "prefix", F.upper(F.regexp_replace("prefix", r"\.", ""))
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """IO14: (group, pattern) from groups with member patterns."""
    body = F.from_json("body", "patterns array<string>")
    return read_mapping(spark, path).select(
        F.col("name").alias("group"), F.explode(body["patterns"]).alias("pattern")
    )


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """IO14: (category, concept_id, kind, member) from curated categories; kind may be missing."""
    body = F.from_json("body", "snomed_code string, kind string, members array<string>")
    return read_mapping(spark, path).select(F.col("name").alias("category"), body.alias("b")).select(
        "category", F.col("b.snomed_code").alias("concept_id"), F.col("b.kind").alias("kind"),
        F.explode("b.members").alias("member"),
    )


def read_concepts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """IO14: (key, concept_id, term) from code-to-concept objects."""
    body = F.from_json("body", "snomed_code string, snomed_term string, loinc string")
    return read_mapping(spark, path).select(F.col("name").alias(key), body.alias("b")).select(
        key, F.col("b.snomed_code").alias("concept_id"), F.col("b.snomed_term").alias("term"),
        F.col("b.loinc").alias("loinc"),
    )


def charlson_table(spark: SparkSession) -> DataFrame:
    """The built-in comorbidity categories as (category, weight, prefix)."""
    return spark.createDataFrame(
        rules.charlson_prefixes(), "category string, weight int, prefix string"
    )


def cohort_table(
    spark: SparkSession, cohorts: Mapping[str, Mapping[str, Sequence[str]]] = rules.COHORTS
) -> DataFrame:
    """The built-in named cohorts as (cohort, icd_version, prefix)."""
    rows = [
        (name, version, prefix.replace(".", "").upper())
        for name, spec in cohorts.items()
        for version in (10, 9) for prefix in spec[f"icd{version}"]
    ]
    return spark.createDataFrame(rows, "cohort string, icd_version int, prefix string")
