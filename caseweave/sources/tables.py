"""Reading the clinical tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.operators.filters import keep

# The clinical tables and the columns read from them.
SCHEMAS: dict[str, str] = {
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, dod date",
    "admissions": "hadm_id bigint, subject_id bigint, admittime timestamp_ntz, "
    "dischtime timestamp_ntz, deathtime timestamp_ntz, admission_type string, "
    "discharge_location string, hospital_expire_flag int, language string, insurance string, "
    "race string",
    "icustays": "stay_id bigint, subject_id bigint, hadm_id bigint, intime timestamp_ntz, "
    "outtime timestamp_ntz, los double, first_careunit string",
    "diagnoses_icd": "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, "
    "icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "procedures_icd": "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, "
    "icd_version int",
    "d_labitems": "itemid int, label string, fluid string, category string",
    "labevents": "labevent_id bigint, subject_id bigint, hadm_id bigint, itemid int, "
    "charttime timestamp_ntz, valuenum double, valueuom string, ref_range_lower double, "
    "ref_range_upper double",
    "d_items": "itemid int, label string, category string",
    "chartevents": "subject_id bigint, hadm_id bigint, stay_id bigint, itemid int, "
    "charttime timestamp_ntz, value string, valuenum double",
    "microbiologyevents": "microevent_id bigint, subject_id bigint, hadm_id bigint, "
    "charttime timestamp_ntz, spec_type_desc string, org_name string",
    "prescriptions": "subject_id bigint, hadm_id bigint, starttime timestamp_ntz, "
    "stoptime timestamp_ntz, drug string, dose_val_rx double, dose_unit_rx string, route string",
    "procedureevents": "subject_id bigint, hadm_id bigint, stay_id bigint, itemid int, "
    "starttime timestamp_ntz, endtime timestamp_ntz",
    "inputevents": "subject_id bigint, hadm_id bigint, stay_id bigint, itemid int, "
    "starttime timestamp_ntz, endtime timestamp_ntz, rate double, amount double, "
    "rateuom string, amountuom string",
    "services": "subject_id bigint, hadm_id bigint, transfertime timestamp_ntz, "
    "prev_service string, curr_service string",
    "transfers": "subject_id bigint, hadm_id bigint, transfer_id bigint, "
    "intime timestamp_ntz, outtime timestamp_ntz",
    "omr": "subject_id bigint, chartdate date, result_name string, result_value string",
}

# Dialects of a table file, most wanted first.
SUFFIXES = (".csv.gz", ".csv", ".parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """IO2: a CSV file with a header, plain or compressed, columns found by name.

    Short rows are padded with NULL and cells that do not parse become NULL; cells
    past the header are ignored.  All cells are read as text and cast by name, so
    a file whose columns are ordered differently still loads.
    """
    text = (
        spark.read.option("header", True).option("mode", "PERMISSIVE")
        .option("enforceSchema", False).option("escape", '"').csv(path)
    )
    return normalise_types(text, schema) if schema else text


def normalise_types(df: DataFrame, schema: str) -> DataFrame:
    """IO8: the schema's columns, cast where the value allows; absent ones are NULL."""
    wanted = T.StructType.fromDDL(schema)
    present = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (
                F.col(f"`{present[f.name.lower()]}`").try_cast(f.dataType)
                if f.name.lower() in present
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in wanted.fields
        ]
    )


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """IO3: one table file, Parquet or CSV by its suffix."""
    schema = SCHEMAS.get(name)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return normalise_types(df, schema) if schema else df
    return read_csv(spark, path, schema)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark reads."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(path))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder, of any file system Spark reads; 0 if there is none."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    return system.getContentSummary(path).getLength() if system.exists(path) else 0


def load_tables(
    spark: SparkSession, root: str, folders: Sequence[str] = ("hosp", "icu")
) -> dict[str, DataFrame]:
    """IO4: every table below the folders, one per name, the most wanted format first."""
    found: dict[str, tuple[int, str]] = {}
    for folder in folders:
        for name in list_files(spark, f"{root}/{folder}"):
            for rank, suffix in enumerate(SUFFIXES):
                if name.endswith(suffix):
                    table = name[: -len(suffix)].lower()
                    if not re.fullmatch(r"\w+", table):
                        continue
                    if table not in found or rank < found[table][0]:
                        found[table] = (rank, f"{root}/{folder}/{name}")
                    break
    return {table: read_table(spark, path, table) for table, (_, path) in sorted(found.items())}


def restrict(big: DataFrame, cohort: DataFrame, key: str = "subject_id") -> DataFrame:
    """IO6: rows of a large table that belong to the cohort's subjects."""
    return keep(big, cohort, key)


# Tables large enough to be read for the cohort only.
LARGE = (
    "labevents", "chartevents", "prescriptions", "microbiologyevents", "inputevents",
    "procedureevents", "diagnoses_icd", "procedures_icd",
)


def load_for_cohort(
    tables: Mapping[str, DataFrame], cohort: DataFrame, large: Sequence[str] = LARGE
) -> dict[str, DataFrame]:
    """IO7: small tables as they are, large ones restricted to the cohort.

    Everything stays lazy, so the restriction is planned into each later query.
    Tables with a subject are restricted by subject, others by encounter.
    """
    loaded = {}
    for name, df in tables.items():
        if name in large:
            key = "subject_id" if "subject_id" in df.columns else "hadm_id"
            loaded[name] = restrict(df, cohort, key)
        else:
            loaded[name] = df
    return loaded


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """IO9: rows per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def join_check(subjects: DataFrame, encounters: DataFrame, stays: DataFrame) -> DataFrame:
    """IO9: subjects, encounters and stays that join to each other."""
    joined = subjects.select("subject_id").join(
        encounters.select("subject_id", "hadm_id"), "subject_id"
    ).join(stays.select("hadm_id", "stay_id"), "hadm_id")
    return joined.agg(
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_distinct("hadm_id").alias("n_encounters"),
        F.count_distinct("stay_id").alias("n_stays"),
    )
