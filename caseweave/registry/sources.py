"""Queries over reading, restricting, checking and writing tables (IO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import cohorts as co, filters as fl
from caseweave.operators.aggregates import lab_summary
from caseweave.registry.aggregates import LAB_SUMMARY_SQL, rounded
from caseweave.registry.case import case
from caseweave.sources import exports, tables


@case("io2_csv_scan", """
SELECT hadm_id, subject_id, admittime, dischtime, admission_type, discharge_location,
  hospital_expire_flag FROM admissions
""")
def _(t):
    path = exports.scratch(t.spark, "admissions") + ".csv"
    t.admissions.write.option("header", True).csv(path)
    return tables.read_csv(t.spark, path, tables.SCHEMAS["admissions"]).select(
        "hadm_id", "subject_id", "admittime", "dischtime", "admission_type", "discharge_location",
        "hospital_expire_flag",
    )


@case("io3_parquet_scan", """
SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM lineitem
WHERE l_shipdate >= DATE '1998-01-01' GROUP BY l_returnflag
""")
def _(t):
    rows = tables.read_table(t.spark, f"{t.folder}/lineitem.parquet", "lineitem")
    return rows.where(F.col("l_shipdate") >= "1998-01-01").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@case("io4_loaded_tables", """
SELECT 'admissions' AS "table", COUNT(*) AS n_rows FROM admissions
UNION ALL SELECT 'icustays', COUNT(*) FROM icustays UNION ALL SELECT 'patients', COUNT(*) FROM patients
""")
def _(t):
    root = exports.scratch(t.spark, "dataset")
    t.patients.write.option("header", True).csv(f"{root}/hosp/patients.csv")
    t.patients.limit(1).write.parquet(f"{root}/hosp/patients.parquet")
    t.admissions.write.option("header", True).csv(f"{root}/hosp/admissions.csv")
    t.icustays.write.parquet(f"{root}/icu/icustays.parquet")
    return tables.table_sizes(tables.load_tables(t.spark, root))


def stroke_subjects(t):
    cohort = co.diagnosis_cohort(
        t.icustays, co.ages(t.patients, t.admissions), t.diagnoses_icd, ["I63"]
    )
    return cohort.select("subject_id", "hadm_id")


STROKE_SQL = """
WITH s AS (SELECT s.subject_id, s.hadm_id FROM first_stay s JOIN age g ON s.hadm_id = g.hadm_id
WHERE DATE_DIFF('hour', s.intime, s.outtime) > 24 AND DATE_DIFF('hour', s.intime, s.outtime) < 2400
  AND g.age BETWEEN 18 AND 89 AND s.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE seq_num = 1
  AND ((icd_version = 10 AND icd_code LIKE 'I63%') OR (icd_version = 9
    AND (icd_code LIKE '433_1' OR icd_code LIKE '434_1' OR icd_code LIKE '436')))))
"""


@case("io6_restricted_scan", STROKE_SQL + """
SELECT labevent_id, hadm_id, valuenum FROM labevents WHERE subject_id IN (SELECT subject_id FROM s)
""")
def _(t):
    return tables.restrict(t.labevents, stroke_subjects(t)).select(
        "labevent_id", "hadm_id", "valuenum"
    )


@case("io7_cohort_load", STROKE_SQL + """
SELECT 'diagnoses_icd' AS "table", COUNT(*) AS n_rows FROM diagnoses_icd
  WHERE hadm_id IN (SELECT hadm_id FROM s)
UNION ALL SELECT 'labevents', COUNT(*) FROM labevents WHERE subject_id IN (SELECT subject_id FROM s)
UNION ALL SELECT 'patients', COUNT(*) FROM patients
""")
def _(t):
    loaded = tables.load_for_cohort(
        {"patients": t.patients, "labevents": t.labevents, "diagnoses_icd": t.diagnoses_icd},
        stroke_subjects(t),
    )
    return tables.table_sizes(loaded)


@case("io8_normalised_types", """
SELECT subject_id, chartdate, result_name, TRY_CAST(result_value AS DOUBLE) AS result_value FROM omr
""")
def _(t):
    text = t.omr.select(*[F.col(c).cast("string").alias(c.upper()) for c in t.omr.columns])
    return tables.normalise_types(
        text, "subject_id bigint, chartdate date, result_name string, result_value double"
    )


@case("io9_table_sizes", """
SELECT 'patients' AS "table", COUNT(*) AS n_rows FROM patients
UNION ALL SELECT 'prescriptions', COUNT(*) FROM prescriptions
""")
def _(t):
    return tables.table_sizes({"patients": t.patients, "prescriptions": t.prescriptions})


@case("io9_join_check", """
SELECT COUNT(DISTINCT p.subject_id) AS n_subjects, COUNT(DISTINCT a.hadm_id) AS n_encounters,
  COUNT(DISTINCT i.stay_id) AS n_stays FROM patients p JOIN admissions a
ON a.subject_id = p.subject_id JOIN icustays i ON i.hadm_id = a.hadm_id
""")
def _(t):
    return tables.join_check(t.patients, t.admissions, t.icustays)


@case("io10_feature_matrix", LAB_SUMMARY_SQL)
def _(t):
    path = exports.scratch(t.spark, "matrix")
    exports.write_matrix(lab_summary(t.labevents, t.d_labitems, t.icustays, t.admissions), path)
    return rounded(t.spark.read.parquet(path))


def decision_log(t):
    """A run log with one decision per event, written as JSON lines."""
    path = exports.scratch(t.spark, "log")
    t.events.select(
        F.lit("routing_decision").alias("kind"), F.lit("1").alias("schema_version"),
        F.upper("event_type").alias("plan"),
        F.when(F.col("value") > 50, "large").otherwise("small").alias("reason"),
        F.col("user_id").cast("string").alias("turn_id"),
        (F.col("event_type") == "error").alias("had_causal_fallthrough"),
    ).write.json(path)
    return exports.read_log(t.spark, path)


@case("io15_skipped_lines", """
SELECT COUNT(*) FILTER (event_type <> 'view' AND event_type <> 'click') AS n_read,
  COUNT(*) FILTER (event_type = 'view' OR event_type = 'click') AS n_skipped FROM events
""")
def _(t):
    path = exports.scratch(t.spark, "lines")
    record = F.to_json(F.struct(
        F.lit("routing_decision").alias("kind"),
        F.when(F.col("event_type") == "view", "0").otherwise("1").alias("schema_version"),
        F.col("event_type").alias("plan"),
    ))
    # Half of a record is a line that can't be read.
    t.events.select(
        F.when(F.col("event_type") == "click", F.substring(record, 1, 20)).otherwise(record).alias("value")
    ).write.text(path)
    return exports.skipped_lines(t.spark, path)


@case("io15_log_counts", """
SELECT 'plan' AS field, upper(event_type) AS value, COUNT(*) AS count FROM events GROUP BY 2
UNION ALL SELECT 'reason', CASE WHEN value > 50 THEN 'large' ELSE 'small' END, COUNT(*) FROM events
  GROUP BY 2
""")
def _(t):
    return exports.log_counts(decision_log(t)).where("value IS NOT NULL")


@case("io15_log_turns", """
WITH u AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT event_type) AS p,
  COUNT(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)
SELECT CAST(SUM(n) AS BIGINT) AS n_decisions, COUNT(*) AS n_turns, COUNT(*) FILTER (n > 1) AS n_multi,
  COUNT(*) FILTER (n > 1 AND p > 1) AS n_mixed, CAST(SUM(f) AS BIGINT) AS n_fallthrough FROM u
""")
def _(t):
    return exports.log_turns(decision_log(t))


@case("io14_prefix_categories", """
WITH h AS (SELECT DISTINCT hadm_id FROM diagnoses_icd WHERE icd_version = 10
  AND (icd_code LIKE 'E11%' OR icd_code LIKE 'E10%'))
SELECT 'diabetes' AS category, COUNT(*) AS n_encounters FROM h
UNION ALL SELECT 'failure', COUNT(DISTINCT hadm_id) FROM diagnoses_icd
  WHERE icd_version = 10 AND icd_code LIKE 'I50%'
""")
def _(t):
    from caseweave.operators.codes import match_prefixes
    from caseweave.sources.mappings import read_prefix_categories

    path = exports.scratch(t.spark, "mapping")
    t.spark.range(1).select(F.lit(
        '{"_note": {"about": "x"}, "diabetes": {"weight": 1, "icd10_prefixes": ["E10", "E11"]}, '
        '"failure": {"weight": 2, "icd10_prefixes": ["I50"]}}'
    ).alias("value")).write.text(path)
    table = read_prefix_categories(t.spark, path)
    coded = t.diagnoses_icd.where("icd_version = 10")
    hits = match_prefixes(coded, "icd_code", table)
    return coded.join(hits, "icd_code").groupBy("category").agg(
        F.count_distinct("hadm_id").alias("n_encounters")
    )


@case("io4_adult_mean", """
SELECT ROUND(AVG(i.los), 6) AS mean_days FROM icustays i JOIN admissions a ON i.hadm_id = a.hadm_id
JOIN patients p ON a.subject_id = p.subject_id WHERE p.anchor_age >= 18
""")
def _(t):
    root = exports.scratch(t.spark, "adults")
    t.patients.write.option("header", True).csv(f"{root}/hosp/patients.csv")
    t.admissions.write.parquet(f"{root}/hosp/admissions.parquet")
    t.icustays.write.parquet(f"{root}/icu/icustays.parquet")
    loaded = tables.load_tables(t.spark, root)
    adults = fl.by_age(loaded["admissions"], loaded["patients"], ">=", 18)
    return rounded(fl.keep(loaded["icustays"], adults).agg(F.avg("los").alias("mean_days")))
