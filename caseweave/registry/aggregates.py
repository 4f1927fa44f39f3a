"""Queries over aggregates, comparisons, summaries and profiles (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import aggregates as ag, cohorts as co, codes as cd, filters as fl
from caseweave.registry.case import case
from caseweave.registry.cohorts import HEAD_SQL, STATUS_SQL, head_cohort, status_labels
from caseweave.registry.filters import SCREEN_SQL, lab_limits


def rounded(df, digits=6):
    """Round every double column, so that summation order does not show."""
    return df.select(
        *[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    )


def over_65(t):
    return fl.by_age(t.admissions, t.patients, ">", 65)


OVER_65 = "(SELECT a.hadm_id FROM admissions a JOIN patients p ON a.subject_id = p.subject_id " \
    "WHERE p.anchor_age > 65)"


def _event_case(how, sql, column):
    @case(f"a1_event_{how}", f"""
SELECT {sql} AS {column} FROM labevents WHERE itemid = 50912 AND valuenum IS NOT NULL
AND hadm_id IN {OVER_65}
""")
    def _(t):
        readings = fl.measured(t.labevents, itemids=[50912])
        return rounded(ag.event_aggregate(readings, over_65(t), how))


for _how, _sql, _column in (
    ("mean", "ROUND(AVG(valuenum), 6)", "mean_value"),
    ("max", "MAX(valuenum)", "max_value"),
    ("min", "MIN(valuenum)", "min_value"),
    ("count", "COUNT(valuenum)", "count_value"),
):
    _event_case(_how, _sql, _column)


@case("a1_label_mean", f"""
SELECT ROUND(AVG(valuenum), 6) AS mean_value FROM labevents l JOIN d_labitems d
ON l.itemid = d.itemid WHERE d.label ILIKE '%sodium%' AND l.valuenum IS NOT NULL
AND hadm_id IN {OVER_65}
""")
def _(t):
    readings = fl.measured(t.labevents, dictionary=t.d_labitems, label="sodium")
    return rounded(ag.event_aggregate(readings, over_65(t), "mean"))


@case("a2_screened_mean", f"""
SELECT ROUND(AVG(CASE WHEN clean THEN valuenum END), 6) AS mean_value,
  ROUND(AVG(valuenum), 6) AS mean_value_with_outliers,
  COUNT(*) FILTER (NOT clean) AS n_outliers, COUNT(valuenum) AS n_total
FROM ({SCREEN_SQL}) WHERE itemid = 50912
""")
def _(t):
    screened = fl.screen(t.labevents.where("itemid = 50912"), lab_limits(t))
    return rounded(ag.screened_aggregate(screened, "mean"))


AXES = {
    "gender": "p.gender", "age": "p.anchor_age", "admission_type": "a.admission_type",
    "discharge_location": "a.discharge_location", "readmitted_30d": "r.readmitted_30d",
    "readmitted_60d": "r.readmitted_60d",
}


def _axis_case(axis, column):
    @case(f"a3_by_{axis}", f"""
SELECT {column} AS group_value, ROUND(AVG(l.valuenum), 6) AS avg_value, COUNT(l.valuenum) AS count
FROM labevents l JOIN admissions a ON l.hadm_id = a.hadm_id JOIN patients p
ON a.subject_id = p.subject_id JOIN readmit_flags r ON r.hadm_id = a.hadm_id
WHERE l.itemid = 50912 AND l.valuenum IS NOT NULL GROUP BY {column}
""")
    def _(t):
        readings = fl.measured(t.labevents, itemids=[50912])
        groups = ag.axis_values(t.admissions, t.patients, axis)
        return rounded(ag.compare_values(readings, groups))


for _axis, _expression in AXES.items():
    _axis_case(_axis, _expression)


@case("a4_by_condition", """
SELECT CASE WHEN EXISTS (SELECT 1 FROM procedureevents pe WHERE pe.hadm_id = l.hadm_id
  AND pe.itemid IN (225792, 224385, 225794)) THEN 'yes' ELSE 'no' END AS group_value,
  ROUND(AVG(l.valuenum), 6) AS avg_value, COUNT(l.valuenum) AS count
FROM labevents l WHERE l.itemid = 50912 AND l.valuenum IS NOT NULL GROUP BY group_value
""")
def _(t):
    ventilated = t.procedureevents.where(F.col("itemid").isin(225792, 224385, 225794))
    groups = ag.condition_values(t.admissions, ventilated)
    return rounded(ag.compare_values(fl.measured(t.labevents, itemids=[50912]), groups))


@case("a5_drug_count", f"""
SELECT COUNT(DISTINCT hadm_id) AS count_value FROM prescriptions
WHERE drug ILIKE '%heparin%' AND hadm_id IN {OVER_65}
""")
def _(t):
    rows = t.prescriptions.where(fl.contains_any(F.col("drug"), ["heparin"]))
    return ag.encounter_count(rows, over_65(t))


@case("a5_drug_by_gender", """
SELECT p.gender AS group_value, COUNT(DISTINCT pr.hadm_id) AS count FROM prescriptions pr
JOIN admissions a ON pr.hadm_id = a.hadm_id JOIN patients p ON a.subject_id = p.subject_id
WHERE pr.drug ILIKE '%heparin%' GROUP BY p.gender
""")
def _(t):
    rows = t.prescriptions.where(fl.contains_any(F.col("drug"), ["heparin"]))
    return ag.compare_encounters(rows, ag.axis_values(t.admissions, t.patients, "gender"))


@case("a6_culture_count", """
SELECT COUNT(DISTINCT hadm_id) AS count_value FROM microbiologyevents
WHERE (spec_type_desc ILIKE '%urine%' OR org_name ILIKE '%urine%')
  AND (spec_type_desc ILIKE '%coli%' OR org_name ILIKE '%coli%') AND org_name IS NOT NULL
""")
def _(t):
    rows = ag.cultures_of(t.microbiologyevents, ["urine culture"], ["coli"], "positive")
    return ag.encounter_count(rows, t.admissions)


@case("a7_diagnosis_count", """
SELECT COUNT(DISTINCT hadm_id) AS count_value FROM diagnoses_icd WHERE seq_num = 1
AND (icd_code LIKE 'I63%' OR icd_code LIKE '43391%')
""")
def _(t):
    rows = ag.diagnoses_of(
        t.diagnoses_icd, t.d_icd_diagnoses, [], ["I63", "433.91"], principal_only=True
    )
    return ag.encounter_count(rows, t.admissions)


@case("a7_diagnosis_by_title", """
SELECT a.admission_type AS group_value, COUNT(DISTINCT di.hadm_id) AS count
FROM diagnoses_icd di JOIN d_icd_diagnoses dd ON di.icd_code = dd.icd_code
AND di.icd_version = dd.icd_version JOIN admissions a ON a.hadm_id = di.hadm_id
WHERE dd.long_title ILIKE '%kidney%' OR dd.long_title ILIKE '%sepsis%' GROUP BY 1
""")
def _(t):
    rows = ag.diagnoses_of(t.diagnoses_icd, t.d_icd_diagnoses, ["kidney", "sepsis"])
    return ag.compare_encounters(rows, ag.axis_values(t.admissions, t.patients, "admission_type"))


@case("a8_diagnosis_list", f"""
SELECT a.subject_id AS "subjectId", di.hadm_id AS "hadmId", di.icd_code AS "icdCode",
  dd.long_title AS "longTitle" FROM diagnoses_icd di LEFT JOIN d_icd_diagnoses dd
ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
JOIN admissions a ON di.hadm_id = a.hadm_id
WHERE (dd.long_title ILIKE '%S06%' OR di.icd_code LIKE 'S06%') AND di.hadm_id IN {OVER_65}
""")
def _(t):
    return ag.diagnosis_list(t.diagnoses_icd, t.d_icd_diagnoses, over_65(t), "S06")


@case("a9_death_rate", """
SELECT hospital_expire_flag, COUNT(DISTINCT hadm_id) AS count,
  ROUND(COUNT(DISTINCT hadm_id) / SUM(COUNT(DISTINCT hadm_id)) OVER (), 8) AS fraction
FROM admissions GROUP BY hospital_expire_flag
""")
def _(t):
    return rounded(ag.outcome_rate(t.admissions, "hospital_expire_flag"), 8)


@case("a9_readmission_rate_by_gender", """
SELECT p.gender AS group_value, r.readmitted_30d, COUNT(DISTINCT a.hadm_id) AS count,
  ROUND(COUNT(DISTINCT a.hadm_id) / SUM(COUNT(DISTINCT a.hadm_id)) OVER (PARTITION BY p.gender), 8)
    AS fraction
FROM admissions a JOIN patients p ON a.subject_id = p.subject_id JOIN readmit_flags r
ON a.hadm_id = r.hadm_id GROUP BY p.gender, r.readmitted_30d
""")
def _(t):
    groups = ag.axis_values(t.admissions, t.patients, "gender")
    return rounded(
        ag.outcome_rate(co.readmission_flags(t.admissions), "readmitted_30d", groups), 8
    )


@case("a10_median", f"""
SELECT ROUND(MEDIAN(valuenum), 6) AS median_value FROM labevents
WHERE itemid = 50912 AND valuenum IS NOT NULL AND hadm_id IN {OVER_65}
""")
def _(t):
    readings = fl.measured(t.labevents, itemids=[50912])
    return rounded(ag.event_aggregate(readings, over_65(t), "median"))


@case("a11_sum", f"SELECT SUM(valuenum) AS sum_value FROM labevents WHERE itemid = 50813 "
      f"AND hadm_id IN {OVER_65}")
def _(t):
    return ag.event_aggregate(fl.measured(t.labevents, itemids=[50813]), over_65(t), "sum")


@case("a11_exists", f"SELECT COUNT(*) > 0 AS exists_value FROM labevents WHERE itemid = 50813 "
      f"AND valuenum > 49 AND hadm_id IN {OVER_65}")
def _(t):
    readings = fl.measured(t.labevents, itemids=[50813]).where("valuenum > 49")
    return ag.event_aggregate(readings, over_65(t), "exists")


LAB_SUMMARY_SQL = """
SELECT i.hadm_id, d.label, ROUND(AVG(l.valuenum), 6) AS mean, MIN(l.valuenum) AS min,
  MAX(l.valuenum) AS max, ROUND(CASE WHEN COUNT(*) > 1 THEN STDDEV_POP(l.valuenum) ELSE 0.0 END, 6)
    AS std, COUNT(*) AS count,
  arg_min(l.valuenum, (l.charttime, l.labevent_id, l.valuenum)) AS first,
  arg_max(l.valuenum, (l.charttime, l.labevent_id, l.valuenum)) AS last,
  ROUND(AVG(CASE WHEN l.valuenum < l.ref_range_lower THEN 1.0 WHEN l.valuenum > l.ref_range_upper
    THEN 1.0 ELSE 0.0 END), 6) AS abnormal_rate
FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid JOIN icustays i ON l.hadm_id = i.hadm_id
WHERE l.valuenum IS NOT NULL AND l.charttime >= i.intime AND l.charttime <= i.outtime
GROUP BY i.hadm_id, d.label
"""


@case("a13_lab_summary", LAB_SUMMARY_SQL)
def _(t):
    return rounded(ag.lab_summary(t.labevents, t.d_labitems, t.icustays, t.admissions))


VITAL_SUMMARY_SQL = """
SELECT i.hadm_id, d.label, ROUND(AVG(c.valuenum), 6) AS mean, MIN(c.valuenum) AS min,
  MAX(c.valuenum) AS max, ROUND(CASE WHEN COUNT(*) > 1 THEN STDDEV_POP(c.valuenum) ELSE 0.0 END, 6)
    AS std, COUNT(*) AS count, ROUND(CASE WHEN AVG(c.valuenum) = 0 THEN 0.0 ELSE
  CASE WHEN COUNT(*) > 1 THEN STDDEV_POP(c.valuenum) ELSE 0.0 END / AVG(c.valuenum) END, 6) AS cv
FROM chartevents c JOIN d_items d ON c.itemid = d.itemid JOIN icustays i ON c.stay_id = i.stay_id
WHERE c.valuenum IS NOT NULL GROUP BY i.hadm_id, d.label
"""


@case("a14_vital_summary", VITAL_SUMMARY_SQL)
def _(t):
    return rounded(ag.vital_summary(t.chartevents, t.d_items, t.icustays, t.admissions))


MEDICATION_SQL = """
SELECT c.hadm_id, COALESCE(p.n, 0) AS num_distinct_meds,
  ROUND(COALESCE(p.d, 0.0), 6) AS total_prescription_days,
  CASE WHEN p.n IS NOT NULL THEN 1 ELSE 0 END AS has_prescription
FROM admissions c LEFT JOIN (SELECT hadm_id, COUNT(DISTINCT drug) AS n,
  SUM(DATE_DIFF('second', starttime, stoptime) / 86400.0) AS d FROM prescriptions
  WHERE starttime IS NOT NULL AND stoptime IS NOT NULL GROUP BY hadm_id) p ON c.hadm_id = p.hadm_id
"""


@case("a15_medication_summary", MEDICATION_SQL)
def _(t):
    return rounded(ag.medication_summary(t.admissions, t.prescriptions))


DIAGNOSIS_SQL = """
SELECT c.hadm_id, COALESCE(d.n, 0) AS num_diagnoses, COALESCE(d.ch, 'Unknown') AS primary_chapter
FROM admissions c LEFT JOIN (SELECT hadm_id, COUNT(*) AS n,
  UPPER(LEFT(MIN(CASE WHEN seq_num = 1 THEN icd_code END), 1)) AS ch FROM diagnoses_icd
  GROUP BY hadm_id) d ON c.hadm_id = d.hadm_id
"""


@case("a16_diagnosis_summary", DIAGNOSIS_SQL)
def _(t):
    return ag.diagnosis_summary(t.admissions, t.diagnoses_icd)


@case("a17_abnormal_rate", """
SELECT itemid, ROUND(AVG(CASE WHEN valuenum < ref_range_lower THEN 1.0
  WHEN valuenum > ref_range_upper THEN 1.0 ELSE 0.0 END), 6) AS abnormal_rate
FROM labevents WHERE valuenum IS NOT NULL GROUP BY itemid
""")
def _(t):
    known = t.labevents.where("valuenum IS NOT NULL")
    return rounded(
        known.groupBy("itemid").agg(F.avg(ag.abnormal(F.col("valuenum"))).alias("abnormal_rate"))
    )


@case("a18_widened_labs", f"""
SELECT hadm_id, MAX(CASE WHEN label = 'Creatinine' THEN mean END) AS "Creatinine_mean",
  MAX(CASE WHEN label = 'Creatinine' THEN count END) AS "Creatinine_count",
  MAX(CASE WHEN label = 'Sodium' THEN mean END) AS "Sodium_mean",
  MAX(CASE WHEN label = 'Sodium' THEN count END) AS "Sodium_count"
FROM ({LAB_SUMMARY_SQL}) GROUP BY hadm_id
""")
def _(t):
    long = ag.lab_summary(t.labevents, t.d_labitems, t.icustays, t.admissions)
    return rounded(ag.widen(long, "hadm_id", "label", ["mean", "count"], ["Creatinine", "Sodium"]))


@case("a19_one_hot_from_data", """
SELECT hadm_id, CASE WHEN discharge_location = 'AGAINST ADVICE' THEN 1 ELSE 0 END
    AS "location_AGAINST ADVICE",
  CASE WHEN discharge_location = 'HOME' THEN 1 ELSE 0 END AS "location_HOME",
  CASE WHEN discharge_location = 'HOSPICE' THEN 1 ELSE 0 END AS "location_HOSPICE",
  CASE WHEN discharge_location = 'REHAB' THEN 1 ELSE 0 END AS "location_REHAB" FROM admissions
""")
def _(t):
    return ag.one_hot_from_data(
        t.admissions.select("hadm_id", "discharge_location"), "discharge_location", "location", 20
    )


@case("a20_one_hot_frozen", """
SELECT hadm_id, CASE WHEN discharge_location = 'HOME' THEN 1 ELSE 0 END AS "location_HOME",
  CASE WHEN discharge_location = 'SNF' THEN 1 ELSE 0 END AS "location_SNF",
  CASE WHEN discharge_location IN ('HOME', 'SNF') THEN 0 ELSE 1 END AS "location_other"
FROM admissions
""")
def _(t):
    flags = co.one_hot("discharge_location", ["HOME", "SNF"], "location")
    return t.admissions.select("hadm_id", *[c.alias(n) for n, c in flags.items()])


@case("a21_categorical_domain", """
SELECT discharge_location AS value, COUNT(*) AS n FROM admissions
WHERE discharge_location IS NOT NULL GROUP BY 1 ORDER BY n DESC, value
""")
def _(t):
    return ag.categorical_domain(t.admissions, "discharge_location")


def lab_extremes(t):
    item = F.col("itemid")
    return t.labevents.groupBy("hadm_id").agg(
        F.max(F.when(item == 50912, F.col("valuenum"))).alias("creatinine_max"),
        F.avg(F.when(item == 50983, F.col("valuenum"))).alias("sodium_mean"),
        F.min(F.when(item == 51265, F.col("valuenum"))).alias("platelet_min"),
        F.min(F.when(item == 1, F.col("valuenum"))).alias("never"),
    )


EXTREMES_SQL = """
SELECT hadm_id, MAX(CASE WHEN itemid = 50912 THEN valuenum END) AS creatinine_max,
  AVG(CASE WHEN itemid = 50983 THEN valuenum END) AS sodium_mean,
  MIN(CASE WHEN itemid = 51265 THEN valuenum END) AS platelet_min FROM labevents GROUP BY hadm_id
"""
LONG_SQL = f"""
WITH w AS ({EXTREMES_SQL}), long AS (SELECT 'creatinine_max' AS feature, creatinine_max AS v FROM w
  UNION ALL SELECT 'sodium_mean', sodium_mean FROM w
  UNION ALL SELECT 'platelet_min', platelet_min FROM w)
"""
COLUMNS = ["creatinine_max", "sodium_mean", "platelet_min"]


@case("a22_reference_ranges", LONG_SQL + """
SELECT feature, ROUND(quantile_cont(v, 0.01), 6) AS low, ROUND(quantile_cont(v, 0.99), 6) AS high,
  COUNT(v) AS n FROM long WHERE v IS NOT NULL GROUP BY feature
""")
def _(t):
    return rounded(ag.reference_ranges(lab_extremes(t), [*COLUMNS, "never"]))


@case("a23_distribution", """
WITH v AS (SELECT valuenum, valueuom FROM labevents WHERE itemid = 50912 AND valuenum IS NOT NULL
  AND hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE (icd_version = 10
    AND icd_code LIKE 'N17%') OR (icd_version = 9 AND icd_code LIKE '584%')))
SELECT 50912 AS itemid, COUNT(*) AS n, ROUND(AVG(valuenum), 6) AS mean,
  ROUND(quantile_cont(valuenum, 0.5), 6) AS p50, ROUND(quantile_cont(valuenum, 0.95), 6) AS p95,
  (SELECT valueuom FROM v WHERE valueuom IS NOT NULL GROUP BY valueuom
    ORDER BY COUNT(*) DESC, valueuom LIMIT 1) AS units
FROM v HAVING COUNT(*) >= 20
""")
def _(t):
    kidney = fl.by_named_cohort(t.admissions, t.diagnoses_icd, "acute kidney injury")
    return rounded(ag.distribution(t.labevents, 50912, kidney, min_n=20))


@case("a23_distribution_approximate")
def _(t):
    kidney = fl.by_named_cohort(t.admissions, t.diagnoses_icd, "acute kidney injury")
    return ag.approximate_distribution(t.labevents, 50912, kidney)


CATALOG_SQL = """
WITH rows_ AS ({rows}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY valuenum) - 1 AS r,
  COUNT(*) OVER (PARTITION BY {keys}) AS size FROM rows_),
modes AS (SELECT {keys}, arg_min(valueuom, (-n, valueuom)) AS units FROM (SELECT {keys}, valueuom,
  COUNT(*) AS n FROM rows_ WHERE valueuom IS NOT NULL GROUP BY {keys}, valueuom) GROUP BY {keys})
SELECT {out}, size AS n, ROUND(AVG(valuenum), 6) AS mean,
  MAX(CASE WHEN r = size // 2 THEN valuenum END) AS p50,
  MAX(CASE WHEN r = LEAST(size - 1, CAST(FLOOR(0.95 * size) AS BIGINT)) THEN valuenum END) AS p95,
  m.units {extra}
FROM ranked JOIN modes m USING ({keys}) {join} GROUP BY {out}, size, m.units {group}
"""


@case("a24_item_catalog", CATALOG_SQL.format(
    rows="SELECT itemid, valuenum, valueuom, ref_range_lower, ref_range_upper FROM labevents "
    "WHERE valuenum IS NOT NULL AND itemid IN (SELECT itemid FROM labevents "
    "WHERE valuenum IS NOT NULL GROUP BY itemid HAVING COUNT(*) >= 500 "
    "ORDER BY COUNT(*) DESC, itemid LIMIT 4)",
    keys="itemid", out="itemid", extra=", 10.0::DOUBLE AS ref_lo, 40.0::DOUBLE AS ref_hi",
    join="", group=""))
def _(t):
    return rounded(ag.item_catalog(t.labevents, 500, 4))


COHORT_LIST = {
    "aki": "(icd_version = 10 AND icd_code LIKE 'N17%') OR (icd_version = 9 AND icd_code LIKE '584%')",
    "heart_failure": "(icd_version = 10 AND icd_code LIKE 'I50%')",
    "septic_shock": "(icd_version = 10 AND icd_code LIKE 'R6521%')",
}
MEMBERS_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT hadm_id, '{name}' AS cohort FROM diagnoses_icd WHERE {condition}"
    for name, condition in COHORT_LIST.items()
)


@case("a25_cohort_memberships", MEMBERS_SQL)
def _(t):
    return ag.cohort_memberships(t.diagnoses_icd).where(F.col("cohort").isin(list(COHORT_LIST)))


@case("a25_stratified_catalog", CATALOG_SQL.format(
    rows="SELECT l.itemid, m.cohort, l.valuenum, l.valueuom FROM labevents l JOIN "
    f"(SELECT hadm_id, cohort FROM ({MEMBERS_SQL}) UNION ALL SELECT hadm_id, 'all' FROM admissions)"
    " m ON l.hadm_id = m.hadm_id WHERE l.valuenum IS NOT NULL AND l.itemid IN (50912, 50983)",
    keys="itemid, cohort", out="itemid, cohort", extra="", join="", group=""))
def _(t):
    stats = ag.stratified_catalog(t.labevents, t.diagnoses_icd, 500, 2, 20)
    wanted = ["all", *COHORT_LIST]
    return rounded(stats.where(F.col("cohort").isin(wanted)))


@case("a26_event_counts", "SELECT kind, COUNT(*) AS count FROM stay_events GROUP BY kind")
def _(t):
    return ag.count_by(t.stay_events, "kind")


@case("a27_distinct_drugs", """
SELECT hadm_id, COUNT(DISTINCT drug) AS n_drugs FROM prescriptions
WHERE hadm_id IN (SELECT hadm_id FROM icustays) GROUP BY hadm_id
""")
def _(t):
    return ag.distinct_drugs(t.prescriptions, t.icustays)


@case("a28_stay_hours", """
SELECT hadm_id, ROUND(SUM(DATE_DIFF('second', intime, outtime) / 3600.0), 6) AS hours
FROM icustays GROUP BY hadm_id
""")
def _(t):
    return rounded(ag.stay_hours(t.icustays))


@case("a29_any_positive", """
SELECT a.subject_id, MAX(r.readmitted_30d) AS patient_label FROM admissions a
JOIN readmit_flags r ON a.hadm_id = r.hadm_id GROUP BY a.subject_id
""")
def _(t):
    flags = t.admissions.select("hadm_id", "subject_id").join(
        co.readmission_flags(t.admissions), "hadm_id"
    )
    return ag.any_positive(flags, "subject_id", "readmitted_30d", "patient_label")


@case("a30_filled", f"""
WITH w AS ({EXTREMES_SQL}), x AS (SELECT a.hadm_id, w.creatinine_max, w.sodium_mean, m.n AS num_cultures
  FROM admissions a LEFT JOIN w ON a.hadm_id = w.hadm_id
  LEFT JOIN (SELECT hadm_id, COUNT(*) AS n FROM microbiologyevents GROUP BY 1) m
  ON a.hadm_id = m.hadm_id)
SELECT hadm_id, COALESCE(num_cultures, 0) AS num_cultures,
  ROUND(COALESCE(creatinine_max, (SELECT MEDIAN(creatinine_max) FROM x)), 6) AS creatinine_max,
  ROUND(COALESCE(sodium_mean, (SELECT MEDIAN(sodium_mean) FROM x)), 6) AS sodium_mean FROM x
""")
def _(t):
    cultures = t.microbiologyevents.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("num_cultures"))
    frame = (
        t.admissions.select("hadm_id")
        .join(lab_extremes(t).select("hadm_id", "creatinine_max", "sodium_mean"), "hadm_id", "left")
        .join(cultures, "hadm_id", "left")
    )
    return rounded(ag.fill_missing(frame, ["hadm_id"]))


@case("a31_cohort_summary", f"""
WITH l AS (SELECT s.*, h.gcs_total FROM ({STATUS_SQL}) s JOIN ({HEAD_SQL}) h ON s.stay_id = h.stay_id)
SELECT COUNT(*) AS n, CAST(SUM(wlst_label) AS BIGINT) AS n_positive,
  ROUND(AVG(wlst_label), 6) AS positive_rate,
  CAST(SUM(hospital_expire_flag) AS BIGINT) AS n_died, ROUND(AVG(gcs_total), 6) AS gcs_mean,
  MIN(gcs_total) AS gcs_min, MAX(gcs_total) AS gcs_max,
  COUNT(*) FILTER (hours_to_code_change <= 48) AS n_changed_48h,
  ROUND(AVG(CASE WHEN hours_to_code_change IS NOT NULL THEN
    CASE WHEN hours_to_code_change <= 48 THEN 1 ELSE 0 END END), 6) AS share_changed_48h,
  MEDIAN(gcs_total) AS gcs_median, MEDIAN(hours_to_code_change) AS hours_median FROM l
""")
def _(t):
    labels = co.status_change_labels(head_cohort(t), t.chartevents, t.admissions)
    return rounded(ag.cohort_summary(labels))


@case("a31_outcome_counts", f"""
SELECT outcome_category, COUNT(*) AS count FROM ({STATUS_SQL}) GROUP BY 1
""")
def _(t):
    return ag.count_by(status_labels(t), "outcome_category")


@case("a33_death_counts", """
SELECT hospital_expire_flag, COUNT(DISTINCT hadm_id) AS count FROM admissions
WHERE hospital_expire_flag IS NOT NULL GROUP BY 1
""")
def _(t):
    return ag.flag_counts(t.admissions)


@case("a34_profile", LONG_SQL + """
, m AS (SELECT feature, arg_min(v, (-n, v)) AS mode FROM (SELECT feature, v, COUNT(*) AS n FROM long
  WHERE v IS NOT NULL GROUP BY feature, v) GROUP BY feature)
SELECT feature, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std,
  MIN(v) AS min, MAX(v) AS max, ROUND(AVG(CASE WHEN v IS NULL THEN 1 ELSE 0 END), 6) AS missing_share,
  ROUND(VAR_SAMP(v), 6) AS variance, ROUND(quantile_cont(v, 0.25), 6) AS p25,
  ROUND(quantile_cont(v, 0.5), 6) AS p50, ROUND(quantile_cont(v, 0.75), 6) AS p75, m.mode AS mode,
  CASE WHEN VAR_SAMP(v) = 0 THEN 'zero' WHEN VAR_SAMP(v) < 0.01 THEN 'low' ELSE 'normal' END
    AS variance_class
FROM long JOIN m USING (feature) GROUP BY feature, m.mode
""")
def _(t):
    return rounded(ag.profile(lab_extremes(t), COLUMNS))


@case("a34_class_balance", """
SELECT readmitted_30d, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 8) AS fraction
FROM readmit_flags GROUP BY readmitted_30d
""")
def _(t):
    return rounded(ag.class_balance(co.readmission_flags(t.admissions), "readmitted_30d"), 8)


@case("a35_label_correlations", f"""
WITH w AS ({EXTREMES_SQL}), x AS (SELECT w.*, r.readmitted_30d AS y FROM w JOIN readmit_flags r
  ON w.hadm_id = r.hadm_id)
SELECT 'creatinine_max' AS feature, ROUND(CORR(creatinine_max, y), 6) AS correlation FROM x
UNION ALL SELECT 'sodium_mean', ROUND(CORR(sodium_mean, y), 6) FROM x
UNION ALL SELECT 'platelet_min', ROUND(CORR(platelet_min, y), 6) FROM x
""")
def _(t):
    frame = lab_extremes(t).join(co.readmission_flags(t.admissions), "hadm_id")
    return rounded(ag.label_correlations(frame, COLUMNS, "readmitted_30d"))


@case("a36_rate_by_type", """
SELECT a.admission_type, COUNT(*) AS n, CAST(SUM(r.readmitted_30d) AS BIGINT) AS n_positive,
  ROUND(AVG(r.readmitted_30d), 6) AS rate FROM admissions a JOIN readmit_flags r
ON a.hadm_id = r.hadm_id GROUP BY a.admission_type
""")
def _(t):
    frame = t.admissions.join(co.readmission_flags(t.admissions), "hadm_id")
    return rounded(ag.rate_by(frame, "admission_type", "readmitted_30d"))


@case("a37_subject_overview", """
SELECT gender, COUNT(*) AS n, ROUND(AVG(anchor_age), 6) AS mean_age FROM patients GROUP BY gender
""")
def _(t):
    return rounded(ag.subject_overview(t.patients))


@case("a37_readmission_overview", """
SELECT COUNT(*) AS total, CAST(SUM(readmitted_30d) AS BIGINT) AS readmitted_30d,
  CAST(SUM(readmitted_60d) AS BIGINT) AS readmitted_60d FROM readmit_flags
""")
def _(t):
    return ag.readmission_overview(co.readmission_flags(t.admissions))


@case("a37_stay_lengths", """
SELECT COUNT(los) AS n, ROUND(AVG(los), 6) AS mean_days, ROUND(MIN(los), 6) AS min_days,
  ROUND(MAX(los), 6) AS max_days, ROUND(MEDIAN(los), 6) AS median_days FROM icustays
""")
def _(t):
    return rounded(ag.stay_length_overview(t.icustays))


@case("a37_top_codes", """
SELECT di.icd_code, dd.long_title, COUNT(*) AS count FROM diagnoses_icd di
LEFT JOIN d_icd_diagnoses dd ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
GROUP BY 1, 2 ORDER BY count DESC, icd_code LIMIT 10
""")
def _(t):
    return ag.top_codes(t.diagnoses_icd, t.d_icd_diagnoses, 10)


@case("a37_one_subject", """
WITH s AS (SELECT MIN(subject_id) AS subject_id FROM admissions)
SELECT p.subject_id, p.gender, p.anchor_age,
  (SELECT COUNT(*) FROM admissions a WHERE a.subject_id = p.subject_id) AS n_encounters,
  (SELECT COUNT(*) FROM icustays i WHERE i.subject_id = p.subject_id) AS n_stays
FROM patients p JOIN s ON p.subject_id = s.subject_id
""")
def _(t):
    return ag.one_subject(t.patients, t.admissions, t.icustays)


@case("a38_label_variants", """
SELECT d.label, COUNT(*) AS n_rows, ROUND(AVG(l.valuenum), 6) AS mean_value,
  MIN(l.valuenum) AS min_value, MAX(l.valuenum) AS max_value FROM labevents l JOIN d_labitems d
ON l.itemid = d.itemid WHERE LOWER(d.label) LIKE '%creatinine%' AND l.valuenum IS NOT NULL
GROUP BY d.label
""")
def _(t):
    return rounded(cd.label_variants(t.labevents, t.d_labitems, "creatinine"))


@case("a38_items_against_label", """
SELECT (SELECT COUNT(*) FROM labevents l WHERE l.valuenum IS NOT NULL AND l.itemid IN
  (SELECT itemid FROM lab_concepts WHERE loinc = '2160-0')) AS n_items,
  (SELECT ROUND(AVG(valuenum), 6) FROM labevents l WHERE l.itemid IN
  (SELECT itemid FROM lab_concepts WHERE loinc = '2160-0')) AS mean_items,
  (SELECT COUNT(*) FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid
  WHERE d.label ILIKE '%creatinine%' AND l.valuenum IS NOT NULL) AS n_label,
  (SELECT ROUND(AVG(l.valuenum), 6) FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid
  WHERE d.label ILIKE '%creatinine%') AS mean_label
""")
def _(t):
    known = t.labevents.where("valuenum IS NOT NULL")
    by_item = cd.items_for_loinc(t.lab_concepts, "2160-0").withColumn("in_items", F.lit(True))
    by_label = t.d_labitems.where(
        fl.contains_any(F.col("label"), ["creatinine"])
    ).select("itemid").withColumn("in_label", F.lit(True))
    # Both readings of the question in one pass over the events.
    marked = known.join(by_item, "itemid", "left").join(by_label, "itemid", "left")
    value = F.col("valuenum")
    return rounded(marked.agg(
        F.count(F.when(F.col("in_items"), value)).alias("n_items"),
        F.avg(F.when(F.col("in_items"), value)).alias("mean_items"),
        F.count(F.when(F.col("in_label"), value)).alias("n_label"),
        F.avg(F.when(F.col("in_label"), value)).alias("mean_label"),
    ))
