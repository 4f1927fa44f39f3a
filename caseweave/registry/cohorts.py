"""Queries over cohorts, labels, arms, covariates, outcomes and cohort events (C)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from caseweave.operators import cohorts as co, filters as fl, joins as jn, windows as wn
from caseweave.registry.case import case

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@case("c1_age", "SELECT subject_id, hadm_id, CAST(age AS INT) AS age FROM age")
def _(t):
    return co.ages(t.patients, t.admissions).withColumn("age", F.col("age").cast("int"))


C2_SQL = """
SELECT s.subject_id, s.hadm_id, s.stay_id FROM first_stay s JOIN age g ON s.hadm_id = g.hadm_id
WHERE DATE_DIFF('hour', s.intime, s.outtime) > 24 AND DATE_DIFF('hour', s.intime, s.outtime) < 2400
  AND g.age BETWEEN 18 AND 89 AND s.hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE {seq}
  ((icd_version = 10 AND (icd_code LIKE 'I63%' OR icd_code LIKE 'I61%' OR icd_code LIKE 'I60%'))
  OR (icd_version = 9 AND (icd_code LIKE '433_1' OR icd_code LIKE '434_1' OR icd_code LIKE '436'
    OR icd_code LIKE '430' OR icd_code LIKE '431'))))
"""


@case("c2_diagnosis_cohort", C2_SQL.format(seq="seq_num = 1 AND"))
def _(t):
    return co.diagnosis_cohort(
        t.icustays, co.ages(t.patients, t.admissions), t.diagnoses_icd, ["I63", "I61", "I60"]
    )


@case("c2_diagnosis_cohort_any", C2_SQL.format(seq=""))
def _(t):
    return co.diagnosis_cohort(
        t.icustays, co.ages(t.patients, t.admissions), t.diagnoses_icd, ["I63", "I61", "I60"],
        principal_only=False,
    )


@case("c3_readmission_labels", "SELECT * FROM readmit_labels")
def _(t):
    return co.readmission_labels(t.admissions)


@case("c4_readmission_flags", "SELECT * FROM readmit_flags")
def _(t):
    return co.readmission_flags(t.admissions)


# The three parts of the score as minima of one long table, one row per stay and part.
HEAD_SQL = """
WITH part(itemid, place) AS (VALUES (220739, 1), (223900, 2), (223901, 3)),
lowest AS (
  SELECT stay_id, place, MIN(valuenum) AS v FROM first_stay JOIN chartevents USING (stay_id)
    JOIN part USING (itemid)
  WHERE DATE_DIFF('second', intime, charttime) BETWEEN 0 AND 86400 GROUP BY ALL),
score AS (
  SELECT stay_id, SUM(v) AS gcs_total, MAX(v) FILTER (place = 1) AS gcs_eye,
    MAX(v) FILTER (place = 2) AS gcs_verbal, MAX(v) FILTER (place = 3) AS gcs_motor
  FROM lowest GROUP BY stay_id HAVING SUM(v) > 0 AND SUM(v) < 9),
injured AS (
  SELECT DISTINCT hadm_id FROM diagnoses_icd WHERE icd_version = 10 AND starts_with(icd_code, 'S06')),
unit(first_careunit) AS (VALUES ('Neuro Stepdown'), ('Trauma SICU (TSICU)'),
  ('Neuro Surgical Intensive Care Unit (Neuro SICU)'))
SELECT f.subject_id, hadm_id, stay_id, f.intime, f.outtime, first_careunit,
  gcs_total, gcs_eye, gcs_verbal, gcs_motor
FROM score JOIN first_stay f USING (stay_id) JOIN unit USING (first_careunit)
  JOIN injured USING (hadm_id) JOIN age USING (hadm_id)
WHERE age >= 18 AND age < 90 AND DATE_DIFF('hour', f.intime, f.outtime) > 24
"""


def head_cohort(t):
    return co.head_injury_cohort(
        t.icustays, co.ages(t.patients, t.admissions), t.diagnoses_icd, t.chartevents
    )


@case("c5_head_injury_cohort", HEAD_SQL)
def _(t):
    return head_cohort(t)


# The outcome is looked up: class of the first status and death flag give a name.
STATUS_SQL = """
WITH class(code_status_value, class) AS (VALUES ('Comfort measures only', 'comfort'), ('CMO', 'comfort'),
  ('DNR', 'limited'), ('DNI', 'limited'), ('DNR / DNI', 'limited')),
named(class, died, name) AS (VALUES ('comfort', 1, 'CMO_death'), ('limited', 1, 'DNR_death'),
  ('comfort', 0, 'limited_code_survived'), ('limited', 0, 'limited_code_survived'),
  ('unlisted', 0, 'limited_code_survived'), ('none', 1, 'full_code_death'), ('none', 0, 'full_code_survived')),
change AS (
  SELECT stay_id, MIN({'t': charttime, 'v': value}) AS c FROM chartevents
  WHERE itemid = 223758 AND LOWER(value) <> 'full code' GROUP BY stay_id),
stay AS (
  SELECT f.subject_id, f.hadm_id, f.stay_id, f.intime, c.t AS code_status_time, c.v AS code_status_value,
    a.hospital_expire_flag, a.discharge_location
  FROM first_stay f LEFT JOIN change USING (stay_id) LEFT JOIN admissions a ON a.hadm_id = f.hadm_id)
SELECT s.subject_id, s.hadm_id, s.stay_id, s.code_status_time, s.code_status_value,
  DATE_DIFF('hour', s.intime, s.code_status_time) AS hours_to_code_change,
  s.hospital_expire_flag, s.discharge_location,
  CAST(s.code_status_value IS NOT NULL OR COALESCE(s.discharge_location = 'HOSPICE', FALSE) AS INT) AS wlst_label,
  COALESCE(n.name, IF(s.discharge_location = 'HOSPICE', 'hospice', 'other')) AS outcome_category
FROM stay s LEFT JOIN class k USING (code_status_value) LEFT JOIN named n
  ON n.died = s.hospital_expire_flag
  AND n.class = COALESCE(k.class, IF(s.code_status_value IS NULL, 'none', 'unlisted'))
"""


def status_labels(t):
    return co.status_change_labels(
        fl.first_stays(t.icustays).select("subject_id", "hadm_id", "stay_id", "intime"),
        t.chartevents, t.admissions,
    )


@case("c6_status_labels", STATUS_SQL)
def _(t):
    return status_labels(t).select(
        "subject_id", "hadm_id", "stay_id", "code_status_time", "code_status_value",
        "hours_to_code_change", "hospital_expire_flag", "discharge_location", "wlst_label",
        "outcome_category",
    )


def arms(t):
    return [
        co.drug_name_arm("norepinephrine", t.prescriptions, ["Norepinephrine"]),
        co.drug_name_arm("heparin", t.prescriptions, ["heparin"]),
        co.procedure_arm("ventilated", t.procedures_icd, "5A19.45"),
    ]


ARMS_SQL = """
WITH m AS (SELECT DISTINCT hadm_id, 0 AS arm FROM prescriptions WHERE LOWER(drug) = 'norepinephrine'
  UNION ALL SELECT DISTINCT hadm_id, 1 FROM prescriptions WHERE LOWER(drug) = 'heparin'
  UNION ALL SELECT DISTINCT hadm_id, 2 FROM procedures_icd WHERE icd_version = 10
    AND icd_code LIKE '5A1945%'),
n AS (SELECT a.subject_id, a.hadm_id, CAST(COUNT(m.arm) AS INT) AS n_matching, MIN(m.arm) AS arm
  FROM admissions a LEFT JOIN m ON a.hadm_id = m.hadm_id GROUP BY a.subject_id, a.hadm_id)
"""


@case("c7_assigned_arms", ARMS_SQL + """
SELECT subject_id, hadm_id, CASE WHEN n_matching = 1 THEN arm END AS T,
  CASE WHEN n_matching = 1 THEN CASE arm WHEN 0 THEN 'norepinephrine' WHEN 1 THEN 'heparin'
    ELSE 'ventilated' END END AS intervention_label, n_matching FROM n
""")
def _(t):
    return co.assign_arms(t.admissions, arms(t))


@case("c7_arm_counts", ARMS_SQL + """
SELECT COUNT(*) AS n_cohort, COUNT(*) FILTER (n_matching = 1) AS n_assigned,
  COUNT(*) FILTER (n_matching = 0) AS n_unassigned,
  COUNT(*) FILTER (n_matching >= 2) AS n_overlapping FROM n
""")
def _(t):
    return co.arm_counts(co.assign_arms(t.admissions, arms(t)))


@case("c7_control_arm", """
SELECT subject_id, hadm_id, CASE WHEN hadm_id IN (SELECT hadm_id FROM prescriptions
  WHERE LOWER(drug) = 'heparin') THEN 0 ELSE 1 END AS T FROM admissions
""")
def _(t):
    heparin = co.drug_name_arm("heparin", t.prescriptions, ["heparin"])
    both = [heparin, co.Arm("no heparin", heparin.matches, control=True)]
    return co.assign_arms(t.admissions, both).select("subject_id", "hadm_id", "T")


@case("c8_drug_concept_arm", """
SELECT DISTINCT hadm_id FROM prescriptions WHERE LOWER(drug) IN ('norepinephrine')
""")
def _(t):
    return co.drug_arm(
        "vasopressor", t.prescriptions, t.drug_concepts, t.concept_edges, "372882007"
    ).matches.distinct()


@case("c9_procedure_arm", """
SELECT DISTINCT hadm_id FROM procedures_icd WHERE icd_version = 10 AND icd_code LIKE '5A19%'
""")
def _(t):
    return co.procedure_arm("ventilation", t.procedures_icd, "5a1.9").matches.distinct()


@case("c10_lab_arm", """
SELECT DISTINCT hadm_id FROM labevents WHERE itemid IN (SELECT itemid FROM lab_concepts
WHERE concept_id IN (SELECT concept_id FROM lab_concepts WHERE loinc = '2161-8'))
""")
def _(t):
    return co.lab_arm("creatinine", t.labevents, t.lab_concepts, "2161-8").matches.distinct()


COVARIATES_SQL = """
SELECT a.hadm_id, p.anchor_age AS age, CASE WHEN p.gender = 'M' THEN 1 ELSE 0 END AS gender_M,
  CASE WHEN p.gender = 'F' THEN 1 ELSE 0 END AS gender_F,
  CASE WHEN p.gender IN ('M', 'F') THEN 0 ELSE 1 END AS gender_unknown
"""
TYPES_SQL = """,
  CASE WHEN a.admission_type = '1-URGENT' THEN 1 ELSE 0 END AS "admission_type_1-URGENT",
  CASE WHEN a.admission_type = '2-HIGH' THEN 1 ELSE 0 END AS "admission_type_2-HIGH",
  CASE WHEN a.admission_type = '3-MEDIUM' THEN 1 ELSE 0 END AS "admission_type_3-MEDIUM",
  CASE WHEN a.admission_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 0 ELSE 1 END
    AS admission_type_other,
  ROUND(DATE_DIFF('second', a.admittime, a.dischtime) / 86400.0, 8) AS hospital_los_days
"""
FROM_SQL = " FROM admissions a JOIN patients p ON a.subject_id = p.subject_id"


@case("c11_demographics", COVARIATES_SQL + FROM_SQL)
def _(t):
    return co.covariates(t.admissions, t.patients)


@case("c11_demographics_admission", COVARIATES_SQL + TYPES_SQL + FROM_SQL)
def _(t):
    return co.covariates(t.admissions, t.patients, TYPES).withColumn(
        "hospital_los_days", F.round("hospital_los_days", 8)
    )


@case("c12_readmitted_outcome", """
SELECT hadm_id, CASE WHEN next_admittime IS NOT NULL
  AND (next_admittime - dischtime) <= INTERVAL 60 DAY THEN 1 ELSE 0 END AS value FROM next_admit
""")
def _(t):
    return co.outcome_readmitted(t.admissions, 60)


@case("c13_died", "SELECT hadm_id, COALESCE(hospital_expire_flag, 0) AS value FROM admissions")
def _(t):
    return co.outcome_died(t.admissions)


SURVIVAL_SQL = """
WITH d AS (SELECT a.hadm_id, DATE_DIFF('second', {clock}, CAST(p.dod AS TIMESTAMP)) / 86400.0
  AS days FROM admissions a JOIN patients p ON a.subject_id = p.subject_id {extra})
SELECT hadm_id, CASE WHEN days BETWEEN 0 AND 365 THEN 1 ELSE 0 END AS event,
  ROUND(CASE WHEN days BETWEEN 0 AND 365 THEN days ELSE 365.0 END, 8) AS time FROM d
"""


def _survival_case(clock, column, extra=""):
    @case(f"c14_survival_{clock}", SURVIVAL_SQL.format(clock=column, extra=extra))
    def _(t):
        return co.outcome_survival(
            t.admissions, t.patients, 365, clock, t.icustays
        ).withColumn("time", F.round("time", 8))


_survival_case("admission", "a.admittime")
_survival_case("discharge", "a.dischtime")
_survival_case(
    "icu_out", "i.t0",
    "LEFT JOIN (SELECT hadm_id, MAX(outtime) AS t0 FROM icustays GROUP BY 1) i "
    "ON a.hadm_id = i.hadm_id",
)


@case("c15_icu_days", """
SELECT a.hadm_id, ROUND(COALESCE(SUM(i.los), 0.0), 8) AS value FROM admissions a
LEFT JOIN icustays i ON a.hadm_id = i.hadm_id GROUP BY a.hadm_id
""")
def _(t):
    return co.outcome_icu_days(t.admissions, t.icustays).withColumn("value", F.round("value", 8))


@case("c15_hospital_days", """
SELECT hadm_id, ROUND(DATE_DIFF('second', admittime, dischtime) / 86400.0, 8) AS value
FROM admissions
""")
def _(t):
    return co.outcome_hospital_days(t.admissions).withColumn("value", F.round("value", 8))


def _biomarker_case(how, sql):
    @case(f"c16_biomarker_{how}", f"""
SELECT a.hadm_id, ROUND((SELECT {sql}(l.valuenum) FROM labevents l JOIN d_labitems d
  ON l.itemid = d.itemid WHERE l.hadm_id = a.hadm_id AND LOWER(d.label) LIKE '%creatinine%'), 8)
  AS value FROM admissions a
""")
    def _(t):
        return co.outcome_biomarker(
            t.admissions, t.labevents, t.d_labitems, "creatinine", how
        ).withColumn("value", F.round("value", 8))


for _how, _sql in (("max", "MAX"), ("min", "MIN"), ("avg", "AVG")):
    _biomarker_case(_how, _sql)


@case("c17_diagnosis_index", """
SELECT hadm_id, CASE WHEN hadm_id IN (SELECT hadm_id FROM diagnoses_icd WHERE icd_version = 10
  AND icd_code LIKE 'I50%') THEN 1 ELSE 0 END AS value FROM admissions
""")
def _(t):
    return co.outcome_diagnosis(t.admissions, t.diagnoses_icd, ["i50"], 0)


@case("c17_diagnosis_later", """
WITH hit AS (SELECT DISTINCT hadm_id FROM diagnoses_icd WHERE icd_version = 10
  AND (icd_code LIKE 'I50%' OR icd_code LIKE 'N17%')),
later AS (SELECT DISTINCT x.hadm_id FROM admissions x JOIN admissions y
  ON x.subject_id = y.subject_id AND y.admittime > x.dischtime
  AND y.admittime - x.dischtime <= INTERVAL 180 DAY JOIN hit ON hit.hadm_id = y.hadm_id)
SELECT a.hadm_id, CASE WHEN l.hadm_id IS NULL THEN 0 ELSE 1 END AS value
FROM admissions a LEFT JOIN later l ON a.hadm_id = l.hadm_id
""")
def _(t):
    return co.outcome_diagnosis(t.admissions, t.diagnoses_icd, ["I50", "N17"], 180)


def frame(t):
    adults = fl.by_age(t.admissions, t.patients, ">=", 40)
    return co.cohort_frame(
        adults, arms(t), co.covariates(t.admissions, t.patients),
        {
            "died": co.outcome_died(t.admissions),
            "peak": co.outcome_biomarker(t.admissions, t.labevents, t.d_labitems, "creatinine"),
            "survival": co.outcome_survival(t.admissions, t.patients, 365),
        },
    )


@case("c18_cohort_frame", ARMS_SQL + """
SELECT n.subject_id, n.hadm_id, n.arm AS T, p.anchor_age AS age, p.gender,
  COALESCE(a.hospital_expire_flag, 0) AS died,
  (SELECT MAX(l.valuenum) FROM labevents l WHERE l.hadm_id = n.hadm_id
    AND l.itemid IN (50912, 51082)) AS peak,
  CASE WHEN DATE_DIFF('second', a.admittime, CAST(p.dod AS TIMESTAMP)) / 86400.0
    BETWEEN 0 AND 365 THEN 1 ELSE 0 END AS survival_event
FROM n JOIN admissions a ON n.hadm_id = a.hadm_id JOIN patients p ON p.subject_id = n.subject_id
WHERE n.n_matching = 1 AND p.anchor_age >= 40
""")
def _(t):
    gender = (
        F.when(F.col("gender_M") == 1, "M").when(F.col("gender_F") == 1, "F").otherwise("U")
    )
    return frame(t).select(
        "subject_id", "hadm_id", "T", "age", gender.alias("gender"), "died", "peak",
        "survival_event",
    )


@case("c18_cohort_drops", ARMS_SQL + """
SELECT COUNT(*) AS n_requested, COUNT(*) FILTER (n.n_matching = 0) AS n_unassigned,
  COUNT(*) FILTER (n.n_matching > 1) AS n_overlapping,
  COUNT(*) FILTER (n.n_matching = 1 AND a.language IS NULL) AS n_missing_covariates,
  COUNT(*) FILTER (n.n_matching = 1 AND a.language IS NOT NULL) AS n_final
FROM n JOIN admissions a ON n.hadm_id = a.hadm_id
""")
def _(t):
    return co.cohort_drops(t.admissions, arms(t), t.admissions.select("hadm_id", "language"))


def urgent(t):
    return fl.by_admission_type(t.admissions, "1-URGENT")


@case("c19_lab_events", """
SELECT l.labevent_id, l.hadm_id, l.charttime, d.label, d.fluid, l.valuenum, l.valueuom
FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid JOIN admissions a
ON l.hadm_id = a.hadm_id WHERE a.admission_type = '1-URGENT' AND d.label ILIKE '%sodium%'
AND d.fluid ILIKE '%blood%' AND l.valuenum IS NOT NULL AND EXISTS (SELECT 1 FROM icustays w
  WHERE w.hadm_id = l.hadm_id AND l.charttime >= w.intime AND l.charttime <= w.outtime)
""")
def _(t):
    inside = partial(fl.in_window, anchors=t.icustays, relation="during")
    return co.lab_rows(
        t.labevents, t.d_labitems, "sodium", urgent(t), ["Blood"], inside
    ).select("labevent_id", "hadm_id", "charttime", "label", "fluid", "valuenum", "valueuom")


@case("c19_vital_events", """
SELECT c.stay_id, c.hadm_id, c.charttime, d.label, c.valuenum FROM chartevents c
JOIN d_items d ON c.itemid = d.itemid JOIN admissions a ON c.hadm_id = a.hadm_id
WHERE a.admission_type = '1-URGENT' AND d.label ILIKE '%mean%' AND c.valuenum IS NOT NULL
""")
def _(t):
    return co.vital_rows(t.chartevents, t.d_items, "mean", urgent(t)).select(
        "stay_id", "hadm_id", "charttime", "label", "valuenum"
    )


@case("c19_drug_events", """
SELECT pr.hadm_id, pr.drug, pr.starttime, pr.stoptime, pr.dose_val_rx FROM prescriptions pr
JOIN admissions a ON pr.hadm_id = a.hadm_id WHERE a.admission_type = '1-URGENT'
AND pr.drug ILIKE '%vanco%' AND EXISTS (SELECT 1 FROM icustays w WHERE w.hadm_id = pr.hadm_id
  AND pr.starttime >= w.intime AND pr.starttime <= w.intime + INTERVAL 48 HOUR)
""")
def _(t):
    early = partial(
        fl.in_window, anchors=t.icustays, relation="within", time="starttime", hours=48
    )
    return co.drug_rows(t.prescriptions, "vanco", urgent(t), early).select(
        "hadm_id", "drug", "starttime", "stoptime", "dose_val_rx"
    )


@case("c19_diagnosis_events", """
SELECT di.hadm_id, di.seq_num, di.icd_code, dd.long_title FROM diagnoses_icd di
LEFT JOIN d_icd_diagnoses dd ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
JOIN admissions a ON di.hadm_id = a.hadm_id WHERE a.admission_type = '1-URGENT'
AND (dd.long_title ILIKE '%sepsis%' OR di.icd_code LIKE 'sepsis%')
""")
def _(t):
    return co.diagnosis_rows(t.diagnoses_icd, t.d_icd_diagnoses, "sepsis", urgent(t)).select(
        "hadm_id", "seq_num", "icd_code", "long_title"
    )


@case("c19_culture_events", """
SELECT m.microevent_id, m.hadm_id, m.charttime, m.spec_type_desc, m.org_name
FROM microbiologyevents m JOIN admissions a ON m.hadm_id = a.hadm_id
WHERE a.admission_type = '1-URGENT' AND (m.spec_type_desc ILIKE '%blood%' OR m.org_name ILIKE '%blood%')
""")
def _(t):
    return co.culture_rows(t.microbiologyevents, "blood", urgent(t)).select(
        "microevent_id", "hadm_id", "charttime", "spec_type_desc", "org_name"
    )


@case("c20_subjects", """
SELECT DISTINCT p.subject_id, p.gender, p.anchor_age FROM patients p JOIN admissions a
ON p.subject_id = a.subject_id WHERE a.admission_type = '1-URGENT'
""")
def _(t):
    return co.subject_rows(t.patients, urgent(t))


@case("c20_encounters", """
SELECT a.hadm_id, a.subject_id, a.admittime, a.dischtime, a.admission_type, a.discharge_location,
  a.hospital_expire_flag, COALESCE(r.readmitted_30d, 0) AS readmitted_30d,
  COALESCE(r.readmitted_60d, 0) AS readmitted_60d
FROM admissions a LEFT JOIN readmit_flags r ON a.hadm_id = r.hadm_id
WHERE a.admission_type = '1-URGENT'
""")
def _(t):
    return co.encounter_rows(urgent(t), t.admissions)


@case("c20_stays", """
SELECT i.stay_id, i.hadm_id, i.subject_id, i.intime, i.outtime, i.los FROM icustays i
JOIN admissions a ON i.hadm_id = a.hadm_id WHERE a.admission_type = '1-URGENT'
""")
def _(t):
    return co.stay_rows(t.icustays, urgent(t))
