"""Queries over the cohort filters."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.arithmetic import index_column
from caseweave.operators import cohorts, filters as fl, windows
from caseweave.registry.case import case

ALIAS_ROWS = ", ".join(
    f"('{name}', '{alias}')" for name, spec in rules.COHORTS.items() for alias in spec["aliases"]
)


@case("f1_age_above", "SELECT a.hadm_id, a.subject_id FROM admissions a JOIN patients p "
      "ON a.subject_id = p.subject_id WHERE p.anchor_age > 65")
def _(t):
    return fl.by_age(t.admissions, t.patients, ">", 65).select("hadm_id", "subject_id")


@case("f2_gender", "SELECT a.hadm_id FROM admissions a JOIN patients p "
      "ON a.subject_id = p.subject_id WHERE p.gender = 'F'")
def _(t):
    return fl.by_gender(t.admissions, t.patients, "f").select("hadm_id")


@case("f3_diagnosis_text", """
SELECT DISTINCT a.hadm_id FROM admissions a JOIN diagnoses_icd di ON a.hadm_id = di.hadm_id
JOIN d_icd_diagnoses dd ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
WHERE dd.long_title ILIKE '%hemorrhage%' OR di.icd_code LIKE 'hemorrhage%'
""")
def _(t):
    return fl.by_diagnosis(
        t.admissions, t.diagnoses_icd, t.d_icd_diagnoses, "hemorrhage"
    ).select("hadm_id")


@case("f4_code_prefixes", """
SELECT hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM diagnoses_icd
WHERE (icd_version = 10 AND (icd_code LIKE 'A41%' OR icd_code LIKE 'R6521%'))
   OR (icd_version = 9 AND icd_code LIKE '99592%'))
""")
def _(t):
    return fl.by_code_prefixes(
        t.admissions, t.diagnoses_icd, icd10=["A41.", "R65.21"], icd9=["995.92"]
    ).select("hadm_id")


@case("f6_named_cohort", """
SELECT hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM diagnoses_icd
WHERE (icd_version = 10 AND icd_code LIKE 'I50%') OR (icd_version = 9 AND icd_code LIKE '428%'))
""")
def _(t):
    return fl.by_named_cohort(
        t.admissions, t.diagnoses_icd, "Patients with congestive heart failure"
    ).select("hadm_id")


@case("f6_cohort_of_title", f"""
WITH aliases AS (SELECT * FROM (VALUES {ALIAS_ROWS}) AS v(cohort, alias)),
titles AS (SELECT dd.long_title, COUNT(*) AS n FROM diagnoses_icd di JOIN d_icd_diagnoses dd
  ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version GROUP BY dd.long_title),
plain AS (SELECT n, trim(regexp_replace(regexp_replace(lower(long_title),
  '[.,;:!?()\\[\\]{{}}''"`]', '', 'g'), '\\s+', ' ', 'g')) AS phrase FROM titles),
hits AS (SELECT phrase, n, (SELECT max(struct_pack(l := length(alias), c := cohort)).c
  FROM aliases WHERE contains(phrase, alias)) AS cohort FROM plain)
SELECT cohort, CAST(SUM(n) AS BIGINT) AS n_diagnoses FROM hits GROUP BY cohort
""")
def _(t):
    titles = (
        t.diagnoses_icd.join(t.d_icd_diagnoses, ["icd_code", "icd_version"])
        .groupBy("long_title").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        titles.withColumn("cohort", fl.cohort_of_phrase(F.col("long_title")))
        .groupBy("cohort").agg(F.sum("n").alias("n_diagnoses"))
    )


@case("f7_admission_types", "SELECT hadm_id FROM admissions "
      "WHERE admission_type IN ('1-URGENT', '2-HIGH')")
def _(t):
    return fl.by_admission_type(t.admissions, ["1-URGENT", "2-HIGH"]).select("hadm_id")


@case("f7_admission_types_none", "SELECT count(*) AS n FROM admissions WHERE 1 = 0")
def _(t):
    return fl.by_admission_type(t.admissions, []).agg(F.count(F.lit(1)).alias("n"))


@case("f8_subject", "SELECT hadm_id, admittime FROM admissions WHERE subject_id = 37")
def _(t):
    return fl.by_subject(t.admissions, 37).select("hadm_id", "admittime")


@case("f9_readmitted", "SELECT hadm_id FROM readmit_flags WHERE readmitted_30d = 1")
def _(t):
    flags = cohorts.readmission_flags(t.admissions)
    return fl.by_label(t.admissions, flags, "readmitted_30d", "=", 1).select("hadm_id")


@case("f10_lab_threshold", "SELECT DISTINCT hadm_id FROM labevents "
      "WHERE itemid IN (50912) AND valuenum > 45")
def _(t):
    readings = fl.measured(t.labevents, itemids=[50912])
    return fl.by_measurement(t.admissions, readings, ">", 45).select("hadm_id")


@case("f11_label_threshold", """
SELECT hadm_id FROM admissions a WHERE EXISTS (SELECT 1 FROM chartevents c JOIN d_items d
ON c.itemid = d.itemid WHERE c.hadm_id = a.hadm_id AND d.label ILIKE '%blood pressure%'
AND c.valuenum < 50)
""")
def _(t):
    readings = fl.measured(t.chartevents, dictionary=t.d_items, label="blood pressure")
    return fl.by_measurement(t.admissions, readings, "<", 50).select("hadm_id")


@case("f12_score_total", """
WITH totals AS (SELECT stay_id, charttime,
  COALESCE(MAX(CASE WHEN itemid = 220739 THEN valuenum END), 0)
  + COALESCE(MAX(CASE WHEN itemid = 223900 THEN valuenum END), 0)
  + COALESCE(MAX(CASE WHEN itemid = 223901 THEN valuenum END), 0) AS total
  FROM chartevents WHERE itemid IN (220739, 223900, 223901) GROUP BY stay_id, charttime)
SELECT hadm_id FROM admissions a WHERE EXISTS (SELECT 1 FROM totals g JOIN icustays i
  ON i.stay_id = g.stay_id WHERE i.hadm_id = a.hadm_id AND g.total >= 8)
""")
def _(t):
    totals = windows.score_totals(t.chartevents)
    return fl.by_score_total(t.admissions, totals, t.icustays, ">=", 8).select("hadm_id")


EYE = fl.Operand("eye", (220739,), 1.0, 4.0)
MOTOR = fl.Operand("motor", (223901,), 1.0, 6.0)
SHOCK = {"op": "/", "args": [{"op": "*", "args": ["eye", 2]}, "motor"]}


@case("f13_index_per_instant", """
SELECT hadm_id FROM admissions a WHERE EXISTS (SELECT 1 FROM chartevents x JOIN chartevents y
  ON y.stay_id = x.stay_id AND y.charttime = x.charttime
  WHERE x.hadm_id = a.hadm_id AND x.itemid = 220739 AND x.valuenum BETWEEN 1 AND 4
  AND y.itemid = 223901 AND y.valuenum BETWEEN 1 AND 6
  AND (x.valuenum * 2 / NULLIF(y.valuenum, 0)) > 2.5)
""")
def _(t):
    return fl.by_index_per_instant(
        t.admissions, t.chartevents, [EYE, MOTOR], SHOCK, ">", 2.5
    ).select("hadm_id")


@case("f13_index_repeated_operand", """
SELECT hadm_id FROM admissions a WHERE EXISTS (SELECT 1 FROM chartevents x JOIN chartevents y
  ON y.stay_id = x.stay_id AND y.charttime = x.charttime
  WHERE x.hadm_id = a.hadm_id AND x.itemid = 220739 AND x.valuenum BETWEEN 1 AND 4
  AND y.itemid = 223901 AND y.valuenum BETWEEN 1 AND 6
  AND ((x.valuenum - y.valuenum) / NULLIF(x.valuenum, 0)) < -1)
""")
def _(t):
    gap = {"op": "/", "args": [{"op": "-", "args": ["eye", "motor"]}, "eye"]}
    return fl.by_index_per_instant(
        t.admissions, t.chartevents, [EYE, MOTOR], gap, "<", -1
    ).select("hadm_id")


@case("f14_index_per_encounter", """
WITH parts AS (SELECT hadm_id,
  MAX(CASE WHEN itemid = 50912 AND valuenum BETWEEN 1 AND 60 THEN valuenum END) AS cr,
  MIN(CASE WHEN itemid = 51265 AND valuenum BETWEEN 1 AND 60 THEN valuenum END) AS pl
  FROM labevents GROUP BY hadm_id)
SELECT hadm_id FROM parts WHERE cr / NULLIF(pl, 0) >= 1.5
""")
def _(t):
    operands = [
        fl.Operand("cr", (50912,), 1, 60, "max"), fl.Operand("pl", (51265,), 1, 60, "min"),
    ]
    return fl.by_index_per_encounter(
        t.admissions, t.labevents, operands, {"op": "/", "args": ["cr", "pl"]}, ">=", 1.5
    ).select("hadm_id")


@case("f15_expression", """
SELECT hadm_id, labevent_id, ROUND(GREATEST(LN(valuenum), LEAST(ref_range_lower, valuenum / 2))
  + 3 * (valuenum - ref_range_upper) / NULLIF(ref_range_lower, 0), 6) AS score
FROM labevents WHERE valuenum > 0
""")
def _(t):
    node = {"op": "+", "args": [
        {"op": "max", "args": [
            {"op": "ln", "args": ["v"]},
            {"op": "min", "args": ["lo", {"op": "/", "args": ["v", 2]}]},
        ]},
        {"op": "/", "args": [
            {"op": "*", "args": [3, {"op": "-", "args": ["v", "hi"]}]}, "lo",
        ]},
    ]}
    operands = {
        "v": F.col("valuenum"), "lo": F.col("ref_range_lower"), "hi": F.col("ref_range_upper"),
    }
    return t.labevents.where("valuenum > 0").select(
        "hadm_id", "labevent_id", F.round(index_column(node, operands), 6).alias("score")
    )


@case("f16_any_of", """
SELECT hadm_id FROM admissions a WHERE hadm_id IN (SELECT hadm_id FROM icustays
  WHERE stay_id % 2 = 1) OR hadm_id IN (SELECT hadm_id FROM labevents
  WHERE itemid = 50813 AND valuenum > 40)
""")
def _(t):
    lactate = fl.measured(t.labevents, itemids=[50813])
    return fl.any_of(t.admissions, [
        partial(fl.has_stay, stays=t.icustays.where("stay_id % 2 = 1")),
        partial(fl.by_measurement, readings=lactate, operator=">", threshold=40),
    ]).select("hadm_id")


@case("f17_has_stay", "SELECT hadm_id FROM admissions WHERE hadm_id IN "
      "(SELECT hadm_id FROM icustays)")
def _(t):
    return fl.has_stay(t.admissions, t.icustays).select("hadm_id")


@case("f18_drug_group", """
SELECT hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM prescriptions
WHERE drug ILIKE '%kcentra%' OR drug ILIKE '%phytonadione%' OR drug ILIKE '%vitamin k%'
   OR drug ILIKE '%prothrombin%' OR drug ILIKE '%fresh frozen plasma%' OR drug ILIKE '%ffp%')
""")
def _(t):
    return fl.by_drug(t.admissions, t.prescriptions, "Reversal agent").select("hadm_id")


@case("f19_recent_ids", """
SELECT hadm_id FROM (SELECT a.hadm_id, a.admittime FROM admissions a JOIN patients p
  ON a.subject_id = p.subject_id WHERE p.anchor_age > 60 AND p.gender = 'M'
  AND a.admission_type = '1-URGENT' ORDER BY admittime DESC, a.hadm_id LIMIT 100)
""")
def _(t):
    return fl.select_ids(t.admissions, [
        partial(fl.by_age, subjects=t.patients, operator=">", years=60),
        partial(fl.by_gender, subjects=t.patients, gender="M"),
        partial(fl.by_admission_type, values="1-URGENT"),
    ], order="recent", cap=100)


@case("f19_random_ids", """
SELECT hadm_id FROM admissions WHERE admission_type = '5-LOW'
ORDER BY md5(concat_ws('-', '7', CAST(hadm_id AS VARCHAR)))[1:13], hadm_id LIMIT 50
""")
def _(t):
    return fl.select_ids(
        t.admissions, [partial(fl.by_admission_type, values="5-LOW")], "random", 50, seed=7
    )


WINDOWS = {
    "during": "l.charttime >= w.intime AND l.charttime <= w.outtime",
    "within": "l.charttime >= w.intime AND l.charttime <= w.intime + INTERVAL 48 HOUR",
    "before": "l.charttime < w.intime",
    "after": "l.charttime > w.outtime",
}


def _window_case(relation, condition):
    @case(f"f20_{relation}_stay", f"""
SELECT labevent_id, hadm_id, charttime FROM labevents l
WHERE EXISTS (SELECT 1 FROM icustays w WHERE w.hadm_id = l.hadm_id AND {condition})
""")
    def _(t):
        return fl.in_window(
            t.labevents, t.icustays, relation, hours=48 if relation == "within" else None
        ).select("labevent_id", "hadm_id", "charttime")


for _relation, _condition in WINDOWS.items():
    _window_case(_relation, _condition)


@case("f20_during_admission", """
SELECT labevent_id, hadm_id FROM labevents l WHERE EXISTS (SELECT 1 FROM admissions w
  WHERE w.hadm_id = l.hadm_id AND l.charttime >= w.admittime AND l.charttime <= w.dischtime)
""")
def _(t):
    return fl.in_window(
        t.labevents, t.admissions, "during", start="admittime", end="dischtime"
    ).select("labevent_id", "hadm_id")


@case("f21_fluid", """
SELECT l.labevent_id, l.valuenum FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid
WHERE d.fluid ILIKE '%blood%' AND d.label ILIKE '%creatinine%' AND l.valuenum IS NOT NULL
""")
def _(t):
    readings = fl.measured(t.labevents, dictionary=t.d_labitems, label="creatinine")
    return fl.with_fluid(readings, t.d_labitems, ["blood"]).select("labevent_id", "valuenum")


@case("f22_culture_status", """
SELECT 'positive' AS status, COUNT(DISTINCT hadm_id) AS n FROM microbiologyevents
WHERE org_name IS NOT NULL
UNION ALL SELECT 'negative', COUNT(DISTINCT hadm_id) FROM microbiologyevents WHERE org_name IS NULL
""")
def _(t):
    parts = [
        fl.with_culture_status(t.microbiologyevents, s)
        .agg(F.count_distinct("hadm_id").alias("n"))
        .select(F.lit(s).alias("status"), "n")
        for s in ("positive", "negative")
    ]
    return parts[0].unionByName(parts[1])


def lab_limits(t):
    """Possible ranges per laboratory item, derived from the dictionary."""
    return t.d_labitems.select(
        "itemid",
        F.when(F.col("itemid") == 50912, 5.0).otherwise(2.0).alias("low"),
        F.when(F.col("itemid") == 50912, 45.0).otherwise(48.0).alias("high"),
        F.lit("mg/dL").alias("unit"),
    )


SCREEN_SQL = """
SELECT l.*, CASE WHEN l.valuenum IS NULL THEN true ELSE
  (l.valuenum BETWEEN CASE WHEN l.itemid = 50912 THEN 5 ELSE 2 END
    AND CASE WHEN l.itemid = 50912 THEN 45 ELSE 48 END)
  OR NOT (l.valueuom IS NULL OR LOWER(TRIM(l.valueuom)) = 'mg/dl') END AS clean FROM labevents l
"""


@case("f23_screen", f"""
SELECT itemid, clean, COUNT(*) AS n, ROUND(SUM(valuenum), 4) AS total
FROM ({SCREEN_SQL}) GROUP BY itemid, clean
""")
def _(t):
    return fl.screen(t.labevents, lab_limits(t)).groupBy("itemid", "clean").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("valuenum"), 4).alias("total")
    )


@case("f24_removed_rows", f"""
SELECT valuenum, subject_id, hadm_id, charttime, valueuom FROM ({SCREEN_SQL})
WHERE NOT clean ORDER BY valuenum DESC, labevent_id LIMIT 20
""")
def _(t):
    screened = fl.screen(t.labevents, lab_limits(t))
    return fl.removed_rows(screened, 20, ["labevent_id"]).select(
        "valuenum", "subject_id", "hadm_id", "charttime", "valueuom"
    )


@case("f25_eligible_stays", """
SELECT s.hadm_id, s.stay_id FROM first_stay s JOIN age g ON s.hadm_id = g.hadm_id
WHERE DATE_DIFF('hour', s.intime, s.outtime) > 24 AND DATE_DIFF('hour', s.intime, s.outtime) < 2400
  AND g.age BETWEEN 18 AND 89
""")
def _(t):
    return fl.eligible_stays(t.icustays, cohorts.ages(t.patients, t.admissions)).select(
        "hadm_id", "stay_id"
    )


@case("f26_search_items", """
WITH ranked AS (
  SELECT itemid, label, fluid, category, 'labevents' AS source_table,
    CASE WHEN LOWER(label) = 'creatinine' THEN 0 WHEN LOWER(label) LIKE 'creatinine%' THEN 1
      ELSE 2 END AS match_rank FROM d_labitems WHERE LOWER(label) LIKE '%creatinine%'
  UNION ALL SELECT itemid, label, NULL, category, 'chartevents', CASE
    WHEN LOWER(label) = 'creatinine' THEN 0 WHEN LOWER(label) LIKE 'creatinine%' THEN 1 ELSE 2 END
  FROM d_items WHERE LOWER(label) LIKE '%creatinine%'),
used AS (SELECT itemid, COUNT(*) AS n_events FROM labevents GROUP BY itemid)
SELECT r.itemid, r.label, r.fluid, r.category, r.source_table, r.match_rank,
  COALESCE(u.n_events, 0) AS n_events
FROM ranked r LEFT JOIN used u ON r.itemid = u.itemid
ORDER BY match_rank, length(label), label LIMIT 10
""")
def _(t):
    found = fl.search_items(t.d_labitems, t.d_items, "Creatinine", 10)
    used = t.labevents.groupBy("itemid").agg(F.count(F.lit(1)).alias("n_events"))
    return found.join(used, "itemid", "left").fillna(0, ["n_events"])
