"""Queries over windows, sorts, limits and unions (W, L, U) and join shapes (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.operators import cohorts, filters as fl, joins as jn, windows as wn
from caseweave.operators.aggregates import event_aggregate
from caseweave.registry.case import case

TOTALS_SQL = """
SELECT stay_id, charttime, MAX(CASE WHEN itemid = 220739 THEN valuenum END) AS eye,
  MAX(CASE WHEN itemid = 223900 THEN valuenum END) AS verbal,
  MAX(CASE WHEN itemid = 223901 THEN valuenum END) AS motor,
  COALESCE(MAX(CASE WHEN itemid = 220739 THEN valuenum END), 0)
  + COALESCE(MAX(CASE WHEN itemid = 223900 THEN valuenum END), 0)
  + COALESCE(MAX(CASE WHEN itemid = 223901 THEN valuenum END), 0) AS total
FROM chartevents WHERE itemid IN (220739, 223900, 223901) GROUP BY stay_id, charttime
"""


@case("w1_first_stays", "SELECT hadm_id, stay_id, intime, outtime FROM first_stay")
def _(t):
    return wn.first_stays(t.icustays).select("hadm_id", "stay_id", "intime", "outtime")


@case("w2_first_and_last", """
SELECT hadm_id, itemid, arg_min(valuenum, (charttime, labevent_id, valuenum)) AS valuenum_first,
  arg_max(valuenum, (charttime, labevent_id, valuenum)) AS valuenum_last
FROM labevents WHERE valuenum IS NOT NULL GROUP BY hadm_id, itemid
""")
def _(t):
    return wn.first_and_last(
        t.labevents.where("valuenum IS NOT NULL"), ["hadm_id", "itemid"],
        ["charttime", "labevent_id", "valuenum"], ["valuenum"],
    )


@case("w3_next_admission", """
SELECT hadm_id, next_admittime, LEAD(hadm_id) OVER (PARTITION BY subject_id
  ORDER BY admittime, hadm_id) AS next_hadm_id FROM next_admit
""")
def _(t):
    return wn.next_row(
        t.admissions, ["subject_id"], ["admittime", "hadm_id"],
        {"next_admittime": "admittime", "next_hadm_id": "hadm_id"},
    ).select("hadm_id", "next_admittime", "next_hadm_id")


@case("w4_score_drops", f"""
SELECT stay_id, charttime, change FROM (SELECT stay_id, charttime, total - LAG(total) OVER (
  PARTITION BY stay_id ORDER BY charttime) AS change FROM ({TOTALS_SQL})) WHERE change <= -2
""")
def _(t):
    return wn.score_drops(wn.score_totals(t.chartevents))


@case("w5_motor_ends", f"""
SELECT DISTINCT stay_id, FIRST_VALUE(motor) OVER w AS motor_first,
  LAST_VALUE(motor) OVER w AS motor_last, FIRST_VALUE(total) OVER w AS total_first,
  LAST_VALUE(total) OVER w AS total_last
FROM ({TOTALS_SQL}) WINDOW w AS (PARTITION BY stay_id ORDER BY charttime
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def _(t):
    return wn.first_and_last(
        wn.score_totals(t.chartevents), ["stay_id"], ["charttime"], ["motor", "total"]
    )


@case("w6_shares", """
SELECT admission_type, discharge_location, COUNT(*) AS count,
  ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY admission_type), 8) AS fraction
FROM admissions GROUP BY admission_type, discharge_location
""")
def _(t):
    counts = t.admissions.groupBy("admission_type", "discharge_location").agg(
        F.count(F.lit(1)).alias("count")
    )
    return wn.with_share(counts, within=["admission_type"]).withColumn(
        "fraction", F.round("fraction", 8)
    )


@case("w7_first_service", """
SELECT DISTINCT ON (hadm_id) hadm_id, transfertime, curr_service FROM services
ORDER BY hadm_id, transfertime, service_no, curr_service
""")
def _(t):
    return wn.distinct_on(
        t.services, ["hadm_id"], ["transfertime", "service_no", "curr_service"]
    ).select("hadm_id", "transfertime", "curr_service")


@case("w8_score_totals", TOTALS_SQL)
def _(t):
    return wn.score_totals(t.chartevents)


@case("w9_binned_means", """
WITH binned AS (SELECT c.stay_id, LEAST(DATE_DIFF('hour', i.intime, c.charttime) // 12, 3) AS b,
  c.valuenum AS v FROM chartevents c JOIN icustays i ON c.stay_id = i.stay_id
  WHERE c.itemid = 223901 AND c.valuenum IS NOT NULL
  AND c.charttime BETWEEN i.intime AND i.intime + INTERVAL 48 HOUR)
SELECT stay_id, ROUND(AVG(CASE WHEN b = 0 THEN v END), 6) AS gcs_motor_0_12h,
  ROUND(AVG(CASE WHEN b = 1 THEN v END), 6) AS gcs_motor_12_24h,
  ROUND(AVG(CASE WHEN b = 2 THEN v END), 6) AS gcs_motor_24_36h,
  ROUND(AVG(CASE WHEN b = 3 THEN v END), 6) AS gcs_motor_36_48h
FROM binned GROUP BY stay_id
""")
def _(t):
    wide = wn.binned_means(t.chartevents, t.icustays, rules.SCORE_MOTOR, "gcs_motor")
    return wide.select("stay_id", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


@case("w10_followed_by", """
SELECT hadm_id, next_hadm_id FROM (SELECT hadm_id, LEAD(hadm_id) OVER (PARTITION BY subject_id
  ORDER BY admittime, hadm_id) AS next_hadm_id FROM admissions) WHERE next_hadm_id IS NOT NULL
""")
def _(t):
    return wn.followed_by(t.admissions).select("hadm_id", "next_hadm_id")


@case("w11_top_per_group", """
SELECT subject_id, hadm_id, admittime FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id
  ORDER BY admittime DESC, hadm_id) AS rn FROM admissions) WHERE rn <= 3
""")
def _(t):
    return wn.top_per_group(
        t.admissions, ["subject_id"], [F.col("admittime").desc(), "hadm_id"], 3
    ).select("subject_id", "hadm_id", "admittime")


@case("l1_ordered_events", """
SELECT labevent_id, hadm_id, charttime, valuenum FROM labevents WHERE itemid = 50813
  AND valuenum IS NOT NULL ORDER BY charttime
""")
def _(t):
    return fl.measured(t.labevents, itemids=[50813]).select(
        "labevent_id", "hadm_id", "charttime", "valuenum"
    ).orderBy("charttime")


@case("l2_limited_cohort", """
SELECT subject_id, hadm_id FROM admissions ORDER BY subject_id, hadm_id LIMIT 40
""")
def _(t):
    return t.admissions.select("subject_id", "hadm_id").orderBy("subject_id", "hadm_id").limit(40)


@case("l3_top_scored", """
SELECT hadm_id, peak FROM (SELECT hadm_id, MAX(valuenum) AS peak FROM labevents GROUP BY hadm_id)
WHERE peak >= 40 ORDER BY peak DESC, hadm_id LIMIT 25
""")
def _(t):
    peaks = t.labevents.groupBy("hadm_id").agg(F.max("valuenum").alias("peak"))
    return wn.top_scored(peaks, "peak", 25, 40)


@case("l4_nearest_per_group", """
SELECT itemid, hadm_id, valuenum FROM (SELECT itemid, hadm_id, valuenum, labevent_id,
  ROW_NUMBER() OVER (PARTITION BY itemid ORDER BY ABS(valuenum - 25) NULLS LAST, labevent_id,
  hadm_id, valuenum) AS rn
  FROM labevents) WHERE rn <= 5
""")
def _(t):
    near = F.abs(F.col("valuenum") - 25).asc_nulls_last()
    return wn.top_per_group(
        t.labevents, ["itemid"], [near, "labevent_id", "hadm_id", "valuenum"], 5
    ).select("itemid", "hadm_id", "valuenum")


@case("l5_hashed_sample", """
SELECT hadm_id FROM admissions
ORDER BY md5(concat_ws('-', '11', CAST(hadm_id AS VARCHAR)))[1:13], hadm_id LIMIT 64
""")
def _(t):
    return wn.sample(t.admissions, "hadm_id", 64, seed=11).select("hadm_id")


@case("l6_rows_per_stay", """
SELECT stay_id, event_id, start_ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stay_id
  ORDER BY start_ts, event_id, value) AS rn FROM stay_events) WHERE rn <= 2
""")
def _(t):
    return wn.top_per_group(
        t.stay_events, ["stay_id"], ["start_ts", "event_id", "value"], 2
    ).select("stay_id", "event_id", "start_ts")


@case("u1_stacked_events", """
SELECT hadm_id, charttime, 'lab' AS source FROM labevents WHERE valuenum > 49
UNION ALL SELECT hadm_id, charttime, 'chart' FROM chartevents WHERE valuenum > 88
""")
def _(t):
    def part(df, source, floor):
        return df.where(F.col("valuenum") > floor).select(
            "hadm_id", "charttime", F.lit(source).alias("source")
        )
    return wn.stack([part(t.labevents, "lab", 49), part(t.chartevents, "chart", 88)])


@case("u2_distinct", "SELECT DISTINCT hadm_id, icd_code FROM diagnoses_icd "
      "WHERE icd_version = 9")
def _(t):
    return t.diagnoses_icd.where("icd_version = 9").select("hadm_id", "icd_code").distinct()


@case("u3_merge_by_key", """
WITH both_parts AS (
  SELECT 0 AS f, hadm_id, seq_num, icd_code, icd_version FROM diagnoses_icd WHERE icd_version = 9
  UNION ALL SELECT 1, hadm_id, seq_num, icd_code, icd_version FROM diagnoses_icd)
SELECT hadm_id, seq_num, icd_code, icd_version FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY hadm_id, seq_num ORDER BY f, icd_code, icd_version) AS rn FROM both_parts)
WHERE rn = 1
""")
def _(t):
    return wn.merge_by_key(
        [t.diagnoses_icd.where("icd_version = 9"), t.diagnoses_icd], ["hadm_id", "seq_num"]
    )


@case("u4_set_members", """
WITH a AS (SELECT DISTINCT hadm_id, drug FROM prescriptions WHERE route = 'IV'),
b AS (SELECT DISTINCT hadm_id, drug FROM prescriptions WHERE route = 'PO')
SELECT COALESCE(a.hadm_id, b.hadm_id) AS hadm_id, COALESCE(a.drug, b.drug) AS drug,
  CASE WHEN a.drug IS NOT NULL AND b.drug IS NOT NULL THEN 'shared'
    WHEN a.drug IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS member_of
FROM a FULL JOIN b ON a.hadm_id = b.hadm_id AND a.drug = b.drug
""")
def _(t):
    return wn.set_members(
        t.prescriptions.where("route = 'IV'"), t.prescriptions.where("route = 'PO'"),
        ["hadm_id"], "drug",
    )


# --- join shapes -----------------------------------------------------------------------


@case("j1_with_dimension", "SELECT l.labevent_id, d.label, l.valuenum FROM labevents l "
      "JOIN d_labitems d ON l.itemid = d.itemid")
def _(t):
    return jn.with_dimension(t.labevents, t.d_labitems, "itemid").select(
        "labevent_id", "label", "valuenum"
    )


@case("j2_composite_key", """
SELECT di.hadm_id, di.seq_num, dd.long_title FROM diagnoses_icd di JOIN d_icd_diagnoses dd
ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
""")
def _(t):
    return jn.with_dimension(
        t.diagnoses_icd, t.d_icd_diagnoses, ["icd_code", "icd_version"]
    ).select("hadm_id", "seq_num", "long_title")


@case("j3_defaults", """
SELECT a.hadm_id, COALESCE(x.n, 0) AS n FROM admissions a LEFT JOIN
(SELECT hadm_id, COUNT(*) AS n FROM microbiologyevents GROUP BY hadm_id) x ON a.hadm_id = x.hadm_id
""")
def _(t):
    counts = t.microbiologyevents.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"))
    return jn.with_defaults(t.admissions.select("hadm_id"), counts, "hadm_id", {"n": 0})


@case("j4_left_with_predicates", """
SELECT i.stay_id, COUNT(c.stay_id) AS n, MAX(c.valuenum) AS peak FROM icustays i
LEFT JOIN chartevents c ON i.stay_id = c.stay_id AND c.itemid = 223834
  AND c.valuenum IS NOT NULL AND c.charttime <= i.intime + INTERVAL 48 HOUR GROUP BY i.stay_id
""")
def _(t):
    from caseweave.functions.times import plus_hours
    stays = t.icustays.select("stay_id", "intime")
    facts = t.chartevents.select("stay_id", "itemid", "valuenum", "charttime")
    return jn.with_matching(
        stays, facts, "stay_id",
        (F.col("itemid") == rules.OXYGEN_FLOW) & F.col("valuenum").isNotNull(),
        F.col("charttime") <= plus_hours("intime", 48),
    ).groupBy("stay_id").agg(F.count("itemid").alias("n"), F.max("valuenum").alias("peak"))


@case("j5_semi", "SELECT hadm_id FROM admissions WHERE hadm_id IN "
      "(SELECT hadm_id FROM microbiologyevents)")
def _(t):
    return jn.matching(t.admissions, t.microbiologyevents).select("hadm_id")


@case("j6_anti", "SELECT hadm_id FROM admissions a WHERE NOT EXISTS "
      "(SELECT 1 FROM microbiologyevents m WHERE m.hadm_id = a.hadm_id)")
def _(t):
    return jn.not_matching(t.admissions, t.microbiologyevents).select("hadm_id")


@case("j7_in_interval", """
SELECT l.labevent_id, i.stay_id, l.valuenum FROM labevents l JOIN icustays i
ON l.hadm_id = i.hadm_id AND l.charttime BETWEEN i.intime AND i.outtime
""")
def _(t):
    return jn.in_interval(t.labevents, t.icustays, "hadm_id").select(
        "labevent_id", "stay_id", "valuenum"
    )


@case("j8_assign_stay", """
WITH e AS (SELECT DISTINCT hadm_id, labevent_id, charttime FROM labevents)
SELECT labevent_id, hadm_id, stay_id FROM (SELECT e.labevent_id, e.hadm_id, s.stay_id,
  ROW_NUMBER() OVER (PARTITION BY e.labevent_id, e.charttime ORDER BY s.intime, s.stay_id) AS rn
  FROM e JOIN icustays s ON e.hadm_id = s.hadm_id AND s.intime <= e.charttime
  AND (s.outtime IS NULL OR e.charttime <= s.outtime)) WHERE rn = 1
""")
def _(t):
    events = t.labevents.select("hadm_id", "labevent_id", "charttime").distinct()
    return jn.assign_stay(events, t.icustays).select(
        "labevent_id", "hadm_id", "stay_id"
    )


@case("j10_later_in_horizon", """
SELECT DISTINCT x.hadm_id FROM admissions x JOIN admissions y ON x.subject_id = y.subject_id
AND y.admittime > x.dischtime AND y.admittime - x.dischtime <= INTERVAL 90 DAY
""")
def _(t):
    everyone = t.admissions.select("hadm_id").withColumns(
        {"icd_code": F.lit("ANY"), "icd_version": F.lit(10)}
    )
    later = cohorts.outcome_diagnosis(t.admissions, everyone, ["ANY"], 90)
    return later.where("value = 1").select("hadm_id")


@case("j12_scalar_subquery", """
SELECT a.hadm_id, (SELECT MAX(i.outtime) FROM icustays i WHERE i.hadm_id = a.hadm_id) AS last_out
FROM admissions a
""")
def _(t):
    last = t.icustays.groupBy("hadm_id").agg(F.max("outtime").alias("last_out"))
    return t.admissions.select("hadm_id").join(last, "hadm_id", "left")


@case("j15_merged_features", """
SELECT a.hadm_id, s.n_stays, d.n_codes, r.n_drugs FROM admissions a
LEFT JOIN (SELECT hadm_id, COUNT(*) AS n_stays FROM icustays GROUP BY 1) s ON a.hadm_id = s.hadm_id
LEFT JOIN (SELECT hadm_id, COUNT(*) AS n_codes FROM diagnoses_icd GROUP BY 1) d
  ON a.hadm_id = d.hadm_id
LEFT JOIN (SELECT hadm_id, COUNT(DISTINCT drug) AS n_drugs FROM prescriptions GROUP BY 1) r
  ON a.hadm_id = r.hadm_id
""")
def _(t):
    def count(df, fold, name):
        return df.groupBy("hadm_id").agg(fold.alias(name))
    return jn.merge_features(t.admissions.select("hadm_id"), [
        count(t.icustays, F.count(F.lit(1)), "n_stays"),
        count(t.diagnoses_icd, F.count(F.lit(1)), "n_codes"),
        count(t.prescriptions, F.count_distinct("drug"), "n_drugs"),
    ])


@case("j16_mean_until", """
SELECT a.hadm_id, ROUND(AVG(TRY_CAST(o.result_value AS DOUBLE)), 6) AS bmi
FROM admissions a JOIN omr o ON a.subject_id = o.subject_id
WHERE o.result_name LIKE '%BMI%' AND o.chartdate <= CAST(a.admittime AS DATE)
  AND TRY_CAST(o.result_value AS DOUBLE) IS NOT NULL GROUP BY a.hadm_id
""")
def _(t):
    bmi = jn.mean_until(
        t.admissions.select("hadm_id", "subject_id", "admittime"),
        t.omr.where(F.col("result_name").contains("BMI")), "subject_id", "admittime", "chartdate",
        F.col("result_value").try_cast("double"), "hadm_id", "bmi",
    )
    return bmi.withColumn("bmi", F.round("bmi", 6))
