"""Queries over relations, days, trajectories and orders of events (T, J9, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.operators import aggregates as ag, codes as cd, filters as fl, temporal as tp
from caseweave.operators import windows as wn
from caseweave.registry.aggregates import rounded
from caseweave.registry.case import case
from caseweave.registry.windows import TOTALS_SQL

CLASSIFY = """
CASE WHEN {a}.end_ts < {b}.start_ts THEN 'before'
  WHEN {a}.end_ts = {b}.start_ts AND {a}.start_ts < {b}.start_ts THEN 'meets'
  WHEN {a}.start_ts < {b}.start_ts AND {b}.start_ts < {a}.end_ts AND {a}.end_ts < {b}.end_ts
    THEN 'overlaps'
  WHEN {a}.start_ts = {b}.start_ts AND {a}.end_ts < {b}.end_ts THEN 'starts'
  WHEN {b}.start_ts < {a}.start_ts AND {a}.end_ts < {b}.end_ts THEN 'during'
  WHEN {a}.end_ts = {b}.end_ts AND {a}.start_ts > {b}.start_ts THEN 'finishes' END
"""
# All related pairs, formed only in the check.  The relation of a later event to an
# earlier one counts only when the earlier one has none to the later.
PAIRS_SQL = f"""
SELECT a.stay_id, a.hadm_id, a.event_id AS src,
  CASE WHEN b.start_ts < a.start_ts AND ({CLASSIFY.format(a='b', b='a')}) IS NOT NULL THEN NULL
  ELSE {CLASSIFY.format(a='a', b='b')} END AS relation,
  b.event_id AS dst, a.name AS src_name, b.name AS dst_name
FROM stay_events a JOIN stay_events b ON a.stay_id = b.stay_id AND a.event_id <> b.event_id
"""


@case("t1_relation_to_next", f"""
WITH n AS (SELECT stay_id, event_id, start_ts, end_ts, LEAD(event_id) OVER w AS next_id,
  LEAD(start_ts) OVER w AS ns, LEAD(end_ts) OVER w AS ne FROM stay_events
  WINDOW w AS (PARTITION BY stay_id ORDER BY start_ts, end_ts, event_id)),
b AS (SELECT *, ns AS b_start FROM n WHERE next_id IS NOT NULL)
SELECT x.stay_id, x.event_id, x.next_id, {CLASSIFY.format(a='x', b='y')} AS relation
FROM b x JOIN (SELECT event_id, start_ts, end_ts FROM stay_events) y ON x.next_id = y.event_id
""")
def _(t):
    return tp.relation_to_next(t.stay_events)


@case("t2_touching_relations", f"""
SELECT stay_id, src, relation, dst FROM ({PAIRS_SQL}) WHERE relation <> 'before'
""")
def _(t):
    return tp.touching_relations(t.stay_events)


@case("t2_nearest_after", """
SELECT a.stay_id, a.event_id, a.end_ts, MIN(b.start_ts) AS next_start FROM stay_events a
JOIN stay_events b ON a.stay_id = b.stay_id AND b.start_ts > a.end_ts
GROUP BY a.stay_id, a.event_id, a.end_ts
""")
def _(t):
    return tp.nearest_after(t.stay_events)


POINTS_SQL = """
SELECT i.hadm_id, l.charttime FROM labevents l JOIN icustays i ON l.hadm_id = i.hadm_id
  WHERE l.valuenum IS NOT NULL AND l.charttime BETWEEN i.intime AND i.outtime
UNION ALL SELECT i.hadm_id, c.charttime FROM chartevents c JOIN icustays i ON c.stay_id = i.stay_id
  WHERE c.valuenum IS NOT NULL
"""


TEMPORAL_FEATURES_SQL = f"""
WITH e AS ({POINTS_SQL}), n AS (SELECT hadm_id, charttime, ROW_NUMBER() OVER (PARTITION BY hadm_id
  ORDER BY charttime) AS rn FROM e),
r AS (SELECT a.hadm_id, SUM(CASE WHEN a.charttime <> b.charttime THEN 1 ELSE 0 END) AS nb,
  COUNT(*) AS nt FROM n a JOIN n b ON a.hadm_id = b.hadm_id AND a.rn < b.rn GROUP BY a.hadm_id),
c AS (SELECT hadm_id, COUNT(*) AS ne FROM e GROUP BY hadm_id),
d AS (SELECT hadm_id, SUM(DATE_DIFF('day', CAST(intime AS DATE), CAST(outtime AS DATE)) + 1) AS nd
  FROM icustays GROUP BY hadm_id)
SELECT a.hadm_id, ROUND(COALESCE(c.ne, 0) * 1.0 / GREATEST(COALESCE(d.nd, 1), 1), 6)
    AS events_per_icu_day,
  CAST(COALESCE(r.nb, 0) AS BIGINT) AS num_before_relations, 0 AS num_during_relations,
  CAST(COALESCE(r.nt, 0) AS BIGINT) AS total_temporal_edges
FROM admissions a LEFT JOIN c ON a.hadm_id = c.hadm_id LEFT JOIN d ON a.hadm_id = d.hadm_id
LEFT JOIN r ON a.hadm_id = r.hadm_id
"""


@case("t3_temporal_features", TEMPORAL_FEATURES_SQL)
def _(t):
    return rounded(tp.temporal_features(t.admissions, t.labevents, t.chartevents, t.icustays))


@case("j9_point_pairs", """
WITH e AS (SELECT user_id, date_trunc('hour', ts) AS at, ROW_NUMBER() OVER (PARTITION BY user_id
  ORDER BY ts) AS rn FROM events)
SELECT s.user_id, s.n AS n_events, CAST(COALESCE(p.m, 0) AS BIGINT) AS n_meets,
  CAST(COALESCE(p.b, 0) AS BIGINT) AS n_before
FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1) s LEFT JOIN
(SELECT a.user_id, SUM(CASE WHEN a.at = b.at THEN 1 ELSE 0 END) AS m,
  SUM(CASE WHEN a.at <> b.at THEN 1 ELSE 0 END) AS b FROM e a JOIN e b
  ON a.user_id = b.user_id AND a.rn < b.rn GROUP BY a.user_id) p ON s.user_id = p.user_id
""")
def _(t):
    points = t.events.select("user_id", F.date_trunc("hour", "ts").alias("at"))
    return tp.point_pair_counts(points, "user_id", "at")


@case("j11_cotimed_readings", """
SELECT x.stay_id, x.charttime, MAX(x.valuenum * 2 / NULLIF(y.valuenum, 0)) AS index_high
FROM chartevents x JOIN chartevents y ON y.stay_id = x.stay_id AND y.charttime = x.charttime
WHERE x.itemid = 220739 AND x.valuenum BETWEEN 1 AND 4 AND y.itemid = 223901
AND y.valuenum BETWEEN 1 AND 6 GROUP BY x.stay_id, x.charttime
""")
def _(t):
    from caseweave.registry.filters import EYE, MOTOR, SHOCK
    return fl.index_per_instant(
        t.chartevents, [EYE, MOTOR], SHOCK, ["stay_id", "charttime"]
    ).select("stay_id", "charttime", "index_high")


@case("t4_relation_counts", f"""
SELECT s.stay_id, COUNT(*) FILTER (p.relation = 'before') AS num_before_relations,
  COUNT(*) FILTER (p.relation = 'during') AS num_during_relations,
  COUNT(p.relation) AS total_temporal_edges
FROM (SELECT DISTINCT stay_id FROM stay_events) s LEFT JOIN ({PAIRS_SQL}) p
ON s.stay_id = p.stay_id GROUP BY s.stay_id
""")
def _(t):
    return tp.relation_counts(t.stay_events)


@case("a37_relation_counts", f"""
SELECT relation, COUNT(*) AS count FROM ({PAIRS_SQL}) WHERE relation IS NOT NULL GROUP BY relation
""")
def _(t):
    return tp.relations_by_name(t.stay_events)


DAYS_SQL = """
SELECT stay_id, hadm_id, CAST(DATE_DIFF('day', CAST(intime AS DATE), d) + 1 AS INT) AS day_number,
  GREATEST(intime, CAST(d AS TIMESTAMP)) AS day_begin,
  LEAST(outtime, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY) AS day_end
FROM (SELECT *, CAST(UNNEST(generate_series(date_trunc('day', intime), date_trunc('day', outtime),
  INTERVAL 1 DAY)) AS DATE) AS d FROM icustays)
WHERE GREATEST(intime, CAST(d AS TIMESTAMP)) < LEAST(outtime, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY)
"""


@case("t5_stay_days", DAYS_SQL)
def _(t):
    return tp.stay_days(t.icustays)


DAY_EVENTS_SQL = f"""
SELECT c.stay_id, c.itemid, c.charttime, d.day_number FROM chartevents c LEFT JOIN
(SELECT x.*, i.outtime FROM ({DAYS_SQL}) x JOIN icustays i ON x.stay_id = i.stay_id) d
ON c.stay_id = d.stay_id AND ((c.charttime >= d.day_begin AND c.charttime < d.day_end)
  OR (c.charttime = d.day_end AND d.day_end = d.outtime))
"""


@case("t6_event_days", DAY_EVENTS_SQL)
def _(t):
    return tp.with_day(t.chartevents, t.icustays).select(
        "stay_id", "itemid", "charttime", "day_number"
    )


@case("t7_days_spanned", """
SELECT stay_id, los * 24.0 AS icu_los_hours,
  DATE_DIFF('day', CAST(intime AS DATE), CAST(outtime AS DATE)) + 1 AS num_icu_days FROM icustays
""")
def _(t):
    return t.icustays.select(
        "stay_id", (F.col("los") * 24.0).alias("icu_los_hours"),
        tp.days_spanned("intime", "outtime").alias("num_icu_days"),
    )


BUCKETS_SQL = """
WITH p AS (SELECT DISTINCT r.hadm_id, 'snomed_drug:' || lower(trim(r.drug)) AS code,
    r.starttime AS tm, a.admittime FROM prescriptions r JOIN admissions a ON r.hadm_id = a.hadm_id
  WHERE r.starttime IS NOT NULL AND r.starttime >= a.admittime AND r.starttime <= a.dischtime),
f AS (SELECT hadm_id, MIN(intime) AS fi FROM icustays GROUP BY hadm_id),
x AS (SELECT p.*, f.fi, (SELECT MIN(i.intime) FROM icustays i WHERE i.hadm_id = p.hadm_id
  AND i.intime <= p.tm AND p.tm <= i.outtime) AS si FROM p LEFT JOIN f ON p.hadm_id = f.hadm_id),
y AS (SELECT hadm_id, code, tm, CASE
  WHEN si IS NOT NULL THEN 'icu_day_' || DATE_DIFF('day', CAST(si AS DATE), CAST(tm AS DATE))
  WHEN fi IS NOT NULL AND tm < fi THEN CASE WHEN DATE_DIFF('second', admittime, tm) / 3600.0 < 24
    THEN 'pre_icu_0_24' ELSE 'pre_icu_24_plus' END
  WHEN fi IS NOT NULL THEN NULL
  WHEN DATE_DIFF('second', admittime, tm) / 3600.0 < 24 THEN 'h_0_24'
  WHEN DATE_DIFF('second', admittime, tm) / 3600.0 < 48 THEN 'h_24_48'
  ELSE 'day_' || CAST(FLOOR(DATE_DIFF('second', admittime, tm) / 86400.0) AS BIGINT) END AS bucket
  FROM x)
SELECT hadm_id, bucket, code, MIN(tm) AS first_at FROM y WHERE bucket IS NOT NULL
GROUP BY hadm_id, bucket, code
"""


def drug_points(t):
    return t.prescriptions.select(
        "hadm_id", F.concat(F.lit("snomed_drug:"), F.lower(F.trim("drug"))).alias("code"),
        F.col("starttime").alias("at"),
    )


def buckets(t):
    return tp.bucket_events(drug_points(t), t.admissions, t.icustays)


@case("t8_buckets", BUCKETS_SQL)
def _(t):
    return buckets(t)


SERIES_SQL = """
WITH s AS (SELECT l.hadm_id, l.labevent_id, l.charttime AS tm, l.valuenum AS v FROM labevents l
  JOIN d_labitems d ON l.itemid = d.itemid WHERE LOWER(d.label) = 'creatinine'
  AND l.valuenum IS NOT NULL AND EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = l.hadm_id
    AND l.charttime BETWEEN i.intime AND i.outtime)),
b AS (SELECT *, DATE_DIFF('second', MIN(tm) OVER (PARTITION BY hadm_id), tm) / 3600.0 AS h FROM s)
"""


def creatinine(t):
    return tp.reading_series(t.labevents, t.d_labitems, t.icustays, "Creatinine", by_stay=False)


@case("t9_slope", SERIES_SQL + """
SELECT hadm_id, ROUND(regr_slope(v, h), 6) AS trend FROM b GROUP BY hadm_id
HAVING COUNT(*) >= 2 AND MIN(h) <> MAX(h)
""")
def _(t):
    return rounded(tp.trend(creatinine(t)))


@case("t9_delta_first_day", SERIES_SQL + """
SELECT hadm_id, arg_max(v, (tm, v)) - arg_min(v, (tm, v)) AS trend FROM b WHERE h <= 24
GROUP BY hadm_id HAVING COUNT(*) >= 2
""")
def _(t):
    return tp.trend(creatinine(t), "delta", 24, tie=["value"])


@case("t10_dose_trend", """
WITH o AS (SELECT hadm_id, drug, starttime AS tm, MAX(dose_val_rx) AS v FROM prescriptions
  WHERE drug IN ('Propofol', 'Fentanyl Citrate') AND starttime IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT o.* FROM o WHERE EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = o.hadm_id
  AND o.tm BETWEEN i.intime AND i.outtime)),
b AS (SELECT *, DATE_DIFF('second', MIN(tm) OVER (PARTITION BY hadm_id), tm) / 3600.0 AS h FROM s)
SELECT hadm_id, ROUND(regr_slope(v, h), 6) AS trend FROM b GROUP BY hadm_id
HAVING COUNT(*) >= 2 AND MIN(h) <> MAX(h)
""")
def _(t):
    sedatives = F.array_contains(cd.drug_categories(F.col("drug")), "sedatives")
    return rounded(tp.trend(tp.dose_series(t.prescriptions, t.icustays, sedatives)))


@case("t11_hours_to_first", SERIES_SQL + """
SELECT b.hadm_id, ROUND(MIN(DATE_DIFF('second', i.intime, b.tm) / 3600.0), 6) AS value FROM b
JOIN icustays i ON b.hadm_id = i.hadm_id AND b.tm BETWEEN i.intime AND i.outtime GROUP BY b.hadm_id
""")
def _(t):
    return rounded(tp.hours_to_first(creatinine(t), t.icustays))


def _precedence_case(rel):
    @case(f"t12_precedence_{rel}", f"""
SELECT hadm_id, CAST(COUNT(*) AS DOUBLE) AS value FROM ({PAIRS_SQL}) WHERE relation = '{rel}'
AND src_name = 'Creatinine' AND dst_name = 'Vancomycin' GROUP BY hadm_id
""")
    def _(t):
        return tp.precedence(t.stay_events, "creatinine", "vancomycin", rel)


for _rel in ("before", "meets", "overlaps", "starts", "during"):
    _precedence_case(_rel)

FIRSTS_SQL = f"""
SELECT hadm_id, 'intubation' AS event_name, MIN(starttime) AS event_time FROM procedureevents
  WHERE itemid IN (225792, 224385) AND hadm_id IN (SELECT hadm_id FROM icustays) GROUP BY hadm_id
UNION ALL SELECT hadm_id, 'osmotic therapy', MIN(starttime) FROM prescriptions
  WHERE (LOWER(drug) LIKE '%mannitol%' OR LOWER(drug) LIKE '%hypertonic%')
  AND hadm_id IN (SELECT hadm_id FROM icustays) GROUP BY hadm_id
UNION ALL SELECT i.hadm_id, 'GCS drop', MIN(g.charttime) FROM (SELECT stay_id, charttime,
  total - LAG(total) OVER (PARTITION BY stay_id ORDER BY charttime) AS c FROM ({TOTALS_SQL})) g
  JOIN icustays i ON g.stay_id = i.stay_id WHERE g.c <= -2 GROUP BY i.hadm_id
"""


def firsts(t):
    tubes = t.procedureevents.where(F.col("itemid").isin(rules.VENTILATION, rules.INTUBATION))
    osmotic = t.prescriptions.where(fl.contains_any(F.col("drug"), ["mannitol", "hypertonic"]))
    drops = wn.score_drops(wn.score_totals(t.chartevents)).join(
        t.icustays.select("stay_id", "hadm_id"), "stay_id"
    )
    return tp.first_times(fl.has_stay(t.admissions, t.icustays), {
        "intubation": (tubes, "starttime"), "osmotic therapy": (osmotic, "starttime"),
        "GCS drop": (drops, "charttime"),
    })


@case("t13_first_times", FIRSTS_SQL)
def _(t):
    return firsts(t)


SEQUENCES_SQL = f"""
WITH s AS (SELECT hadm_id, list(event_name ORDER BY event_time, event_name) AS seq,
  arg_min(event_name, (event_time, event_name)) AS f, COUNT(*) AS n,
  DATE_DIFF('second', MIN(event_time), MAX(event_time)) / 3600.0 AS gap
  FROM ({FIRSTS_SQL}) WHERE event_time IS NOT NULL GROUP BY hadm_id)
"""


@case("t14_common_sequence", SEQUENCES_SQL + """
SELECT array_to_string(seq, ' → ') AS most_common_sequence, COUNT(*) AS n_patients,
  ROUND(COUNT(*) / (SELECT COUNT(*) FROM s), 8) AS pct,
  ROUND((SELECT MEDIAN(gap) FROM s WHERE n >= 2), 8) AS median_first_to_last_hours
FROM s GROUP BY seq ORDER BY COUNT(*) DESC, seq LIMIT 1
""")
def _(t):
    return rounded(tp.common_sequence(firsts(t)), 8)


@case("t14_first_fractions", SEQUENCES_SQL + """
SELECT f AS first_event, ROUND(COUNT(*) / (SELECT COUNT(*) FROM s), 8) AS first_fraction
FROM s GROUP BY f
""")
def _(t):
    return rounded(tp.first_fractions(firsts(t)), 8)


@case("t16_assembled_features", SERIES_SQL + """
, sl AS (SELECT hadm_id, regr_slope(v, h) AS x FROM b GROUP BY hadm_id
  HAVING COUNT(*) >= 2 AND MIN(h) <> MAX(h)),
lo AS (SELECT hadm_id, SUM(DATE_DIFF('second', intime, outtime) / 3600.0) AS x FROM icustays
  GROUP BY hadm_id),
dr AS (SELECT hadm_id, COUNT(DISTINCT drug) AS x FROM prescriptions
  WHERE hadm_id IN (SELECT hadm_id FROM icustays) GROUP BY hadm_id)
SELECT a.hadm_id, ROUND(sl.x, 6) AS creatinine_slope, ROUND(lo.x, 6) AS icu_hours,
  CAST(dr.x AS DOUBLE) AS n_drugs FROM admissions a LEFT JOIN sl ON a.hadm_id = sl.hadm_id
LEFT JOIN lo ON a.hadm_id = lo.hadm_id LEFT JOIN dr ON a.hadm_id = dr.hadm_id
""")
def _(t):
    return rounded(tp.assemble_features(t.admissions, {
        "creatinine_slope": tp.trend(creatinine(t)), "icu_hours": ag.stay_hours(t.icustays),
        "n_drugs": ag.distinct_drugs(t.prescriptions, t.icustays),
    }))


@case("t17_events_per_day", f"""
SELECT (SELECT COUNT(*) FROM ({DAYS_SQL})) AS n_days, COUNT(*) AS n_events,
  ROUND(COUNT(*) / (SELECT COUNT(*) FROM ({DAYS_SQL})), 8) AS events_per_day
FROM ({DAY_EVENTS_SQL}) WHERE day_number IS NOT NULL
""")
def _(t):
    return rounded(tp.events_per_day(t.chartevents, t.icustays), 8)


@case("t18_value_series", """
SELECT l.hadm_id, l.valuenum AS value, l.valueuom AS unit, l.charttime AS timestamp
FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid WHERE LOWER(d.label) LIKE '%lactate%'
AND l.valuenum IS NOT NULL
UNION ALL SELECT c.hadm_id, c.valuenum, '', c.charttime FROM chartevents c JOIN d_items d
ON c.itemid = d.itemid WHERE LOWER(d.label) LIKE '%lactate%' AND c.valuenum IS NOT NULL
""")
def _(t):
    return tp.value_series(t.labevents, t.d_labitems, t.chartevents, t.d_items, "Lactate")


@case("t19_events_before", """
SELECT a.stay_id, a.event_id, a.kind, a.name, a.start_ts, COUNT(*) AS n_after FROM stay_events a
JOIN stay_events b ON a.stay_id = b.stay_id AND b.start_ts > a.end_ts
WHERE LOWER(a.name) LIKE '%sodium%' GROUP BY 1, 2, 3, 4, 5
""")
def _(t):
    return tp.events_before(t.stay_events, "sodium")


@case("t19_events_during", f"""
SELECT e.stay_id, e.event_id, e.kind, e.name, e.start_ts, e.value, COUNT(*) AS n_around
FROM stay_events e JOIN ({PAIRS_SQL}) p ON e.event_id = p.src AND p.relation = 'during'
GROUP BY ALL
""")
def _(t):
    return tp.events_during(t.stay_events)


@case("t20_stay_timeline", """
SELECT kind, name, value, start_ts AS timestamp FROM stay_events WHERE stay_id = 16
""")
def _(t):
    return tp.stay_timeline(t.stay_events, 16)


@case("t21_diagnosis_list", """
SELECT a.subject_id AS "subjectId", di.hadm_id AS "hadmId", di.icd_code AS "icdCode",
  dd.long_title AS "longTitle" FROM diagnoses_icd di LEFT JOIN d_icd_diagnoses dd
ON di.icd_code = dd.icd_code AND di.icd_version = dd.icd_version
JOIN admissions a ON di.hadm_id = a.hadm_id
WHERE starts_with(di.icd_code, 'diabetes') OR contains(LOWER(dd.long_title), 'diabetes')
""")
def _(t):
    return ag.diagnosis_list(t.diagnoses_icd, t.d_icd_diagnoses, t.admissions, "diabetes")


@case("t22_exact_label_aggregates", """
SELECT ROUND(AVG(valuenum), 6) AS mean_value, MAX(valuenum) AS max_value,
  MIN(valuenum) AS min_value, COUNT(valuenum) AS count_value FROM labevents l JOIN d_labitems d
ON l.itemid = d.itemid WHERE LOWER(d.label) = 'creatinine' AND valuenum IS NOT NULL
""")
def _(t):
    rows = fl.measured(t.labevents, dictionary=t.d_labitems, label="CREATININE", how="exact")
    value = F.col("valuenum")
    return rounded(rows.agg(*[
        fold(value).alias(name) for name, fold in
        (ag.AGGREGATES[h] for h in ("mean", "max", "min", "count"))
    ]))


@case("t22_two_groups", """
SELECT r.readmitted_30d AS group_value, ROUND(AVG(l.valuenum), 6) AS avg_value,
  COUNT(l.valuenum) AS count FROM labevents l JOIN d_labitems d ON l.itemid = d.itemid
JOIN readmit_flags r ON l.hadm_id = r.hadm_id WHERE LOWER(d.label) = 'creatinine'
AND l.valuenum IS NOT NULL AND EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = l.hadm_id
  AND l.charttime BETWEEN i.intime AND i.outtime) GROUP BY 1
""")
def _(t):
    rows = fl.measured(t.labevents, dictionary=t.d_labitems, label="Creatinine", how="exact")
    inside = fl.in_window(rows, t.icustays, "during")
    groups = ag.axis_values(t.admissions, t.patients, "readmitted_30d")
    return rounded(ag.compare_values(inside, groups))


def _drug_case(name, text, condition):
    @case(name, f"""
SELECT hadm_id, drug, starttime, stoptime, dose_val_rx, dose_unit_rx, route FROM prescriptions
WHERE {condition}
""")
    def _(t):
        return tp.drug_orders(t.prescriptions, text)


_drug_case("t23_drug_orders", "Kcentra", "contains(LOWER(drug), 'kcentra')")
_drug_case("t23_drug_orders_fallback", "reversal agent", "true")


@case("t24_stay_lengths", "SELECT hadm_id, stay_id, los AS los_days FROM icustays")
def _(t):
    return tp.stay_lengths(t.icustays)


@case("t25_encounter_details", """
SELECT a.hadm_id, a.admission_type, a.discharge_location, r.readmitted_30d, r.readmitted_60d
FROM admissions a JOIN readmit_flags r ON a.hadm_id = r.hadm_id
""")
def _(t):
    return tp.encounter_details(t.admissions)


@case("t26_subject_details", "SELECT subject_id, anchor_age AS age, gender FROM patients")
def _(t):
    return tp.subject_details(t.patients)


@case("t27_culture_results", """
SELECT hadm_id, spec_type_desc AS specimen_type, org_name AS organism_name, charttime AS timestamp
FROM microbiologyevents WHERE LOWER(spec_type_desc) LIKE '%staph%' OR LOWER(org_name) LIKE '%staph%'
""")
def _(t):
    return tp.culture_results(t.microbiologyevents, "Staph")
