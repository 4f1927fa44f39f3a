"""SQL of intermediate results that several checks start from."""

from __future__ import annotations

SHARED_SQL: dict[str, str] = {}

SHARED_SQL["age"] = """
SELECT a.hadm_id, a.subject_id, p.anchor_age + (YEAR(a.admittime) - p.anchor_year) AS age
FROM patients p JOIN admissions a ON p.subject_id = a.subject_id
"""

SHARED_SQL["next_admit"] = """
SELECT *, LEAD(admittime) OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id)
  AS next_admittime FROM admissions
"""

SHARED_SQL["readmit_flags"] = """
SELECT hadm_id,
  CASE WHEN next_admittime <= dischtime + INTERVAL 30 DAY THEN 1 ELSE 0 END AS readmitted_30d,
  CASE WHEN next_admittime <= dischtime + INTERVAL 60 DAY THEN 1 ELSE 0 END AS readmitted_60d
FROM next_admit
"""

SHARED_SQL["readmit_labels"] = """
SELECT subject_id, hadm_id, dischtime, next_admittime,
  DATE_DIFF('day', dischtime, next_admittime) AS days_to_readmission,
  CASE WHEN DATE_DIFF('day', dischtime, next_admittime) <= 30 THEN 1 ELSE 0 END AS readmitted_30d,
  CASE WHEN DATE_DIFF('day', dischtime, next_admittime) <= 60 THEN 1 ELSE 0 END AS readmitted_60d
FROM next_admit
WHERE hospital_expire_flag = 0 AND discharge_location NOT IN ('HOSPICE', 'AGAINST ADVICE')
"""

SHARED_SQL["first_stay"] = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) AS rn
  FROM icustays) WHERE rn = 1
"""

DAY_NUMBER = """
CASE WHEN {ts} = {end} THEN DATE_DIFF('day', {start}, {end})
    + CASE WHEN {end} > date_trunc('day', {end}) THEN 1 ELSE 0 END
  ELSE DATE_DIFF('day', {start}, {ts}) + 1 END
"""


def located(table: str, time: str, columns: str) -> str:
    """Rows of an event table in the earliest stay that contains them, with the day."""
    day = DAY_NUMBER.format(ts=f"e.{time}", start="s.intime", end="s.outtime")
    return f"""
SELECT {columns}, s.stay_id, CAST({day} AS INT) AS day_number
FROM (SELECT x.*, (SELECT arg_min(i.stay_id, (i.intime, i.stay_id)) FROM icustays i
  WHERE i.hadm_id = x.hadm_id AND i.intime <= x.{time} AND x.{time} <= i.outtime) AS sid
  FROM {table} x) e JOIN icustays s ON e.sid = s.stay_id
"""


SHARED_SQL["lab_rows"] = located(
    "labevents", "charttime",
    "e.hadm_id, e.itemid, e.charttime, e.valuenum, e.ref_range_lower, e.ref_range_upper",
)
SHARED_SQL["lab_nodes"] = """
SELECT 'BME-' || stay_id || '-' || r.itemid || '-' || strftime(charttime, '%Y%m%d%H%M%S') AS id,
  hadm_id, stay_id, day_number, d.label AS name, charttime AS start_ts, MIN(valuenum) AS value,
  CAST(r.itemid AS VARCHAR) AS concept_key
FROM lab_rows r JOIN d_labitems d ON r.itemid = d.itemid WHERE valuenum IS NOT NULL
GROUP BY hadm_id, stay_id, day_number, r.itemid, d.label, charttime
"""
SHARED_SQL["vital_nodes"] = f"""
SELECT 'CSE-' || c.stay_id || '-' || c.itemid || '-' || strftime(c.charttime, '%Y%m%d%H%M%S') AS id,
  c.hadm_id, c.stay_id, CASE WHEN c.charttime >= i.intime AND c.charttime <= i.outtime THEN
  CAST({DAY_NUMBER.format(ts="c.charttime", start="i.intime", end="i.outtime")} AS INT) END
    AS day_number,
  d.label AS name, c.charttime AS start_ts, MIN(c.valuenum) AS value, c.itemid
FROM chartevents c JOIN icustays i ON c.stay_id = i.stay_id JOIN d_items d ON c.itemid = d.itemid
WHERE c.valuenum IS NOT NULL GROUP BY ALL
"""
SHARED_SQL["culture_nodes"] = located(
    "microbiologyevents", "charttime",
    "'MBE-' || e.microevent_id AS id, e.hadm_id, e.spec_type_desc AS name, "
    "e.charttime AS start_ts, e.org_name AS concept_key",
)
SHARED_SQL["drug_nodes"] = """
SELECT DISTINCT 'RXE-' || hadm_id || '-' || trim(regexp_replace(lower(drug), '[^a-z0-9]+', '-', 'g'),
    '-') || '-' || strftime(starttime, '%Y%m%d%H%M%S') AS id,
  hadm_id, stay_id, day_number, drug AS name, starttime AS start_ts, lower(drug) AS concept_key
FROM drug_rows
"""
SHARED_SQL["drug_rows"] = located(
    "prescriptions", "starttime", "e.hadm_id, e.drug, e.starttime"
)
SHARED_SQL["stay_day_rows"] = """
SELECT stay_id, hadm_id, CAST(DATE_DIFF('day', CAST(intime AS DATE), d) + 1 AS INT) AS day_number
FROM (SELECT *, CAST(UNNEST(generate_series(date_trunc('day', intime), date_trunc('day', outtime),
  INTERVAL 1 DAY)) AS DATE) AS d FROM icustays)
WHERE GREATEST(intime, CAST(d AS TIMESTAMP)) < LEAST(outtime, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY)
"""
SHARED_SQL["diagnosis_rows"] = """
SELECT hadm_id, seq_num, MIN((icd_code, icd_version)) AS c FROM diagnoses_icd GROUP BY hadm_id, seq_num
"""
SHARED_SQL["mapped_diagnoses"] = """
SELECT di.hadm_id, di.seq_num, di.icd_code, di.icd_version,
  CASE WHEN di.icd_version = 10 AND length(COALESCE(x.concept_id, y.concept_id)) >= 5
    THEN COALESCE(x.concept_id, y.concept_id) END AS concept_id
FROM diagnoses_icd di LEFT JOIN icd_concepts x ON di.icd_code = x.code
LEFT JOIN icd_concepts y ON length(di.icd_code) > 3 AND substr(di.icd_code, 1, 3) = y.code
"""
SHARED_SQL["plain_drugs"] = """
SELECT DISTINCT drug, trim(regexp_replace(regexp_replace(trim(lower(drug)),
    '\\s*\\(.*\\)\\s*$', ''), '(?i)\\s+\\d+[\\d.]*\\s*(mg|g|ml|mcg|%|units?|meq).*$', '')) AS p
  FROM prescriptions
"""
SHARED_SQL["drug_hits"] = """
SELECT p.drug, c.concept_id, ROW_NUMBER() OVER (PARTITION BY p.drug ORDER BY c.name <> p.p, c.name) AS rn
  FROM plain_drugs p JOIN drug_concepts c ON starts_with(p.p, c.name) OR starts_with(c.name, p.p)
"""
SHARED_SQL["diagnosis_concepts"] = """
SELECT r.hadm_id, r.seq_num, COALESCE(m.concept_id, 'unmapped:diagnosis:' || c[1]) AS concept FROM diagnosis_rows r
LEFT JOIN (SELECT DISTINCT icd_code, icd_version, concept_id FROM mapped_diagnoses) m
ON r.c[1] = m.icd_code AND r.c[2] = m.icd_version
"""
SHARED_SQL["day_events"] = """
SELECT 'lab' AS kind, n.hadm_id, n.stay_id, n.day_number, n.start_ts,
  COALESCE(c.concept_id, 'unmapped:lab:' || n.concept_key) AS concept
  FROM lab_nodes n LEFT JOIN lab_concepts c ON n.concept_key = CAST(c.itemid AS VARCHAR)
UNION ALL SELECT 'vital', n.hadm_id, n.stay_id, n.day_number, n.start_ts,
  COALESCE(c.concept_id, 'unmapped:vital:' || n.itemid) FROM vital_nodes n
  LEFT JOIN (SELECT * FROM chart_concepts WHERE length(concept_id) >= 5) c ON n.itemid = c.itemid
  WHERE n.day_number IS NOT NULL
UNION ALL SELECT 'microbiology', n.hadm_id, n.stay_id, n.day_number, n.start_ts,
  COALESCE(c.concept_id, 'unmapped:microbiology:' || COALESCE(n.concept_key, 'None'))
  FROM culture_nodes n LEFT JOIN organism_concepts c ON n.concept_key = c.org_name
UNION ALL SELECT 'drug', n.hadm_id, n.stay_id, n.day_number, n.start_ts,
  COALESCE(h.concept_id, 'unmapped:drug:' || n.concept_key)
  FROM drug_nodes n LEFT JOIN (SELECT * FROM drug_hits WHERE rn = 1) h ON n.name = h.drug
"""
SHARED_SQL["next_pairs"] = """
SELECT * FROM (SELECT hadm_id, admittime, LEAD(hadm_id) OVER w AS next_id,
  LEAD(admittime) OVER w AS next_at FROM admissions
  WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)) WHERE next_id IS NOT NULL
"""
SHARED_SQL["record_edges"] = """
SELECT 'PA-' || subject_id AS src, 'hasAdmission' AS predicate, 'HA-' || hadm_id AS dst FROM admissions
UNION ALL SELECT 'HA-' || hadm_id, 'admissionOf', 'PA-' || subject_id FROM admissions
UNION ALL SELECT 'HA-' || hadm_id, 'followedBy', 'HA-' || next_id FROM next_pairs
UNION ALL SELECT 'HA-' || hadm_id, 'containsICUStay', 'IS-' || stay_id FROM icustays
UNION ALL SELECT 'IS-' || stay_id, 'partOf', 'HA-' || hadm_id FROM icustays
UNION ALL SELECT 'IS-' || stay_id, 'hasICUDay', 'ID-' || stay_id || '-D' || day_number
  FROM stay_day_rows
UNION ALL SELECT 'ID-' || stay_id || '-D' || day_number, 'partOf', 'IS-' || stay_id
  FROM stay_day_rows
"""
SHARED_SQL["typed_edges"] = """
SELECT 'patient' AS src_type, 'has_admission' AS rel, 'admission' AS dst_type,
  'PA-' || subject_id AS src_id, 'HA-' || hadm_id AS dst_id, CAST(NULL AS DOUBLE) AS delta_days
  FROM admissions
UNION ALL SELECT 'admission', 'contains_icu_stay', 'icu_stay', 'HA-' || hadm_id, 'IS-' || stay_id,
  NULL FROM icustays
UNION ALL SELECT 'icu_stay', 'has_icu_day', 'icu_day', 'IS-' || stay_id,
  'ID-' || stay_id || '-D' || day_number, NULL FROM stay_day_rows
UNION ALL SELECT 'admission', 'followed_by', 'admission', 'HA-' || hadm_id, 'HA-' || next_id,
  DATE_DIFF('second', admittime, next_at) / 86400.0 FROM next_pairs
UNION ALL SELECT 'icu_day', 'has_event', n.kind, 'ID-' || n.stay_id || '-D' || n.day_number,
  n.concept, DATE_DIFF('second', a.admittime, n.start_ts) / 86400.0
  FROM day_events n JOIN admissions a ON n.hadm_id = a.hadm_id
UNION ALL SELECT 'admission', 'has_diagnosis', 'diagnosis', 'HA-' || hadm_id, concept, NULL
  FROM diagnosis_concepts
"""
