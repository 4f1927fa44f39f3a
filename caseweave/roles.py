"""The clinical tables, read from the star-schema tables the driver provides.

Each clinical table is one SQL statement over the given tables, in the subset
both Spark and DuckDB accept, so a query and its check start from the same
rows.  Customers stand for subjects, orders for encounters, and order lines for
the events of an encounter; event times are the encounter's start plus hours
taken from the line's keys.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from caseweave.plans.sizes import deal_by_size
from caseweave.sources.tables import folder_bytes

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

ROLE_SQL: dict[str, str] = {}

ROLE_SQL["icd_list"] = """
SELECT * FROM (VALUES
  (0, 'I639', 10, 'Cerebral infarction, unspecified'),
  (1, 'I610', 10, 'Nontraumatic intracerebral hemorrhage in hemisphere'),
  (2, 'I609', 10, 'Nontraumatic subarachnoid hemorrhage, unspecified'),
  (3, '43391', 9, 'Occlusion of precerebral artery with cerebral infarction'),
  (4, '430', 9, 'Subarachnoid hemorrhage'),
  (5, '431', 9, 'Intracerebral hemorrhage'),
  (6, '43300', 9, 'Occlusion of basilar artery without infarction'),
  (7, 'S065X', 10, 'Traumatic subdural hemorrhage'),
  (8, 'S0630', 10, 'Unspecified focal traumatic brain injury'),
  (9, 'S0603', 10, 'Concussion'),
  (10, 'E119', 10, 'Type 2 diabetes mellitus without complications'),
  (11, 'E1122', 10, 'Type 2 diabetes mellitus with kidney disease'),
  (12, 'I5020', 10, 'Unspecified systolic heart failure'),
  (13, 'N179', 10, 'Acute kidney failure, unspecified'),
  (14, 'A419', 10, 'Sepsis, unspecified organism'),
  (15, 'R6521', 10, 'Severe sepsis with septic shock'),
  (16, 'J449', 10, 'Chronic obstructive pulmonary disease, unspecified'),
  (17, 'I10', 10, 'Essential hypertension'),
  (18, '5849', 9, 'Acute kidney failure, unspecified'),
  (19, '99592', 9, 'Severe sepsis'),
  (20, 'C50919', 10, 'Malignant neoplasm of breast'),
  (21, 'K7290', 10, 'Hepatic failure, unspecified'),
  (22, 'G309', 10, 'Alzheimer disease, unspecified'),
  (23, 'B20', 10, 'Human immunodeficiency virus disease'),
  (24, 'J189', 10, 'Pneumonia, unspecified organism')
) AS v(code_no, icd_code, icd_version, long_title)
"""

ROLE_SQL["d_icd_diagnoses"] = "SELECT icd_code, icd_version, long_title FROM {icd_list}"

ROLE_SQL["drug_list"] = """
SELECT * FROM (VALUES
  (0, 'Norepinephrine'), (1, 'Vancomycin'), (2, 'Mannitol 20%'),
  (3, 'Levetiracetam 500 mg'), (4, 'Propofol'), (5, 'Insulin Regular (Human)'),
  (6, 'Furosemide 40 mg'), (7, 'Heparin'), (8, 'Phytonadione'),
  (9, 'Kcentra'), (10, 'Aspirin 81 mg'), (11, 'Metoprolol Tartrate'),
  (12, 'Ceftriaxone'), (13, 'Hypertonic Saline 3%'), (14, 'Atorvastatin'),
  (15, 'Fentanyl Citrate')
) AS v(drug_no, drug)
"""

ROLE_SQL["d_labitems"] = """
SELECT * FROM (VALUES
  (50912, 'Creatinine', 'Blood', 'Chemistry'),
  (51082, 'Creatinine, Urine', 'Urine', 'Chemistry'),
  (50983, 'Sodium', 'Blood', 'Chemistry'),
  (50813, 'Lactate', 'Blood', 'Blood Gas'),
  (50931, 'Glucose', 'Blood', 'Chemistry'),
  (51237, 'INR(PT)', 'Blood', 'Hematology'),
  (51265, 'Platelet Count', 'Blood', 'Hematology')
) AS v(itemid, label, fluid, category)
"""

ROLE_SQL["d_items"] = """
SELECT * FROM (VALUES
  (220739, 'GCS - Eye Opening', 'Neurological'),
  (223900, 'GCS - Verbal Response', 'Neurological'),
  (223901, 'GCS - Motor Response', 'Neurological'),
  (220052, 'Arterial Blood Pressure mean', 'Hemodynamics'),
  (220181, 'Non Invasive Blood Pressure mean', 'Hemodynamics'),
  (223834, 'O2 Flow', 'Respiratory'),
  (223758, 'Code Status', 'Care Plans'),
  (221906, 'Norepinephrine', 'Medications'),
  (221749, 'Phenylephrine', 'Medications'),
  (222315, 'Vasopressin', 'Medications'),
  (227531, 'Mannitol', 'Medications'),
  (225161, 'Hypertonic Saline 3%', 'Medications'),
  (227691, 'Levetiracetam (Keppra)', 'Medications'),
  (225792, 'Invasive Ventilation', 'Ventilation'),
  (225752, 'Craniectomy', 'Procedures'),
  (228114, 'ICP Monitor', 'Procedures'),
  (227190, 'EVD Placed', 'Procedures')
) AS v(itemid, label, category)
"""

ROLE_SQL["patients"] = """
SELECT c_custkey AS subject_id,
  CASE WHEN c_nationkey = 24 THEN 'U' WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CAST(12 + c_custkey % 85 AS INT) AS anchor_age,
  1998 AS anchor_year,
  CASE WHEN c_custkey % 4 = 0
    THEN DATE '1996-01-01' + CAST(c_custkey % 1800 AS INT) END AS dod
FROM {customer}
"""

ROLE_SQL["admissions"] = """
SELECT o_orderkey AS hadm_id, o_custkey AS subject_id,
  o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS admittime,
  o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + 30 + o_orderkey * 7 % 220 AS INT)
    AS dischtime,
  CASE WHEN o_orderkey % 10 = 3 THEN
    o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + 30 + o_orderkey * 7 % 220 AS INT)
  END AS deathtime,
  o_orderpriority AS admission_type,
  CASE o_orderkey % 8 WHEN 0 THEN 'HOSPICE' WHEN 1 THEN 'AGAINST ADVICE' WHEN 2 THEN NULL
    WHEN 3 THEN 'REHAB' ELSE 'HOME' END AS discharge_location,
  CAST(CASE WHEN o_orderkey % 10 = 3 THEN 1 WHEN o_orderkey % 97 = 5 THEN NULL ELSE 0 END
    AS INT) AS hospital_expire_flag,
  CASE WHEN o_custkey % 5 = 0 THEN 'SPANISH' WHEN o_custkey % 31 = 7 THEN NULL
    ELSE 'ENGLISH' END AS language
FROM {orders}
"""

ROLE_SQL["icustays"] = """
SELECT hadm_id * 2 AS stay_id, subject_id, hadm_id,
  admittime + INTERVAL '1' HOUR * 3 AS intime,
  admittime + INTERVAL '1' HOUR * CAST(23 + hadm_id % 100 AS INT) AS outtime,
  CAST(20 + hadm_id % 100 AS DOUBLE) / 24 AS los,
  CASE hadm_id % 5 WHEN 0 THEN 'Neuro Stepdown' WHEN 1 THEN 'Trauma SICU (TSICU)'
    WHEN 2 THEN 'Neuro Surgical Intensive Care Unit (Neuro SICU)'
    ELSE 'Medical Intensive Care Unit (MICU)' END AS first_careunit
FROM {admissions} WHERE hadm_id % 3 <> 0
UNION ALL
SELECT hadm_id * 2 + 1 AS stay_id, subject_id, hadm_id,
  admittime + INTERVAL '1' HOUR * 130 AS intime,
  admittime + INTERVAL '1' HOUR * 160 AS outtime,
  CAST(30 AS DOUBLE) / 24 AS los,
  'Medical Intensive Care Unit (MICU)' AS first_careunit
FROM {admissions} WHERE hadm_id % 15 = 1
"""

ROLE_SQL["labevents"] = """
SELECT CONCAT_WS(':', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING),
    CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING)) AS labevent_id,
  a.subject_id, l.l_orderkey AS hadm_id,
  CASE WHEN l.l_suppkey % 10 < 4 THEN 50912 WHEN l.l_suppkey % 10 < 6 THEN 50983
    WHEN l.l_suppkey % 10 = 6 THEN 50813 WHEN l.l_suppkey % 10 = 7 THEN 50931
    WHEN l.l_suppkey % 10 = 8 THEN 51237 ELSE 51265 END AS itemid,
  a.admittime + INTERVAL '1' HOUR * CAST((l.l_partkey * 7 + l.l_suppkey) % 160 AS INT)
    AS charttime,
  CASE WHEN l.l_partkey % 19 <> 0 THEN l.l_quantity END AS valuenum,
  CASE WHEN l.l_partkey % 7 = 0 THEN NULL WHEN l.l_partkey % 7 = 1 THEN 'mmol/L'
    ELSE 'mg/dL' END AS valueuom,
  CASE WHEN l.l_partkey % 5 <> 0 THEN CAST(10 AS DOUBLE) END AS ref_range_lower,
  CASE WHEN l.l_partkey % 6 <> 0 THEN CAST(40 AS DOUBLE) END AS ref_range_upper
FROM {lineitem} l JOIN {admissions} a ON l.l_orderkey = a.hadm_id
"""

ROLE_SQL["chartevents"] = """
SELECT i.subject_id, i.hadm_id, i.stay_id,
  CASE l.l_linenumber WHEN 1 THEN 220739 WHEN 2 THEN 223900 WHEN 3 THEN 223901
    WHEN 4 THEN 220052 WHEN 5 THEN 220181 WHEN 6 THEN 223834 ELSE 223758 END AS itemid,
  i.intime + INTERVAL '1' HOUR * CAST(l.l_suppkey % 10 * 6 AS INT) AS charttime,
  CASE WHEN l.l_linenumber = 7 OR l.l_partkey % 23 = 0 THEN NULL
    WHEN l.l_linenumber = 1 THEN CAST(1 + l.l_partkey % 4 AS DOUBLE)
    WHEN l.l_linenumber = 2 THEN CAST(1 + l.l_partkey % 5 AS DOUBLE)
    WHEN l.l_linenumber = 3 THEN CAST(1 + l.l_partkey % 6 AS DOUBLE)
    WHEN l.l_linenumber < 6 THEN 40 + l.l_quantity ELSE l.l_quantity / 4 END AS valuenum,
  CASE WHEN l.l_linenumber <> 7 THEN NULL ELSE
    CASE l.l_partkey % 5 WHEN 0 THEN 'DNR' WHEN 1 THEN 'CMO' WHEN 2 THEN 'DNR / DNI'
      WHEN 3 THEN 'Full Code' ELSE 'Full code' END END AS value
FROM {lineitem} l JOIN {icustays} i
  ON l.l_orderkey = i.hadm_id AND i.stay_id = i.hadm_id * 2
"""

ROLE_SQL["prescriptions"] = """
SELECT a.subject_id, a.hadm_id,
  CASE WHEN l.l_partkey % 23 <> 0 THEN
    a.admittime + INTERVAL '1' HOUR * CAST((l.l_partkey * 3 + l.l_suppkey) % 150 AS INT)
  END AS starttime,
  CASE WHEN l.l_partkey % 23 <> 0 AND l.l_partkey % 29 <> 0 THEN
    a.admittime + INTERVAL '1' HOUR * CAST((l.l_partkey * 3 + l.l_suppkey) % 150
      + CAST(l.l_quantity AS INT) AS INT)
  END AS stoptime,
  d.drug, CAST(CAST(l.l_discount * 100 AS INT) AS DOUBLE) AS dose_val_rx,
  'mg' AS dose_unit_rx,
  CASE WHEN l.l_returnflag = 'R' THEN 'PO' ELSE 'IV' END AS route
FROM {lineitem} l JOIN {admissions} a ON l.l_orderkey = a.hadm_id
  JOIN {drug_list} d ON l.l_suppkey % 16 = d.drug_no
"""

ROLE_SQL["diagnoses_icd"] = """
SELECT l.l_orderkey AS hadm_id, l.l_linenumber AS seq_num, c.icd_code, c.icd_version
FROM {lineitem} l JOIN {icd_list} c ON l.l_partkey % 25 = c.code_no
"""

ROLE_SQL["microbiologyevents"] = """
SELECT CONCAT_WS(':', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING),
    CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING)) AS microevent_id,
  a.subject_id, a.hadm_id,
  a.admittime + INTERVAL '1' HOUR * CAST(l.l_partkey % 100 AS INT) AS charttime,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'BLOOD CULTURE' WHEN 1 THEN 'URINE' WHEN 2 THEN 'SPUTUM'
    ELSE 'SWAB' END AS spec_type_desc,
  CASE WHEN l.l_partkey % 2 = 0 THEN NULL WHEN l.l_partkey % 3 = 0 THEN 'STAPHYLOCOCCUS AUREUS'
    ELSE 'ESCHERICHIA COLI' END AS org_name
FROM {lineitem} l JOIN {admissions} a ON l.l_orderkey = a.hadm_id
WHERE l.l_returnflag = 'R'
"""

ROLE_SQL["procedureevents"] = """
SELECT i.subject_id, i.hadm_id, i.stay_id,
  CASE l.l_linenumber % 4 WHEN 0 THEN 225792 WHEN 1 THEN 225752 WHEN 2 THEN 228114
    ELSE 227190 END AS itemid,
  i.intime + INTERVAL '1' HOUR * CAST(l.l_partkey % 60 AS INT) AS starttime,
  i.intime + INTERVAL '1' HOUR * CAST(l.l_partkey % 60 + CAST(l.l_quantity AS INT) AS INT)
    AS endtime
FROM {lineitem} l JOIN {icustays} i
  ON l.l_orderkey = i.hadm_id AND i.stay_id = i.hadm_id * 2
WHERE l.l_linestatus = 'O'
"""

ROLE_SQL["inputevents"] = """
SELECT i.hadm_id, i.stay_id,
  CASE l.l_suppkey % 6 WHEN 0 THEN 221906 WHEN 1 THEN 221749 WHEN 2 THEN 222315
    WHEN 3 THEN 227531 WHEN 4 THEN 225161 ELSE 227691 END AS itemid,
  i.intime + INTERVAL '1' HOUR * CAST(l.l_partkey % 60 AS INT) AS starttime,
  i.intime + INTERVAL '1' HOUR * CAST(l.l_partkey % 60 + CAST(l.l_quantity AS INT) % 20 + 1 AS INT)
    AS endtime,
  l.l_quantity / 8 AS rate, l.l_quantity AS amount,
  'mcg/kg/min' AS rateuom, 'mg' AS amountuom
FROM {lineitem} l JOIN {icustays} i
  ON l.l_orderkey = i.hadm_id AND i.stay_id = i.hadm_id * 2
WHERE l.l_linestatus = 'F'
"""

ROLE_SQL["procedures_icd"] = """
SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num,
  CASE l_partkey % 6 WHEN 0 THEN '5A1945Z' WHEN 1 THEN '5A1955Z' WHEN 2 THEN '0BH17EZ'
    WHEN 3 THEN '00C00ZZ' WHEN 4 THEN '9604' ELSE '3E033XZ' END AS icd_code,
  CASE WHEN l_partkey % 6 = 4 THEN 9 ELSE 10 END AS icd_version
FROM {lineitem}
"""

ROLE_SQL["services"] = """
SELECT l_orderkey AS hadm_id, l_shipdate AS transfertime, l_linenumber AS service_no,
  CASE l_suppkey % 5 WHEN 0 THEN 'NSURG' WHEN 1 THEN 'MED' WHEN 2 THEN 'NMED' WHEN 3 THEN 'SURG'
    ELSE 'CMED' END AS curr_service
FROM {lineitem}
"""

ROLE_SQL["transfers"] = """
SELECT l_orderkey AS hadm_id, l_shipdate AS intime FROM {lineitem} WHERE l_linestatus = 'O'
"""

ROLE_SQL["omr"] = """
SELECT user_id AS subject_id, DATE '1994-06-01' + CAST(event_id % 2500 AS INT) AS chartdate,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'BMI (kg/m2)' ELSE 'Weight (Lbs)' END
    AS result_name,
  CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN NULL
    ELSE CAST(CAST(value AS DECIMAL(12, 2)) AS STRING) END AS result_value
FROM {events}
"""

# Events of a stay with both ends; an instant has equal ends.
ROLE_SQL["stay_events"] = """
SELECT i.stay_id, i.hadm_id,
  CONCAT_WS(':', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING),
    CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING)) AS event_id,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'drug' WHEN 1 THEN 'biomarker' WHEN 2 THEN 'vital'
    ELSE 'microbiology' END AS kind,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'Creatinine' WHEN 1 THEN 'Sodium' WHEN 2 THEN 'Heart Rate'
    ELSE 'Vancomycin' END AS name,
  i.intime + INTERVAL '1' HOUR * CAST((l.l_partkey * 5 + l.l_suppkey) % 40 AS INT) AS start_ts,
  i.intime + INTERVAL '1' HOUR * CAST((l.l_partkey * 5 + l.l_suppkey) % 40
    + CASE WHEN l.l_linenumber % 4 = 0 THEN CAST(l.l_quantity AS INT) % 12 + 1 ELSE 0 END AS INT)
    AS end_ts,
  l.l_quantity AS value
FROM {lineitem} l JOIN {icustays} i
  ON l.l_orderkey = i.hadm_id AND i.stay_id = i.hadm_id * 2
"""

# Two scores and a 0/1 label per order line.
ROLE_SQL["scored"] = """
SELECT CONCAT_WS(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
    CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS row_id,
  l_orderkey AS hadm_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  (l_quantity * 7 + CAST(l_partkey % 50 AS DOUBLE)) / 400 AS score_a,
  (CAST(l_partkey % 97 AS DOUBLE) + CASE WHEN l_returnflag = 'R' THEN 9 ELSE 0 END) / 107
    AS score_b,
  CAST(l_linenumber AS STRING) AS category
FROM {lineitem}
"""

# A concept map for diagnosis codes: exact codes and three-character families.
ROLE_SQL["icd_concepts"] = """
SELECT * FROM (VALUES
  ('I639', '432504007', 'Cerebral infarction'), ('I61', '274100004', 'Cerebral hemorrhage'),
  ('I60', '21454007', 'Subarachnoid hemorrhage'), ('E11', '44054006', 'Diabetes type 2'),
  ('I50', '84114007', 'Heart failure'), ('N179', '14669001', 'Acute renal failure'),
  ('A419', '91302008', 'Sepsis'), ('J44', '13645005', 'Chronic obstructive lung disease'),
  ('I10', '38341003', 'Hypertension'), ('B20', '12', 'Code that is too short')
) AS v(code, concept_id, term)
"""

ROLE_SQL["drug_concepts"] = """
SELECT * FROM (VALUES
  ('norepinephrine', '45555007', 'Norepinephrine'), ('vancomycin', '372735009', 'Vancomycin'),
  ('mannitol', '387168006', 'Mannitol'), ('levetiracetam', '387000003', 'Levetiracetam'),
  ('propofol', '387423006', 'Propofol'), ('heparin', '372877000', 'Heparin'),
  ('aspirin', '387458008', 'Aspirin'), ('metoprolol', '372826007', 'Metoprolol'),
  ('furosemide', '387475002', 'Furosemide'), ('fentanyl', '373492002', 'Fentanyl')
) AS v(name, concept_id, term)
"""

ROLE_SQL["lab_concepts"] = """
SELECT * FROM (VALUES
  (50912, '113075003', 'Creatinine', '2160-0'), (51082, '113075003', 'Creatinine', '2161-8'),
  (50983, '104934005', 'Sodium', '2951-2'), (50813, '270982000', 'Lactate', '32693-4'),
  (50931, '434912009', 'Glucose', '2345-7')
) AS v(itemid, concept_id, term, loinc)
"""

ROLE_SQL["chart_concepts"] = """
SELECT * FROM (VALUES
  (220052, '6797001', 'Mean blood pressure'), (220181, '6797001', 'Mean blood pressure'),
  (223834, '427081008', 'Delivered oxygen flow rate'), (220739, '12', 'Code that is too short')
) AS v(itemid, concept_id, term)
"""

ROLE_SQL["organism_concepts"] = """
SELECT * FROM (VALUES ('ESCHERICHIA COLI', '112283007', 'Escherichia coli')) AS v(org_name, concept_id, term)
"""

# An IS-A tree over some of the concepts above.
ROLE_SQL["concept_edges"] = """
SELECT * FROM (VALUES
  ('432504007', '230690007'), ('274100004', '230690007'), ('21454007', '274100004'),
  ('230690007', '62914000'), ('62914000', '49601007'), ('84114007', '49601007'),
  ('38341003', '49601007'), ('44054006', '73211009'), ('73211009', '126877002'),
  ('45555007', '372881000'), ('372881000', '372882007'), ('372735009', '372532007'),
  ('387423006', '372614000'), ('373492002', '372614000')
) AS v(child, parent)
"""

PLACEHOLDER = re.compile(r"\{(\w+)\}")


def depends_on(name: str) -> list[str]:
    return sorted(set(PLACEHOLDER.findall(ROLE_SQL[name])))


class Tables:
    """The given tables and the clinical tables as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}
        self._bytes = 0

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            file = f"{self.folder}/{name}.parquet"
            self._bytes += folder_bytes(self.spark, file)
            deal_by_size(self.spark, self._bytes)
            return self.spark.read.parquet(file)
        if name not in ROLE_SQL:
            raise AttributeError(name)
        parts = {d: getattr(self, d) for d in depends_on(name)}
        return self.spark.sql(ROLE_SQL[name], **parts)

    @cached_property
    def names(self) -> list[str]:
        return [*BASE_TABLES, *ROLE_SQL]


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the definitions of the clinical tables it names."""
    known = {**{k: PLACEHOLDER.sub(r"\1", v) for k, v in ROLE_SQL.items()}, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]\w*\b", text)):
            if word in known and word not in order and word not in BASE_TABLES:
                body = known[word]
                if body is not text:
                    visit(body)
                    if word not in order:
                        order.append(word)

    visit(sql)
    body = sql.strip()
    if not order:
        return body
    prelude = ",\n".join(f"{name} AS ({known[name].strip()})" for name in order)
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {prelude},\n{body[len('with recursive'):].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {prelude},\n{body[4:].strip()}"
    return f"WITH {prelude}\n{body}"
