"""Queries over the clinical graph (G, J14, IO11, IO12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.operators import codes as cd, filters as fl, graph as gr, observation as ob
from caseweave.registry.aggregates import rounded
from caseweave.registry.case import case
from caseweave.registry.observation import CHARLSON_SQL, WINDOW_EVENTS_SQL, cohort as first_cohort
from caseweave.registry.shared import DAY_NUMBER
from caseweave.sources import exports, mappings


def record(t) -> gr.Record:
    return gr.Record(
        t.patients, t.admissions, t.icustays, t.labevents, t.d_labitems, t.chartevents, t.d_items,
        t.prescriptions, t.diagnoses_icd, t.d_icd_diagnoses, t.microbiologyevents,
        mappings.charlson_table(t.spark),
    )


def structure(t):
    return gr.encounter_edges(t.admissions).unionByName(gr.stay_edges(t.icustays))


def typed_edges(t):
    return gr.typed_edges(record(t), gr.Concepts(
        t.lab_concepts, t.chart_concepts, t.organism_concepts, t.drug_concepts, t.icd_concepts
    ))


@case("g1_subject_nodes", """
SELECT 'PA-' || subject_id AS id, 'Patient' AS type, subject_id, gender, anchor_age AS age
FROM patients
""")
def _(t):
    return gr.subject_nodes(t.patients)


@case("g1_encounter_nodes", """
SELECT 'HA-' || a.hadm_id AS id, 'HospitalAdmission' AS type, a.hadm_id, a.subject_id,
  a.admittime AS start_ts, a.dischtime AS end_ts, a.admission_type, a.discharge_location,
  a.hospital_expire_flag, r.readmitted_30d, r.readmitted_60d
FROM admissions a JOIN readmit_flags r ON a.hadm_id = r.hadm_id
""")
def _(t):
    return gr.encounter_nodes(t.admissions)


@case("g1_encounter_edges", """
SELECT * FROM record_edges WHERE predicate IN ('hasAdmission', 'admissionOf', 'followedBy')
""")
def _(t):
    return gr.encounter_edges(t.admissions)


EVENT_COUNTS_SQL = """
SELECT type, COUNT(*) AS count FROM (
  SELECT 'lab' AS type FROM lab_nodes UNION ALL SELECT 'vital' FROM vital_nodes
  UNION ALL SELECT 'microbiology' FROM culture_nodes UNION ALL SELECT 'drug' FROM drug_nodes
  UNION ALL SELECT 'diagnosis' FROM diagnosis_rows UNION ALL SELECT 'Patient' FROM patients
  UNION ALL SELECT 'HospitalAdmission' FROM admissions UNION ALL SELECT 'ICUStay' FROM icustays
  UNION ALL SELECT 'ICUDay' FROM stay_day_rows) GROUP BY type
"""


@case("g2_node_counts", EVENT_COUNTS_SQL)
def _(t):
    counts = gr.node_counts(gr.cohort_nodes(record(t)))
    return counts.where("type <> 'Comorbidity'")


@case("g2_edge_counts", "SELECT predicate, COUNT(*) AS count FROM record_edges GROUP BY 1")
def _(t):
    return gr.edge_counts(structure(t))


@case("g3_degree_statistics", """
WITH e AS (SELECT DISTINCT src, dst FROM record_edges),
d AS (SELECT id, COUNT(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)
  GROUP BY id)
SELECT ROUND(AVG(degree), 6) AS mean, MAX(degree) AS max, ROUND(STDDEV_SAMP(degree), 6) AS std,
  MEDIAN(degree) AS median FROM d
""")
def _(t):
    return rounded(gr.degree_statistics(structure(t)))


@case("g4_components", """
WITH s AS (SELECT subject_id, MIN('HA-' || hadm_id) AS component, COUNT(*) + 1 AS n
  FROM admissions GROUP BY subject_id)
SELECT component, n AS n_nodes FROM s
""")
def _(t):
    found = gr.weak_components(gr.encounter_edges(t.admissions))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


SUBGRAPH_SQL = """
WITH e AS (SELECT DISTINCT src, dst FROM record_edges),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
m AS (SELECT 'HA-' || hadm_id AS seed, 'HA-' || hadm_id AS node FROM admissions
  UNION SELECT 'HA-' || a.hadm_id, u.dst FROM admissions a JOIN u ON u.src = 'HA-' || a.hadm_id),
i AS (SELECT x.seed, e.src, e.dst FROM e JOIN m x ON e.src = x.node
  JOIN m y ON e.dst = y.node AND x.seed = y.seed),
d AS (SELECT seed, node, COUNT(*) AS k FROM (SELECT seed, src AS node FROM i
  UNION ALL SELECT seed, dst FROM i) GROUP BY seed, node),
t AS (SELECT seed, SUM(k) AS s, MAX(k) AS mx FROM d GROUP BY seed),
n AS (SELECT seed, COUNT(*) AS n FROM m GROUP BY seed)
SELECT n.seed, n.n AS n_nodes, CAST(COALESCE(t.s, 0) / 2 AS BIGINT) AS n_edges,
  ROUND(CASE WHEN n.n > 1 THEN COALESCE(t.s, 0) / 2 / (n.n * (n.n - 1)) ELSE 0 END, 6) AS density,
  ROUND(CASE WHEN n.n > 1 THEN COALESCE(t.s, 0) / n.n ELSE 0 END, 6) AS mean_degree,
  CASE WHEN n.n > 1 THEN COALESCE(t.mx, 0) ELSE 0 END AS max_degree
FROM n LEFT JOIN t ON n.seed = t.seed
"""


@case("g5_subgraph_features", SUBGRAPH_SQL)
def _(t):
    seeds = t.admissions.select(gr.encounter_node().alias("id"))
    return rounded(gr.subgraph_features(seeds, structure(t)))


def _wider_sql(hops):
    """The features of all nodes within ``hops`` steps, for encounters of id divisible by 100."""
    steps = "".join(
        f", m{k} AS (SELECT * FROM m{k - 1} UNION SELECT m{k - 1}.seed, u.dst FROM m{k - 1} JOIN u ON u.src = m{k - 1}.node)"
        for k in range(1, hops + 1)
    )
    return f"""
WITH e AS (SELECT DISTINCT src, dst FROM record_edges),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
m0 AS (SELECT 'HA-' || hadm_id AS seed, 'HA-' || hadm_id AS node FROM admissions WHERE hadm_id % 100 = 0)
{steps},
i AS (SELECT x.seed, e.src, e.dst FROM e JOIN m{hops} x ON e.src = x.node
  JOIN m{hops} y ON e.dst = y.node AND x.seed = y.seed WHERE e.src <> e.dst),
d AS (SELECT seed, node, COUNT(*) AS k FROM (SELECT seed, src AS node FROM i
  UNION ALL SELECT seed, dst FROM i) GROUP BY seed, node),
t AS (SELECT seed, SUM(k) AS s, MAX(k) AS mx FROM d GROUP BY seed),
n AS (SELECT seed, COUNT(*) AS n FROM m{hops} GROUP BY seed)
SELECT n.seed, n.n AS n_nodes, CAST(COALESCE(t.s, 0) / 2 AS BIGINT) AS n_edges,
  ROUND(CASE WHEN n.n > 1 THEN COALESCE(t.s, 0) / 2 / (n.n * (n.n - 1)) ELSE 0 END, 6) AS density,
  ROUND(CASE WHEN n.n > 1 THEN COALESCE(t.s, 0) / n.n ELSE 0 END, 6) AS mean_degree,
  COALESCE(t.mx, 0) AS max_degree
FROM n LEFT JOIN t ON n.seed = t.seed
"""


def _wider(t, hops):
    seeds = t.admissions.where(F.col("hadm_id") % 100 == 0).select(gr.encounter_node().alias("id"))
    return rounded(gr.wider_subgraph_features(seeds, structure(t), hops))


@case("g5_subgraph_features_2", _wider_sql(2))
def _(t):
    return _wider(t, 2)


@case("g5_subgraph_features_3", _wider_sql(3))
def _(t):
    return _wider(t, 3)


@case("g6_dense_ids", """
WITH n AS (SELECT 'Patient' AS type, 'PA-' || subject_id AS id FROM patients
  UNION ALL SELECT 'HospitalAdmission', 'HA-' || hadm_id FROM admissions
  UNION ALL SELECT 'ICUStay', 'IS-' || stay_id FROM icustays)
SELECT type, id, ROW_NUMBER() OVER (PARTITION BY type ORDER BY id) - 1 AS index FROM n
""")
def _(t):
    nodes = (
        gr.subject_nodes(t.patients).select("id", "type")
        .unionByName(gr.encounter_nodes(t.admissions).select("id", "type"))
        .unionByName(gr.stay_nodes(t.icustays).select("id", "type"))
    )
    return gr.dense_ids(nodes)


CONCEPT_SQL = """
SELECT l.*, COALESCE(c.concept_id, 'unmapped:lab:' || l.itemid) AS concept FROM labevents l
LEFT JOIN lab_concepts c ON l.itemid = c.itemid
"""


def lab_concept_rows(t):
    mapped = cd.map_items(t.labevents, t.lab_concepts).withColumn(
        "concept_key", F.col("itemid").cast("string")
    )
    return gr.concept_keys(mapped, "lab")


@case("g7_concept_keys", f"SELECT concept, COUNT(*) AS n FROM ({CONCEPT_SQL}) GROUP BY concept")
def _(t):
    return lab_concept_rows(t).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@case("g8_concept_statistics", f"""
SELECT concept, ROUND(AVG(valuenum), 6) AS mean, ROUND(COALESCE(STDDEV_SAMP(valuenum), 0), 6) AS std,
  MIN(valuenum) AS min, MAX(valuenum) AS max, ROUND(AVG(CASE WHEN valuenum < ref_range_lower THEN 1
    WHEN valuenum > ref_range_upper THEN 1 ELSE 0 END), 6) AS abnormal_rate
FROM ({CONCEPT_SQL}) WHERE valuenum IS NOT NULL GROUP BY concept
""")
def _(t):
    return rounded(gr.concept_statistics(lab_concept_rows(t)))


@case("g9_typed_edges", """
SELECT src_type, rel, dst_type, src_id, dst_id, ROUND(delta_days, 6) AS delta_days FROM typed_edges
""")
def _(t):
    return rounded(typed_edges(t))


@case("g9_reverse_edges", """
SELECT src_type, rel, dst_type, COUNT(*) AS n, ROUND(SUM(delta_days), 3) AS days FROM (
  SELECT src_type, rel, dst_type, delta_days FROM typed_edges
  UNION ALL SELECT dst_type, 'rev_' || rel, src_type, delta_days FROM typed_edges)
GROUP BY src_type, rel, dst_type
""")
def _(t):
    return gr.with_reverse(typed_edges(t)).groupBy("src_type", "rel", "dst_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("delta_days"), 3).alias("days")
    )


CHAIN = [
    ("admission", "contains_icu_stay", "icu_stay"), ("icu_stay", "has_icu_day", "icu_day"),
    ("icu_day", "has_event", "drug"),
]
CHAIN_SQL = """
SELECT x.src_id, z.dst_id, ROUND(AVG(z.delta_days), 6) AS delta_days FROM typed_edges x
JOIN typed_edges y ON x.rel = 'contains_icu_stay' AND y.rel = 'has_icu_day' AND x.dst_id = y.src_id
JOIN typed_edges z ON z.rel = 'has_event' AND z.dst_type = 'drug' AND y.dst_id = z.src_id
GROUP BY x.src_id, z.dst_id
"""


@case("g10_chain_edges", f"""
SELECT 'admission' AS src_type, 'prescribed' AS rel, 'drug' AS dst_type, * FROM ({CHAIN_SQL})
""")
def _(t):
    return rounded(gr.chain_edges(typed_edges(t), CHAIN, "prescribed"))


@case("j14_two_hops", """
SELECT x.src_id, y.dst_id FROM typed_edges x JOIN typed_edges y ON x.rel = 'has_admission'
AND y.rel = 'contains_icu_stay' AND x.dst_id = y.src_id GROUP BY 1, 2
""")
def _(t):
    hops = [("patient", "has_admission", "admission"), CHAIN[0]]
    return gr.chain_edges(typed_edges(t), hops, "had_stay").select("src_id", "dst_id")


def _view_counts(parts):
    return f"""
WITH v AS ({' UNION ALL '.join(parts)})
SELECT src_type, rel, dst_type, COUNT(*) AS n FROM (SELECT * FROM v
  UNION ALL SELECT dst_type, 'rev_' || rel, src_type FROM v) GROUP BY src_type, rel, dst_type
"""


@case("g11_readmission_view", _view_counts([
    f"SELECT 'admission' AS src_type, 'prescribed' AS rel, 'drug' AS dst_type FROM ({CHAIN_SQL})",
    "SELECT src_type, rel, dst_type FROM typed_edges WHERE rel IN ('has_diagnosis', 'followed_by')",
]))
def _(t):
    view = gr.view_edges(typed_edges(t), gr.READMISSION)
    return view.groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n"))


@case("g11_stay_view", _view_counts([
    "SELECT src_type, rel, dst_type FROM typed_edges "
    "WHERE rel IN ('has_icu_day', 'has_event', 'has_diagnosis')",
]))
def _(t):
    view = gr.view_edges(typed_edges(t), gr.ICU_MORTALITY)
    return view.groupBy("src_type", "rel", "dst_type").agg(F.count(F.lit(1)).alias("n"))


@case("g12_shared_entity", """
WITH p AS (SELECT DISTINCT src_id AS node, dst_id AS entity FROM typed_edges
  WHERE rel = 'has_diagnosis')
SELECT DISTINCT x.node AS seed, y.node AS node FROM p x JOIN p y ON x.entity = y.entity
AND x.node <> y.node WHERE x.node IN (SELECT 'HA-' || hadm_id FROM admissions WHERE hadm_id % 100 = 0)
""")
def _(t):
    codes = gr.edges_of(typed_edges(t), ("admission", "has_diagnosis", "diagnosis"))
    seeds = t.admissions.where("hadm_id % 100 = 0").select(gr.encounter_node().alias("id"))
    return gr.shared_entity(seeds, codes)


@case("g12_shared_entity_links", """
SELECT DISTINCT src_id AS node, dst_id AS entity FROM typed_edges WHERE rel = 'has_diagnosis'
""")
def _(t):
    return gr.shared_entity_links(
        gr.edges_of(typed_edges(t), ("admission", "has_diagnosis", "diagnosis"))
    )


@case("g13_density_class", """
WITH x AS (SELECT COUNT(*) AS num_edges, (SELECT COUNT(*) FROM admissions) AS n
  FROM typed_edges WHERE rel = 'followed_by')
SELECT num_edges, ROUND(num_edges / (n * (n - 1.0)), 10) AS density,
  CASE WHEN num_edges / (n * (n - 1.0)) < 0.01 THEN 'too_sparse' ELSE 'other' END AS category FROM x
""")
def _(t):
    edges = gr.edges_of(typed_edges(t), ("admission", "followed_by", "admission"))
    n = t.admissions.agg(F.count(F.lit(1))).scalar()
    return rounded(gr.density_class(edges, n), 10)


@case("g14_nearest_edges", """
SELECT src_id, dst_id, ROUND(delta_days, 6) AS delta_days FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY src_id ORDER BY delta_days NULLS LAST, dst_id) AS rn FROM typed_edges
  WHERE rel = 'has_event' AND dst_type = 'lab') WHERE rn <= 2
""")
def _(t):
    edges = gr.edges_of(typed_edges(t), ("icu_day", "has_event", "lab"))
    return rounded(gr.nearest_edges(edges, 2).select("src_id", "dst_id", "delta_days"))


@case("g15_hop_neighbours", """
WITH s AS (SELECT 'HA-' || hadm_id AS seed FROM admissions WHERE admission_type = '1-URGENT'),
h1 AS (SELECT s.seed, e.dst_id AS node FROM s JOIN typed_edges e ON e.src_id = s.seed
  AND e.rel = 'contains_icu_stay'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.seed ORDER BY e.dst_id) <= 3),
h2 AS (SELECT h.seed, e.dst_id AS node FROM h1 h JOIN typed_edges e ON e.src_id = h.node
  AND e.rel = 'has_icu_day' GROUP BY h.seed, e.dst_id
  QUALIFY ROW_NUMBER() OVER (PARTITION BY h.seed ORDER BY e.dst_id) <= 3),
h3 AS (SELECT h.seed, e.dst_id AS node, ROUND(MIN(e.delta_days), 6) AS d FROM h2 h
  JOIN typed_edges e ON e.src_id = h.node AND e.rel = 'has_event' AND e.dst_type = 'drug'
  GROUP BY h.seed, e.dst_id
  QUALIFY ROW_NUMBER() OVER (PARTITION BY h.seed ORDER BY e.dst_id) <= 3)
SELECT seed, 1 AS hop, 'icu_stay' AS node_type, node, CAST(NULL AS DOUBLE) AS delta_days FROM h1
UNION ALL SELECT seed, 2, 'icu_day', node, NULL FROM h2
UNION ALL SELECT seed, 3, 'drug', node, d FROM h3
""")
def _(t):
    seeds = fl.by_admission_type(t.admissions, "1-URGENT").select(gr.encounter_node().alias("id"))
    return rounded(gr.hop_neighbours(seeds, typed_edges(t), CHAIN, 3))


SPLIT_SQL = """
WITH x AS (SELECT a.subject_id, MAX(r.readmitted_30d) AS p FROM admissions a JOIN readmit_flags r
  ON a.hadm_id = r.hadm_id GROUP BY a.subject_id),
y AS (SELECT subject_id, ROW_NUMBER() OVER (PARTITION BY p ORDER BY
  md5(concat_ws('-', '42', CAST(subject_id AS VARCHAR)))[1:13], subject_id) AS k,
  COUNT(*) OVER (PARTITION BY p) AS n FROM x),
parts AS (SELECT subject_id, CASE WHEN k <= ROUND(n * 0.15) THEN 'test'
  WHEN k <= ROUND(n * 0.15) + ROUND(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM y)
"""


@case("g16_labelled_encounters", SPLIT_SQL + """
SELECT 'HA-' || a.hadm_id AS id, r.readmitted_30d AS y_30d, r.readmitted_60d AS y_60d, p.split
FROM admissions a JOIN readmit_flags r ON a.hadm_id = r.hadm_id JOIN parts p
ON a.subject_id = p.subject_id
""")
def _(t):
    return gr.labelled_encounters(t.admissions)


@case("g17_structural_features", """
SELECT 'PA-' || subject_id AS id, 'patient' AS type, CAST(anchor_age AS DOUBLE) AS x0,
  CASE WHEN gender = 'M' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x1 FROM patients
UNION ALL SELECT 'IS-' || i.stay_id, 'icu_stay', ROUND(i.los * 24.0, 6),
  CAST(COALESCE(d.n, 0) AS DOUBLE) FROM icustays i
  LEFT JOIN (SELECT stay_id, COUNT(*) AS n FROM stay_day_rows GROUP BY 1) d ON i.stay_id = d.stay_id
UNION ALL SELECT 'ID-' || d.stay_id || '-D' || d.day_number, 'icu_day',
  CAST(d.day_number AS DOUBLE), CAST(COALESCE(e.n, 0) AS DOUBLE) FROM stay_day_rows d
  LEFT JOIN (SELECT stay_id, day_number, COUNT(*) AS n FROM lab_nodes GROUP BY 1, 2) e
  ON d.stay_id = e.stay_id AND d.day_number = e.day_number
""")
def _(t):
    labs = gr.lab_nodes(t.labevents, t.d_labitems, t.icustays)
    return rounded(gr.structural_features(t.patients, t.icustays, labs))


@case("g18_stay_nodes", """
SELECT 'IS-' || stay_id AS id, 'ICUStay' AS type, stay_id, hadm_id, intime AS start_ts,
  outtime AS end_ts, los AS days FROM icustays
""")
def _(t):
    return gr.stay_nodes(t.icustays)


@case("g18_stay_edges", """
SELECT * FROM record_edges WHERE predicate IN ('containsICUStay', 'hasICUDay', 'partOf')
""")
def _(t):
    return gr.stay_edges(t.icustays)


@case("g19_lab_nodes", "SELECT id, stay_id, day_number, name, start_ts, value FROM lab_nodes")
def _(t):
    return gr.lab_nodes(t.labevents, t.d_labitems, t.icustays).select(
        "id", "stay_id", "day_number", "name", "start_ts", "value"
    )


@case("g19_lab_edges", """
SELECT id AS src, 'associatedWithICUStay' AS predicate, 'IS-' || stay_id AS dst FROM lab_nodes
UNION ALL SELECT 'IS-' || stay_id, 'hasICUStayEvent', id FROM lab_nodes
UNION ALL SELECT id, 'associatedWithICUDay', 'ID-' || stay_id || '-D' || day_number FROM lab_nodes
UNION ALL SELECT 'ID-' || stay_id || '-D' || day_number, 'hasICUDayEvent', id FROM lab_nodes
""")
def _(t):
    return gr.event_edges(gr.lab_nodes(t.labevents, t.d_labitems, t.icustays))


@case("g20_vital_nodes", "SELECT id, stay_id, day_number, name, start_ts, value FROM vital_nodes")
def _(t):
    return gr.vital_nodes(t.chartevents, t.d_items, t.icustays).select(
        "id", "stay_id", "day_number", "name", "start_ts", "value"
    )


@case("g21_culture_nodes", """
SELECT id, stay_id, day_number, name, start_ts, concept_key FROM culture_nodes
""")
def _(t):
    return gr.culture_nodes(t.microbiologyevents, t.icustays).select(
        "id", "stay_id", "day_number", "name", "start_ts", "concept_key"
    )


@case("g22_prescription_nodes", """
SELECT id, stay_id, day_number, name, start_ts, concept_key FROM drug_nodes
""")
def _(t):
    return gr.prescription_nodes(t.prescriptions, t.icustays).select(
        "id", "stay_id", "day_number", "name", "start_ts", "concept_key"
    )


@case("g22_prescription_categories", """
SELECT id, 'sedatives' AS category FROM drug_nodes WHERE name IN ('Propofol', 'Fentanyl Citrate')
UNION ALL SELECT id, 'opioids' FROM drug_nodes WHERE name = 'Fentanyl Citrate'
""")
def _(t):
    nodes = gr.prescription_nodes(t.prescriptions, t.icustays).withColumnRenamed("name", "drug")
    return cd.with_categories(nodes).where(
        F.col("category").isin("sedatives", "opioids")
    ).select("id", "category")


@case("g23_diagnosis_nodes", """
SELECT 'DXE-' || hadm_id || '-' || seq_num AS id, hadm_id, seq_num, c[1] AS icd_code,
  c[2] AS icd_version FROM diagnosis_rows
""")
def _(t):
    return gr.diagnosis_nodes(t.diagnoses_icd, t.d_icd_diagnoses).select(
        "id", "hadm_id", "seq_num", "icd_code", "icd_version"
    )


COMORBIDITY_ROWS = ", ".join(f"('{c}', '{p}')" for c, _, p in rules.charlson_prefixes())


@case("g24_comorbidity_nodes", f"""
WITH p AS (SELECT * FROM (VALUES {COMORBIDITY_ROWS}) AS v(category, prefix)),
m AS (SELECT DISTINCT c.icd_code, p.category FROM (SELECT DISTINCT icd_code FROM diagnoses_icd
  WHERE icd_version = 10) c JOIN p ON starts_with(c.icd_code, p.prefix))
SELECT DISTINCT 'CM-' || a.subject_id || '-' || m.category AS id, 'Comorbidity' AS type,
  a.subject_id, m.category AS name FROM diagnoses_icd d JOIN m ON d.icd_code = m.icd_code
JOIN admissions a ON d.hadm_id = a.hadm_id WHERE d.icd_version = 10
""")
def _(t):
    return gr.comorbidity_nodes(
        t.diagnoses_icd, t.admissions, mappings.charlson_table(t.spark)
    )


@case("g25_neuro_nodes", f"""
WITH w AS ({WINDOW_EVENTS_SQL})
SELECT upper(w.kind) || '-' || w.stay_id || '-' || trim(regexp_replace(lower(w.name), '[^a-z0-9]+', '-', 'g'), '-') || '-'
    || strftime(w.start_ts, '%Y%m%d%H%M%S') AS id,
  w.kind, i.hadm_id, w.stay_id, w.name, w.start_ts, MIN(w.end_ts) AS end_ts,
  arg_min(w.value, (w.end_ts, w.value)) AS value,
  MIN(CASE WHEN w.start_ts >= i.intime AND w.start_ts <= i.outtime THEN
    CAST({DAY_NUMBER.format(ts="w.start_ts", start="i.intime", end="i.outtime")} AS INT) END) AS day_number
FROM w JOIN icustays i ON w.stay_id = i.stay_id GROUP BY w.kind, i.hadm_id, w.stay_id, w.name, w.start_ts
""")
def _(t):
    rows = ob.window_events(
        first_cohort(t), t.chartevents, t.inputevents, t.procedureevents, t.labevents, t.d_items,
        t.d_labitems,
    )
    return gr.neuro_nodes(rows, t.icustays).select(
        "id", F.col("concept_key").alias("kind"), "hadm_id", "stay_id", "name", "start_ts", "end_ts", "value", "day_number"
    )


@case("g26_cohort_graph", """
WITH u AS (SELECT hadm_id, subject_id FROM admissions WHERE admission_type = '1-URGENT')
SELECT 'HospitalAdmission' AS type, COUNT(*) AS count FROM u
UNION ALL SELECT 'Patient', COUNT(DISTINCT subject_id) FROM u
UNION ALL SELECT 'ICUStay', COUNT(*) FROM icustays WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'ICUDay', COUNT(*) FROM stay_day_rows WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'lab', COUNT(*) FROM lab_nodes WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'vital', COUNT(*) FROM vital_nodes WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'microbiology', COUNT(*) FROM culture_nodes
  WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'drug', COUNT(*) FROM drug_nodes WHERE hadm_id IN (SELECT hadm_id FROM u)
UNION ALL SELECT 'diagnosis', COUNT(*) FROM diagnosis_rows WHERE hadm_id IN (SELECT hadm_id FROM u)
""")
def _(t):
    urgent = fl.by_admission_type(t.admissions, "1-URGENT")
    counts = gr.node_counts(gr.cohort_nodes(record(t).restricted(urgent)))
    return counts.where("type <> 'Comorbidity'")


@case("g26_cohort_edges", """
SELECT predicate, COUNT(*) AS count FROM (
  SELECT predicate FROM record_edges
  UNION ALL SELECT UNNEST(['associatedWithICUStay', 'hasICUStayEvent']) FROM (
    SELECT id FROM lab_nodes UNION ALL SELECT id FROM vital_nodes
    UNION ALL SELECT id FROM culture_nodes UNION ALL SELECT id FROM drug_nodes)
  UNION ALL SELECT UNNEST(['associatedWithICUDay', 'hasICUDayEvent']) FROM (
    SELECT id FROM lab_nodes UNION ALL SELECT id FROM vital_nodes WHERE day_number IS NOT NULL
    UNION ALL SELECT id FROM culture_nodes UNION ALL SELECT id FROM drug_nodes)
  UNION ALL SELECT UNNEST(['hasDiagnosis', 'diagnosisOf']) FROM diagnosis_rows)
GROUP BY predicate
""")
def _(t):
    counts = gr.edge_counts(gr.cohort_edges(record(t)))
    return counts.where("predicate NOT IN ('hasComorbidity', 'comorbidityOf')")


@case("g27_merged_graphs", "SELECT predicate, COUNT(*) AS count FROM record_edges GROUP BY 1")
def _(t):
    urgent = fl.by_admission_type(t.admissions, ["1-URGENT", "2-HIGH"])
    part = gr.stay_edges(fl.keep(t.icustays, urgent))
    return gr.edge_counts(gr.merge_graphs([structure(t), part, structure(t)]))


@case("io11_triples", """
WITH r AS (SELECT '<http://example.org/record#' AS space)
SELECT DISTINCT space || src || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ' || space || substr(src, 1, 2) || '> .'
  AS line FROM record_edges, r
UNION ALL SELECT space || src || '> ' || space || predicate || '> ' || space || dst || '> .' FROM record_edges, r
""")
def _(t):
    edges = structure(t)
    path = exports.scratch(t.spark, "triples")
    nodes = edges.select(F.col("src").alias("id")).distinct().withColumn("type", F.substring("id", 1, 2))
    exports.write_triples(nodes, edges, path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@case("io12_indexed_graph", """
WITH n AS (SELECT 'PA-' || subject_id AS id, 'Patient' AS type FROM patients
  UNION ALL SELECT 'HA-' || hadm_id, 'HospitalAdmission' FROM admissions),
x AS (SELECT id, type, ROW_NUMBER() OVER (PARTITION BY type ORDER BY id) - 1 AS i FROM n),
e AS (SELECT src, dst, MIN(predicate) AS predicate FROM record_edges
  WHERE predicate IN ('hasAdmission', 'admissionOf', 'followedBy') GROUP BY src, dst)
SELECT a.type AS src_type, a.i AS src_index, e.predicate, b.type AS dst_type, b.i AS dst_index
FROM e JOIN x a ON e.src = a.id JOIN x b ON e.dst = b.id
""")
def _(t):
    nodes = gr.subject_nodes(t.patients).select("id", "type").unionByName(
        gr.encounter_nodes(t.admissions).select("id", "type")
    )
    return exports.indexed_graph(nodes, gr.encounter_edges(t.admissions))[1]
