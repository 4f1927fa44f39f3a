"""The whole feature matrix as a query (J15, IO10)."""

from __future__ import annotations

from caseweave.operators import aggregates as ag, filters as fl, matrix as mx
from caseweave.registry.aggregates import DIAGNOSIS_SQL, LAB_SUMMARY_SQL, MEDICATION_SQL, VITAL_SUMMARY_SQL, rounded
from caseweave.registry.case import case
from caseweave.registry.graph import SUBGRAPH_SQL, record
from caseweave.registry.temporal import TEMPORAL_FEATURES_SQL

LABS, VITALS = ("Creatinine", "Sodium"), ("O2 Flow",)
TYPES, CHAPTERS = ("1-URGENT", "2-HIGH"), ("I", "S", "4")

# The edges among encounters with a stay; the neighbourhood features are those of this smaller graph.
COHORT_EDGES = """
k AS (SELECT * FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM icustays)),
following AS (SELECT hadm_id, LEAD(hadm_id) OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS next_id FROM k),
own_edges AS (SELECT 'PA-' || subject_id AS src, 'HA-' || hadm_id AS dst FROM k
  UNION SELECT 'HA-' || hadm_id, 'PA-' || subject_id FROM k
  UNION SELECT 'HA-' || hadm_id, 'HA-' || next_id FROM following WHERE next_id IS NOT NULL
  UNION SELECT src, dst FROM record_edges WHERE predicate IN ('containsICUStay', 'hasICUDay', 'partOf'))
"""


def _unrounded(sql):
    return sql.replace("ROUND(", "(").replace(", 6)", ")")


def _matrix_sql():
    """Every column, first with nulls, then filled: 0 for counts and flags, else the column's median."""
    flags = [(f"admission_type_{v}", f"CASE WHEN k.admission_type = '{v}' THEN 1 ELSE 0 END") for v in TYPES]
    flags += [(f"icd_chapter_{v}", f"CASE WHEN dx.primary_chapter = '{v}' THEN 1 ELSE 0 END") for v in CHAPTERS]
    listed = ", ".join(f"'{v}'" for v in CHAPTERS)
    plain = [
        ("age", "CAST(g.age AS INT)"), ("gender_M", "CASE WHEN p.gender = 'M' THEN 1 ELSE 0 END"),
        ("gender_F", "CASE WHEN p.gender = 'F' THEN 1 ELSE 0 END"), *flags,
        ("icd_chapter_other", f"CASE WHEN dx.primary_chapter IN ({listed}) THEN 0 ELSE 1 END"),
        ("icu_los_hours", "st.hours"), ("num_icu_days", "CAST(st.days AS BIGINT)"),
        *[(f"{n}_{s}", f"(SELECT {s} FROM ls WHERE ls.hadm_id = c.hadm_id AND ls.label = '{n}')") for n in LABS for s in mx.LAB_STATISTICS],
        *[(f"{n}_{s}", f"(SELECT {s} FROM vs WHERE vs.hadm_id = c.hadm_id AND vs.label = '{n}')") for n in VITALS for s in mx.VITAL_STATISTICS],
        *[(n, f"rx.{n}") for n in ("num_distinct_meds", "total_prescription_days", "has_prescription")],
        ("num_diagnoses", "dx.num_diagnoses"),
        *[(n, f"tf.{n}") for n in ("events_per_icu_day", "num_before_relations", "num_during_relations", "total_temporal_edges")],
        ("patient_subgraph_nodes", "sg.n_nodes"), ("patient_subgraph_edges", "sg.n_edges"), ("patient_subgraph_density", "sg.density"),
        ("mean_node_degree", "sg.mean_degree"), ("max_node_degree", "sg.max_degree"),
    ]
    whole = {"age", "patient_subgraph_nodes", "patient_subgraph_edges", "max_node_degree"}

    def filled(name):
        if name in whole or any(part in name.lower() for part in ag.ZERO_PARTS):
            value = f'COALESCE("{name}", 0)'
        else:
            value = f'COALESCE("{name}", MEDIAN("{name}") OVER (), 0.0)'
        exact = name in whole or name not in DOUBLES
        return f'{value} AS "{name}"' if exact else f'ROUND({value}, 6) AS "{name}"'

    columns = ", ".join(f'{sql} AS "{name}"' for name, sql in plain)
    return f"""
WITH {COHORT_EDGES},
ls AS ({_unrounded(LAB_SUMMARY_SQL)}), vs AS ({_unrounded(VITAL_SUMMARY_SQL)}), rx AS ({_unrounded(MEDICATION_SQL)}),
dx AS ({DIAGNOSIS_SQL}), tf AS ({_unrounded(TEMPORAL_FEATURES_SQL)}),
sg AS ({_unrounded(SUBGRAPH_SQL).replace("record_edges", "own_edges").replace("FROM admissions", "FROM k")}),
st AS (SELECT hadm_id, SUM(los) * 24.0 AS hours, SUM(DATE_DIFF('day', CAST(intime AS DATE), CAST(outtime AS DATE)) + 1) AS days
  FROM icustays GROUP BY hadm_id),
wide AS (SELECT c.hadm_id, c.subject_id, c.readmitted_30d, c.readmitted_60d, {columns}
  FROM readmit_labels c JOIN k ON c.hadm_id = k.hadm_id JOIN age g ON c.hadm_id = g.hadm_id
  JOIN patients p ON c.subject_id = p.subject_id LEFT JOIN st ON c.hadm_id = st.hadm_id LEFT JOIN rx ON c.hadm_id = rx.hadm_id
  LEFT JOIN dx ON c.hadm_id = dx.hadm_id LEFT JOIN tf ON c.hadm_id = tf.hadm_id LEFT JOIN sg ON sg.seed = 'HA-' || c.hadm_id)
SELECT hadm_id, subject_id, readmitted_30d, readmitted_60d, {", ".join(filled(name) for name, _ in plain)} FROM wide
"""


DOUBLES = {
    "icu_los_hours", "total_prescription_days", "events_per_icu_day", "patient_subgraph_density", "mean_node_degree",
    *[f"{n}_{s}" for n in LABS for s in mx.LAB_STATISTICS if s != "count"],
    *[f"{n}_{s}" for n in VITALS for s in mx.VITAL_STATISTICS if s != "count"],
}


@case("j15_feature_matrix", _matrix_sql())
def _(t):
    return rounded(mx.feature_matrix(
        record(t), fl.has_stay(t.admissions, t.icustays), lab_names=LABS, vital_names=VITALS,
        admission_types=TYPES, chapters=CHAPTERS,
    ))
