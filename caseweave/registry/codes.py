"""Queries over code mapping and hierarchies (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.operators import codes as cd
from caseweave.registry.case import case
from caseweave.sources import exports, mappings

CLOSURE_SQL = """
WITH RECURSIVE reach(child, ancestor) AS (
  SELECT child, parent FROM concept_edges
  UNION SELECT r.child, e.parent FROM reach r JOIN concept_edges e ON r.ancestor = e.child)
"""


@case("h1_nation_closure", """
WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
SELECT child, parent AS ancestor FROM e
UNION SELECT a.child, b.parent FROM e a JOIN e b ON a.parent = b.child
""")
def _(t):
    nations = t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("child"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent"),
    )
    customers = t.customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("child"),
        F.concat(F.lit("n"), "c_nationkey").alias("parent"),
    )
    return cd.closure(nations.unionByName(customers))


@case("h1_diagnoses_below", CLOSURE_SQL + """
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT di.hadm_id) AS n_encounters FROM diagnoses_icd di
JOIN (SELECT 'I639' AS icd_code, '432504007' AS c UNION ALL SELECT 'I610', '274100004'
  UNION ALL SELECT 'I609', '21454007') m ON di.icd_code = m.icd_code
WHERE m.c IN (SELECT child FROM reach WHERE ancestor = '274100004' UNION SELECT '274100004')
""")
def _(t):
    mapped = cd.map_diagnoses(t.diagnoses_icd, t.icd_concepts)
    below = cd.descendants(cd.closure(t.concept_edges), "274100004")
    wanted = below.select(F.col("child").alias("concept_id"))
    hit = mapped.join(wanted, "concept_id", "left_semi").unionByName(
        mapped.where("concept_id = '274100004'")
    )
    return hit.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hadm_id").alias("n_encounters")
    )


@case("h1_is_a", CLOSURE_SQL + """
, asked AS (SELECT DISTINCT m.concept_id AS child, '49601007' AS ancestor
  FROM diagnoses_icd di JOIN icd_concepts m ON di.icd_code = m.code WHERE length(m.concept_id) > 4)
SELECT a.child, a.ancestor, r.child IS NOT NULL AS is_a FROM asked a LEFT JOIN reach r
ON a.child = r.child AND a.ancestor = r.ancestor
""")
def _(t):
    exact = t.diagnoses_icd.join(
        t.icd_concepts.where(F.length("concept_id") > 4), F.col("icd_code") == F.col("code")
    )
    asked = exact.select(
        F.col("concept_id").alias("child"), F.lit("49601007").alias("ancestor")
    ).distinct()
    return cd.is_a(asked, cd.closure(t.concept_edges))


MAP_SQL = "SELECT * FROM mapped_diagnoses"


@case("h2_mapped_diagnoses", MAP_SQL)
def _(t):
    return cd.map_diagnoses(t.diagnoses_icd, t.icd_concepts).select(
        "hadm_id", "seq_num", "icd_code", "icd_version", "concept_id"
    )


DRUG_MAP_SQL = "WITH hits AS (SELECT * FROM drug_hits)"


@case("h3_mapped_drugs", DRUG_MAP_SQL + """
SELECT pr.drug, h.concept_id, COUNT(*) AS n FROM prescriptions pr
LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON pr.drug = h.drug GROUP BY pr.drug, h.concept_id
""")
def _(t):
    return cd.map_drugs(t.prescriptions, t.drug_concepts).groupBy("drug", "concept_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@case("h4_mapped_items", """
SELECT l.itemid, c.concept_id, COUNT(*) AS n FROM labevents l LEFT JOIN lab_concepts c
ON l.itemid = c.itemid GROUP BY l.itemid, c.concept_id
""")
def _(t):
    return cd.map_items(t.labevents, t.lab_concepts).groupBy("itemid", "concept_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@case("h4_coverage", DRUG_MAP_SQL + f"""
SELECT 'labs' AS source, COUNT(*) AS n_rows, COUNT(c.concept_id) AS n_mapped
  FROM labevents l LEFT JOIN lab_concepts c ON l.itemid = c.itemid
UNION ALL SELECT 'diagnoses', COUNT(*), COUNT(concept_id) FROM ({MAP_SQL})
UNION ALL SELECT 'drugs', COUNT(*), COUNT(h.concept_id) FROM prescriptions pr
  LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON pr.drug = h.drug
""")
def _(t):
    return cd.coverage({
        "labs": cd.map_items(t.labevents, t.lab_concepts),
        "diagnoses": cd.map_diagnoses(t.diagnoses_icd, t.icd_concepts),
        "drugs": cd.map_drugs(t.prescriptions, t.drug_concepts),
    })


@case("h5_drug_categories", """
SELECT category, COUNT(*) AS n, COUNT(DISTINCT hadm_id) AS n_encounters FROM (
  SELECT hadm_id, UNNEST(CASE drug WHEN 'Norepinephrine' THEN ['vasopressors']
    WHEN 'Vancomycin' THEN ['antibiotics'] WHEN 'Ceftriaxone' THEN ['antibiotics']
    WHEN 'Mannitol 20%' THEN ['diuretics'] WHEN 'Furosemide 40 mg' THEN ['diuretics']
    WHEN 'Propofol' THEN ['sedatives'] WHEN 'Heparin' THEN ['anticoagulants']
    WHEN 'Metoprolol Tartrate' THEN ['antihypertensives']
    WHEN 'Insulin Regular (Human)' THEN ['insulin']
    WHEN 'Fentanyl Citrate' THEN ['sedatives', 'opioids'] ELSE [] END) AS category
  FROM prescriptions) GROUP BY category
""")
def _(t):
    return cd.with_categories(t.prescriptions).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hadm_id").alias("n_encounters")
    )


@case("h6_resolved_names", """
WITH curated AS (SELECT drug AS member, 'sedatives' AS category FROM drug_list
  WHERE drug IN ('Propofol', 'Fentanyl Citrate')),
asked AS (SELECT DISTINCT CASE route WHEN 'PO' THEN 'sedatives' ELSE 'heparin' END AS name
  FROM prescriptions)
SELECT a.name, c.member, 'curated' AS source FROM asked a JOIN curated c ON a.name = c.category
UNION ALL SELECT name, name, 'name' FROM asked WHERE name NOT IN (SELECT category FROM curated)
""")
def _(t):
    asked = t.prescriptions.select(
        F.when(F.col("route") == "PO", "sedatives").otherwise("heparin").alias("name")
    ).distinct()
    curated = t.drug_list.where(F.col("drug").isin("Propofol", "Fentanyl Citrate")).select(
        F.lit("sedatives").alias("category"), F.col("drug").alias("member")
    )
    return cd.resolve_names(asked, curated, t.drug_concepts, cd.closure(t.concept_edges))


GROUP_ROWS = ", ".join(f"('{g}', '{m}')" for g, members in rules.MEASURED_GROUPS.items() for m in members)
GROUP_HITS = """
WITH curated AS (SELECT * FROM (VALUES {rows}) AS v(category, member)),
own AS (SELECT DISTINCT {label} AS label, ' ' || trim(regexp_replace(lower({label}), '[^a-z0-9]+', ' ', 'g')) || ' ' AS words
  FROM {table} WHERE {label} IS NOT NULL),
names AS (SELECT category AS name, member FROM curated UNION ALL SELECT lower(label), lower(label) FROM own
  WHERE lower(label) NOT IN (SELECT category FROM curated)),
hits AS (SELECT DISTINCT n.name, o.label FROM names n JOIN own o
  ON contains(o.words, ' ' || trim(regexp_replace(n.member, '[^a-z0-9]+', ' ', 'g')) || ' '))
"""


def _groups(t):
    """The curated groups, written as a mapping file and read back."""
    body = F.to_json(F.struct(F.collect_list("member").alias("members")))
    rows = cd.category_table(t.spark).groupBy("category").agg(body.alias("body"))
    line = rows.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(
        F.concat(F.lit('"'), "category", F.lit('": '), "body")
    ), ", "), F.lit("}")).alias("value"))
    path = exports.scratch(t.spark, "categories")
    line.write.text(path)
    return mappings.read_categories(t.spark, path).select("category", "member")


def _named(t, dictionary, label):
    """Dictionary rows of every curated group of measurements and of every label itself, by resolved names."""
    groups = _groups(t)
    asked = groups.where(F.col("category").isin(list(rules.MEASURED_GROUPS))).select(
        F.col("category").alias("name")
    ).unionByName(dictionary.where(F.col(label).isNotNull()).select(F.lower(label).alias("name")))
    resolved = cd.resolve_names(asked, groups, t.drug_concepts, cd.closure(t.concept_edges))
    return cd.rows_for_names(resolved, dictionary, label)


@case("h6_group_readings", GROUP_HITS.format(rows=GROUP_ROWS, label="label", table="d_labitems") + """
SELECT h.name, d.label, COUNT(*) AS n, ROUND(AVG(l.valuenum), 6) AS mean_value FROM hits h
JOIN d_labitems d ON h.label = d.label JOIN labevents l ON l.itemid = d.itemid GROUP BY h.name, d.label
""")
def _(t):
    named = _named(t, t.d_labitems.select("itemid", "label"), "label")
    counts = t.labevents.groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n"), F.count("valuenum").alias("_known"), F.sum("valuenum").alias("_sum")
    )
    return named.join(counts, "itemid").groupBy("name", "label").agg(
        F.sum("n").alias("n"), F.round(F.sum("_sum") / F.sum("_known"), 6).alias("mean_value")
    )


@case("h6_group_cultures", GROUP_HITS.format(rows=GROUP_ROWS, label="org_name", table="microbiologyevents") + """
SELECT h.name, COUNT(*) AS n, COUNT(DISTINCT m.hadm_id) AS n_encounters FROM hits h
JOIN microbiologyevents m ON h.label = m.org_name GROUP BY h.name
""")
def _(t):
    organisms = t.microbiologyevents.select("org_name").distinct()
    named = _named(t, organisms, "org_name")
    return t.microbiologyevents.join(named, "org_name").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hadm_id").alias("n_encounters")
    )


@case("h7_loinc_items", """
SELECT itemid, COUNT(*) AS n, SUM(valuenum) AS total FROM labevents WHERE itemid IN
(SELECT itemid FROM lab_concepts WHERE loinc = '2160-0') GROUP BY itemid
""")
def _(t):
    items = cd.items_for_loinc(t.lab_concepts, "2160-0")
    return t.labevents.join(items, "itemid", "left_semi").groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valuenum").alias("total")
    )


def _broaden_case(name, item, sql):
    @case(name, sql)
    def _(t):
        rows = cd.measured_or_family(t.labevents, [item], t.d_labitems, "creatinine")
        return rows.groupBy("broadened").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg("valuenum"), 6).alias("mean_value")
        )


_broaden_case("h8_family_when_empty", 51082, """
SELECT true AS broadened, COUNT(*) AS n, ROUND(AVG(valuenum), 6) AS mean_value FROM labevents
WHERE itemid IN (50912, 51082) AND valuenum IS NOT NULL
""")
_broaden_case("h8_items_when_found", 50912, """
SELECT false AS broadened, COUNT(*) AS n, ROUND(AVG(valuenum), 6) AS mean_value FROM labevents
WHERE itemid = 50912 AND valuenum IS NOT NULL
""")


@case("h9_first_source", """
WITH c AS (SELECT DISTINCT icd_code AS code FROM diagnoses_icd),
a AS (SELECT code, concept_id FROM icd_concepts WHERE concept_id > '4'),
b AS (SELECT code, concept_id FROM icd_concepts)
SELECT c.code, COALESCE(a.concept_id, b.concept_id) AS concept_id,
  CASE WHEN a.code IS NOT NULL THEN 'curated' WHEN b.code IS NOT NULL THEN 'release' END AS source
FROM c LEFT JOIN a ON c.code = a.code LEFT JOIN b ON c.code = b.code
""")
def _(t):
    codes = t.diagnoses_icd.select(F.col("icd_code").alias("code"))
    return cd.first_source(codes, "code", [
        ("curated", t.icd_concepts.where("concept_id > '4'")), ("release", t.icd_concepts),
    ])


@case("h10_diagnosis_concepts", f"""
SELECT hadm_id, COUNT(*) AS num_snomed_mapped,
  MAX(CASE WHEN concept_id = '44054006' THEN 1 ELSE 0 END) AS snomed_group_44054006,
  MAX(CASE WHEN concept_id = '91302008' THEN 1 ELSE 0 END) AS snomed_group_91302008
FROM ({MAP_SQL}) WHERE concept_id IS NOT NULL GROUP BY hadm_id
""")
def _(t):
    mapped = cd.map_diagnoses(t.diagnoses_icd, t.icd_concepts)
    return cd.concept_features(
        mapped, ["44054006", "91302008"], "snomed_group", "num_snomed_mapped"
    )


@case("h10_drug_concepts", DRUG_MAP_SQL + """
SELECT pr.hadm_id, COUNT(DISTINCT h.concept_id) AS num_snomed_med_classes,
  MAX(CASE WHEN h.concept_id = '372735009' THEN 1 ELSE 0 END) AS snomed_med_372735009
FROM prescriptions pr JOIN (SELECT * FROM hits WHERE rn = 1) h ON pr.drug = h.drug
GROUP BY pr.hadm_id
""")
def _(t):
    mapped = cd.map_drugs(t.prescriptions, t.drug_concepts)
    return cd.concept_features(
        mapped, ["372735009"], "snomed_med", "num_snomed_med_classes", distinct=True
    )


def _release(t, rows, name):
    """A release file, tab-separated, in the shared folder."""
    path = exports.scratch(t.spark, name)
    rows.select(*[F.col(c).cast("string") for c in rows.columns]).write.csv(path, sep="\t", header=True, quote="")
    return path


def _stack(items, *versions):
    return reduce(lambda a, b: a.unionByName(b), [items.select(*v) for v in versions])


@case("h12_terms", """
SELECT CAST(itemid AS VARCHAR) AS "conceptId", as_of, CASE WHEN as_of = '20211231' THEN label
  WHEN itemid % 3 = 0 THEN label || ' level' ELSE 'New ' || label END AS term
FROM d_labitems, (VALUES ('20211231'), ('20221231')) AS d(as_of)
""")
def _(t):
    def version(at, active, kind, term, digit):
        return [
            (F.col("itemid") * 10 + digit).alias("id"), F.lit(at).alias("effectiveTime"), active.alias("active"),
            F.col("itemid").alias("conceptId"), F.lit(kind).alias("typeId"), term.alias("term"),
        ]

    label, on = F.col("label"), F.lit("1")
    # The full name is rewritten in 2022 and retired for every third item; the synonym stays.
    path = _release(t, _stack(
        t.d_labitems,
        version("20200101", on, cd.FULL_NAME, F.concat(label, F.lit(" (observable)")), 1),
        version("20220101", F.when(F.col("itemid") % 3 == 0, "0").otherwise("1"), cd.FULL_NAME,
                F.concat(F.lit("New "), label, F.lit(" (observable)")), 1),
        version("20210101", on, cd.SYNONYM, F.concat(label, F.lit(" level")), 2),
    ), "terms")
    return reduce(lambda a, b: a.unionByName(b), [
        cd.release_terms(cd.read_release(t.spark, path, at)).withColumn("as_of", F.lit(at)) for at in ("20211231", "20221231")
    ])


@case("h12_map", """
SELECT itemid || '-1' AS loinc, CAST(CASE WHEN itemid % 2 = 1 THEN itemid * 100 + 7 ELSE itemid * 100 END AS VARCHAR) AS concept_id
FROM d_labitems WHERE itemid % 5 <> 0
""")
def _(t):
    def version(at, active, concept):
        return [
            F.col("itemid").alias("id"), F.lit(at).alias("effectiveTime"), active.alias("active"),
            concept.alias("referencedComponentId"), F.concat(F.col("itemid"), F.lit("-1")).alias("mapTarget"),
        ]

    odd = F.col("itemid") % 2 == 1
    path = _release(t, _stack(
        t.d_labitems,
        version("20200101", F.lit("1"), F.col("itemid") * 100),
        # Odd items get another concept, every fifth loses its own.
        version("20220101", F.when(F.col("itemid") % 5 == 0, "0").otherwise("1"), F.when(odd, F.col("itemid") * 100 + 7).otherwise(F.col("itemid") * 100)),
    ), "map")
    return cd.release_map(cd.read_release(t.spark, path), "mapTarget", "referencedComponentId")
