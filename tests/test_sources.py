import gzip
import json

from caseweave.operators import codes as cd
from caseweave.sources import exports, mappings, tables


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "patients.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write("gender,subject_id,anchor_age,anchor_year,dod\nF,1,65,2150,2150-02-01\nM,2,old,2150\n")
    rows = {r["subject_id"]: r for r in tables.read_csv(spark, str(path), tables.SCHEMAS["patients"]).collect()}
    assert rows[1]["anchor_age"] == 65 and str(rows[1]["dod"]) == "2150-02-01"
    assert rows[2]["anchor_age"] is None and rows[2]["dod"] is None


def test_format_priority(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    (tmp_path / "icu").mkdir()
    (tmp_path / "hosp" / "transfers.csv").write_text("hadm_id\n1\n2\n")
    spark.createDataFrame([(9,)], "hadm_id long").write.parquet(str(tmp_path / "hosp" / "transfers.parquet"))
    with gzip.open(tmp_path / "icu" / "icustays.csv.gz", "wt") as out:
        out.write("stay_id,hadm_id\n5,1\n")
    loaded = tables.load_tables(spark, str(tmp_path))
    assert sorted(loaded) == ["icustays", "transfers"]
    assert loaded["transfers"].count() == 2 and loaded["icustays"].first()["stay_id"] == 5


def test_mapping_files(spark, tmp_path):
    path = tmp_path / "cohorts.json"
    path.write_text(json.dumps({
        "_metadata": {"x": 1},
        "sepsis": {"icd10_prefixes": ["A41.", "R65.20"], "icd9_prefixes": ["995.91"], "aliases": []},
    }))
    got = sorted(tuple(r) for r in mappings.read_cohorts(spark, str(path)).collect())
    assert got == [("sepsis", 9, "99591"), ("sepsis", 10, "A41"), ("sepsis", 10, "R6520")]
    path = tmp_path / "groups.json"
    path.write_text(json.dumps({"g": {"patterns": ["a", "b"], "aliases": ["x"]}}))
    assert mappings.read_groups(spark, str(path)).count() == 2
    path = tmp_path / "concepts.json"
    path.write_text(json.dumps({"50912": {"snomed_code": "113075003", "snomed_term": "Creatinine", "loinc": "2160-0"}}))
    assert tuple(mappings.read_concepts(spark, str(path), "itemid").first()) == ("50912", "113075003", "Creatinine", "2160-0")
    assert mappings.charlson_table(spark).count() > 200 and mappings.cohort_table(spark).count() > 50


def test_release_files(spark, tmp_path):
    path = tmp_path / "terms.txt"
    full, other = cd.FULL_NAME, cd.SYNONYM
    path.write_text(
        "id\teffectiveTime\tactive\tconceptId\ttypeId\tterm\n"
        f"1\t20200101\t1\t55\t{full}\tCreatinine (substance)\n2\t20200101\t1\t55\t{other}\tCr\n"
        f"3\t20200101\t0\t66\t{full}\tOld (thing)\n4\t20200101\t1\t66\t{other}\tNew\n"
    )
    terms = cd.release_terms(cd.read_release(spark, str(path)))
    assert {r["conceptId"]: r["term"] for r in terms.collect()} == {"55": "Creatinine", "66": "New"}
    path = tmp_path / "map.txt"
    path.write_text(
        "effectiveTime\tactive\tmapTarget\treferencedComponentId\n20200101\t1\t2160-0\t111\n"
        "20210101\t1\t2160-0\t222\n20200101\t1\tnocode\t333\n20200101\t0\t1-1\t444\n"
    )
    found = cd.release_map(cd.read_release(spark, str(path)), "mapTarget", "referencedComponentId")
    assert [tuple(r) for r in found.collect()] == [("2160-0", "222")]


def test_log_drops_other_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    lines = [
        {"kind": "routing_decision", "schema_version": "1", "plan": "SQL", "turn_id": "1", "scope": "one"},
        {"kind": "routing_decision", "schema_version": "1", "plan": "GRAPH", "turn_id": "1", "scope": "one"},
        {"kind": "routing_decision", "schema_version": "9", "plan": "SQL", "turn_id": "1"},
        {"kind": "routing_decision", "plan": "SQL", "turn_id": "1"}, {"kind": "other"},
    ]
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n\nnot json\n")
    assert exports.skipped_lines(spark, str(path)).first() == (2, 3)
    log = exports.read_log(spark, str(path))
    assert {(r["field"], r["value"]): r["count"] for r in exports.log_counts(log).where("value IS NOT NULL").collect()} == {
        ("plan", "SQL"): 1, ("plan", "GRAPH"): 1, ("scope", "one"): 2,
    }
    assert exports.log_turns(log).first()["n_mixed"] == 1


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("PA-1", "Patient"), ("HA-2", "HospitalAdmission")], "id string, type string")
    edges = spark.createDataFrame([("PA-1", "hasAdmission", "HA-2")], "src string, predicate string, dst string")
    exports.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 1
    exports.write_triples(nodes, edges, str(tmp_path / "t"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert len(lines) == 3 and all(line.startswith("<") and line.endswith(" .") for line in lines)


def test_curated_groups(spark, tmp_path):
    """Groups are read from a file of one object; kind may be missing, notes are left out."""
    path = tmp_path / "groups.json"
    path.write_text('{"_metadata": {"note": "x"}, "blood gases": {"snomed_code": "167029005", "members": ["ph", "base excess"]},\n'
                    ' "opioids": {"snomed_code": "373265006", "kind": "drug", "members": ["morphine"]}}')
    rows = mappings.read_categories(spark, str(path)).collect()
    assert {tuple(r) for r in rows} == {
        ("blood gases", "167029005", None, "ph"), ("blood gases", "167029005", None, "base excess"), ("opioids", "373265006", "drug", "morphine"),
    }
    assert {"electrolytes", "gram-positive bacteria", "insulin"} <= {r.category for r in cd.category_table(spark).collect()}


def test_names_match_whole_words_of_labels(spark):
    resolved = spark.createDataFrame(
        [("gases", "ph"), ("gases", "base excess"), ("markers", "CK-MB"), ("void", "--")], "name string, member string"
    )
    labels = spark.createDataFrame(
        [(1, "pH, Arterial"), (2, "Phosphate"), (3, "Base  Excess (pH)"), (4, "CK MB"), (5, "Excess base"), (6, None), (7, "")],
        "itemid int, label string",
    )
    found = cd.rows_for_names(resolved, labels, "label").select("name", "itemid").collect()
    assert sorted(tuple(r) for r in found) == [("gases", 1), ("gases", 3), ("markers", 4)]


def test_triples_are_packed(spark, tmp_path):
    """every line repeats its name space, so files are packed; readers of text get the same lines."""
    edges = spark.range(2000).selectExpr("'PA-' || id % 9 AS src", "'hasAdmission' AS predicate", "'HA-' || id AS dst")
    nodes = edges.selectExpr("src AS id", "'Patient' AS type").distinct()
    exports.write_triples(nodes, edges, str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == sorted(r[0] for r in exports.triples(nodes, edges).collect()) and len(lines) == 2009
    assert sum(f.stat().st_size for f in files) * 5 < sum(len(line) + 1 for line in lines)
