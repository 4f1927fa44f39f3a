from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.arithmetic import index_column
from caseweave.functions.texts import plain_drug, specimen_term
from caseweave.operators import cohorts as co, codes as cd, filters as fl, observation as ob

ADM = ("hadm_id long, subject_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
       "discharge_location string, hospital_expire_flag int")


def d(text):
    return datetime.fromisoformat(text)


def admissions(spark):
    return spark.createDataFrame([
        (1, 1, d("2150-01-15"), d("2150-01-20"), "HOME", 0),
        (2, 1, d("2150-02-10"), d("2150-02-12"), "HOME", 0),
        (3, 2, d("2150-01-01"), d("2150-01-10"), "HOME", 0),
        (4, 2, d("2150-02-25"), d("2150-02-26"), "HOSPICE", 0),
        (5, 3, d("2150-01-01"), d("2150-01-05"), "HOME", 1),
        (6, 4, d("2150-01-01"), d("2150-01-05"), None, 0),
    ], ADM)


def test_readmission_labels(spark):
    rows = {r["hadm_id"]: r for r in co.readmission_labels(admissions(spark)).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["days_to_readmission"], rows[1]["readmitted_30d"]) == (21, 1)
    assert (rows[2]["days_to_readmission"], rows[2]["readmitted_30d"]) == (None, 0)
    assert (rows[3]["readmitted_30d"], rows[3]["readmitted_60d"]) == (0, 1)
    assert co.readmission_flags(admissions(spark)).count() == 6


def test_labels_with_a_hot_subject(small_tasks):
    spark = small_tasks
    rows = [(i, 1 if i % 3 else i, d("2150-01-01") , d("2150-01-02"), "HOME", 0) for i in range(90)]
    df = spark.createDataFrame(rows, ADM).withColumn(
        "admittime", F.expr("admittime + make_dt_interval(hadm_id)")
    ).withColumn("dischtime", F.expr("dischtime + make_dt_interval(hadm_id)"))
    split = sorted(tuple(r) for r in co.readmission_flags(df).collect())
    spark.conf.set("caseweave.rowsPerTask", "100000")
    assert split == sorted(tuple(r) for r in co.readmission_flags(df).collect())


def test_age(spark):
    people = spark.createDataFrame([(1, 65, 2150), (2, 45, 2149)], "subject_id long, anchor_age int, anchor_year int")
    got = {r["hadm_id"]: r["age"] for r in co.ages(people, admissions(spark)).collect()}
    assert got == {1: 65, 2: 65, 3: 46, 4: 46}


def cohort_tables(spark):
    stays = spark.createDataFrame([
        (10, 1, 1, d("2150-01-15 01:00"), d("2150-01-18")),
        (11, 1, 1, d("2150-01-15 00:30"), d("2150-01-15 10:00")),
        (20, 1, 2, d("2150-02-10"), d("2150-02-12")),
        (30, 2, 3, d("2150-01-01"), d("2150-01-04")),
    ], "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    ages = spark.createDataFrame([(1, 1, 65), (1, 2, 65), (2, 3, 15)], "subject_id long, hadm_id long, age int")
    codes = spark.createDataFrame([
        (1, 1, "I639", 10), (2, 2, "I639", 10), (2, 1, "43391", 9), (3, 1, "430", 9),
    ], "hadm_id long, seq_num int, icd_code string, icd_version int")
    return stays, ages, codes


def test_diagnosis_cohort_edges(spark):
    stays, ages, codes = cohort_tables(spark)
    # Encounter 1's first stay lasts 10 hours; encounter 3's subject is 15.
    got = co.diagnosis_cohort(stays, ages, codes, ["I63", "I60"]).collect()
    assert [(r["hadm_id"], r["stay_id"]) for r in got] == [(2, 20)]
    codes = codes.where("icd_version = 10")
    assert co.diagnosis_cohort(stays, ages, codes, ["I63"]).count() == 0
    assert co.diagnosis_cohort(stays, ages, codes, ["I63"], principal_only=False).count() == 1


@pytest.mark.parametrize("code, hit", [("43391", True), ("43300", False), ("436", True), ("4360", False)])
def test_stroke_patterns(spark, code, hit):
    df = spark.createDataFrame([(code, 9)], "icd_code string, icd_version int")
    assert df.select(co.stroke_condition(["I63"])).first()[0] is hit


def test_status_labels(spark):
    cohort = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 4, 3), (4, 6, 4)], "subject_id long, hadm_id long, stay_id long") \
        .withColumn("intime", F.lit(d("2150-01-01")).cast("timestamp_ntz"))
    charts = spark.createDataFrame([
        (1, 223758, d("2150-01-01 01:00"), "Full code"), (1, 223758, d("2150-01-01 05:00"), "DNR"),
        (2, 223758, d("2150-01-02"), "CMO"),
    ], "stay_id long, itemid int, charttime timestamp_ntz, value string")
    ends = spark.createDataFrame([
        (1, 0, None, "HOME"), (2, 1, d("2150-01-03"), "DIED"), (4, 0, None, "HOSPICE"), (6, None, None, "HOSPICE"),
    ], "hadm_id long, hospital_expire_flag int, deathtime timestamp_ntz, discharge_location string")
    got = {r["stay_id"]: (r["wlst_label"], r["outcome_category"], r["hours_to_code_change"])
           for r in co.status_change_labels(cohort, charts, ends).collect()}
    assert got == {
        1: (1, "limited_code_survived", 5), 2: (1, "CMO_death", 24),
        3: (1, "full_code_survived", None), 4: (1, "hospice", None),
    }


def test_arms(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,)], "hadm_id long")
    other = spark.createDataFrame([(2,), (3,)], "hadm_id long")
    arms = [co.Arm("a", rows), co.Arm("b", other)]
    got = {r["hadm_id"]: (r["T"], r["n_matching"]) for r in co.assign_arms(admissions(spark), arms).collect()}
    assert got == {1: (0, 1), 2: (None, 2), 3: (1, 1), 4: (None, 0), 5: (None, 0), 6: (None, 0)}
    counts = co.arm_counts(co.assign_arms(admissions(spark), arms)).first()
    assert tuple(counts) == (6, 2, 3, 1)
    with pytest.raises(ValueError):
        co.assign_arms(admissions(spark), arms[:1])


def test_survival_is_censored_at_the_horizon(spark):
    people = spark.createDataFrame([(1, date(2150, 1, 25)), (2, None), (3, date(2160, 1, 1)), (4, None)],
                                   "subject_id long, dod date")
    got = {r["hadm_id"]: (r["time"], r["event"])
           for r in co.outcome_survival(admissions(spark), people, 30).collect()}
    assert got[1] == (10.0, 1) and got[3] == (30.0, 0) and got[5] == (30.0, 0)


def test_later_diagnosis(spark):
    codes = spark.createDataFrame([(2, 1, "I500", 10)], "hadm_id long, seq_num int, icd_code string, icd_version int")
    got = {r["hadm_id"]: r["value"] for r in co.outcome_diagnosis(admissions(spark), codes, ["I50"], 30).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    index = co.outcome_diagnosis(admissions(spark), codes, ["I50"], 0)
    assert {r["hadm_id"] for r in index.where("value = 1").collect()} == {2}


def test_charlson_counts_a_category_once(spark):
    codes = spark.createDataFrame([(1, "I21.4", 10), (1, "I252", 10), (1, "C780", 10), (2, "4109", 9), (3, "Z000", 10)],
                                  "hadm_id long, icd_code string, icd_version int")
    table = spark.createDataFrame(rules.charlson_prefixes(), "category string, weight int, prefix string")
    got = {r["hadm_id"]: r["charlson_index"] for r in ob.charlson(codes, table).collect()}
    assert got == {1: 7, 3: 0}


@pytest.mark.parametrize("code, score", [("S0634", 5), ("S0630X", 4), ("S0603", 2), ("S06", 4), ("S07", 0)])
def test_severity_of_the_longest_prefix(spark, code, score):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(ob.severity_of(F.col("c"), rules.HEAD_SEVERITY)).first()[0] == score
    assert df.select(ob.severity_of(F.lit("S06"), {"S06": "4-5"})).first()[0] == 5


def test_overlapping_intervals(spark):
    rows = spark.createDataFrame([
        (1, d("2150-01-01 00:00"), d("2150-01-01 04:00"), d("2150-01-01")),
        (1, d("2150-01-01 02:00"), d("2150-01-01 06:00"), d("2150-01-01")),
        (1, d("2150-01-02 20:00"), d("2150-01-04 20:00"), d("2150-01-01")),
    ], "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, intime timestamp_ntz")
    assert ob.clipped_hours(rows, 48, "h").first()["h"] == 12.0
    assert ob.clipped_hours(rows, 48, "h", merge_overlaps=True).first()["h"] == 10.0


@pytest.mark.parametrize("phrase, name", [
    ("Sepsis", "sepsis"), ("heart attack", "mi_acute"), ("patients with acute respiratory failure", "respiratory_failure"),
    ("COVID-19!", "covid_19"), ("nothing known", None), ("", None),
])
def test_named_cohorts(spark, phrase, name):
    assert rules.cohort_named(phrase) == name
    df = spark.createDataFrame([(phrase,)], "p string")
    assert df.select(fl.cohort_of_phrase(F.col("p"))).first()[0] == name


def test_drug_names(spark):
    df = spark.createDataFrame([("Aspirin 81 mg",), ("Insulin (Human)",), ("Phenylephrine",)], "d string")
    assert [r[0] for r in df.select(plain_drug(F.col("d"))).collect()] == ["aspirin", "insulin", "phenylephrine"]
    got = [r[0] for r in df.select(cd.drug_categories(F.col("d"))).collect()]
    assert got == [[], ["insulin"], ["vasopressors"]]
    assert fl.drug_terms("PCC")[:2] == ["prothrombin", "kcentra"] and fl.drug_terms("PCC")[-1] == "pcc"
    assert specimen_term("sputum culture") == "sputum" and specimen_term("culture") == "culture"


def test_index_expression_guards(spark):
    df = spark.createDataFrame([(4.0, 0.0)], "a double, b double")
    ops = {"a": F.col("a"), "b": F.col("b")}
    assert df.select(index_column({"op": "/", "args": ["a", "b"]}, ops)).first()[0] is None
    assert df.select(index_column({"op": "ln", "args": ["b"]}, ops)).first()[0] is None
    assert df.select(index_column({"op": "+", "args": ["a", 1, 2]}, ops)).first()[0] == 7.0
    with pytest.raises(ValueError):
        index_column({"op": "^", "args": ["a", "b"]}, ops)


def test_concept_rules(spark):
    codes = spark.createDataFrame([("I639", 10), ("I638", 10), ("E119", 10), ("43391", 9)], "icd_code string, icd_version int")
    concepts = spark.createDataFrame([("I639", "12", "short id"), ("I63", "432504007", "x"), ("E11", "44054006", "y")],
                                     "code string, concept_id string, term string")
    got = {r["icd_code"]: r["concept_id"] for r in cd.map_diagnoses(codes, concepts).collect()}
    assert got == {"I639": None, "I638": "432504007", "E119": "44054006", "43391": None}


def test_hierarchy_expansion_needs_two_names(spark):
    curated = spark.createDataFrame([("opioids", "morphine")], "category string, member string")
    concepts = spark.createDataFrame([("pressor", "P"), ("a", "A"), ("b", "B"), ("lone", "L"), ("c", "C")],
                                     "name string, concept_id string")
    pairs = cd.closure(spark.createDataFrame([("A", "P"), ("B", "P"), ("C", "L")], "child string, parent string"))
    asked = spark.createDataFrame([("Pressor",), ("lone",), ("opioids",), ("other",)], "name string")
    got = sorted(tuple(r) for r in cd.resolve_names(asked, curated, concepts, pairs).collect())
    assert got == sorted([("Pressor", "a", "hierarchy"), ("Pressor", "b", "hierarchy"), ("lone", "lone", "name"),
                          ("opioids", "morphine", "curated"), ("other", "other", "name")])
