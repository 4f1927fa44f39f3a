"""Cohorts, labels, treatment arms, covariates and outcomes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.texts import contains_any, plain_prefix, starts_with_any
from caseweave.functions.times import boundaries, days_between, plus_hours
from caseweave.operators import filters as fl
from caseweave.plans.fixpoint import reachable
from caseweave.plans.ordered import carried, neighbour


def ages(subjects: DataFrame, encounters: DataFrame) -> DataFrame:
    """Age at admission = anchor age + (year of admission - anchor year)."""
    return encounters.join(subjects, "subject_id").select(
        "subject_id", "hadm_id",
        (F.col("anchor_age") + (F.year("admittime") - F.col("anchor_year"))).alias("age"),
    )


def stroke_condition(prefixes: Sequence[str]) -> Column:
    """ICD-10 prefixes, or for stroke prefixes their ICD-9 patterns."""
    code, version = F.col("icd_code"), F.col("icd_version")
    patterns = [p for prefix in prefixes for p in rules.STROKE_ICD9.get(prefix, ())]
    older = reduce(lambda a, b: a | b, [code.like(p) for p in patterns], F.lit(False))
    return ((version == 10) & starts_with_any(code, prefixes)) | ((version == 9) & older)


def diagnosis_cohort(
    stays: DataFrame,
    ages_: DataFrame,
    diagnoses: DataFrame,
    prefixes: Sequence[str],
    principal_only: bool = True,
) -> DataFrame:
    """First stays of eligible length and age with a matching diagnosis."""
    matching = diagnoses.where(stroke_condition(prefixes))
    if principal_only:
        matching = matching.where(F.col("seq_num") == 1)
    return fl.keep(fl.eligible_stays(stays, ages_), matching).select(
        "subject_id", "hadm_id", "stay_id"
    )


def with_next_admission(encounters: DataFrame) -> DataFrame:
    return neighbour(
        encounters, ["subject_id"], ["admittime", "hadm_id"], {"next_admittime": "admittime"}
    )


def readmission_labels(encounters: DataFrame, windows: Sequence[int] = (30, 60)) -> DataFrame:
    """Calendar days to the next admission and a 0/1 label per window.

    Deaths and the excluded dispositions are left out; a missing disposition or
    death flag is left out too.
    """
    days = boundaries("day", "dischtime", "next_admittime")
    labelled = with_next_admission(
        encounters.select("subject_id", "hadm_id", "admittime", "dischtime",
                          "discharge_location", "hospital_expire_flag")
    ).where(
        (F.col("hospital_expire_flag") == 0)
        & ~F.col("discharge_location").isin(list(rules.LABEL_EXCLUDED))
    )
    return labelled.select(
        "subject_id", "hadm_id", "dischtime", "next_admittime",
        days.alias("days_to_readmission"),
        *[F.when(days <= w, 1).otherwise(0).alias(f"readmitted_{w}d") for w in windows],
    )


def readmission_flags(encounters: DataFrame, windows: Sequence[int] = (30, 60)) -> DataFrame:
    """C4: 0/1 labels by exact time to the next admission, nothing left out."""
    following = with_next_admission(
        encounters.select("subject_id", "hadm_id", "admittime", "dischtime")
    )
    return following.select(
        "hadm_id",
        *[
            F.when(F.col("next_admittime") <= plus_hours("dischtime", 24 * w), 1)
            .otherwise(0).alias(f"readmitted_{w}d")
            for w in windows
        ],
    )


def head_injury_cohort(
    stays: DataFrame,
    ages_: DataFrame,
    diagnoses: DataFrame,
    charts: DataFrame,
    prefixes: Sequence[str] = ("S06",),
    max_total: float = 8,
    units: Sequence[str] = rules.NEURO_UNITS,
    hours: int = 24,
) -> DataFrame:
    """First stays over 24 h in the given units with a low early score.

    The total is the sum of the components' minima over the first ``hours``; a
    component never read counts as 0, and a total of 0 means no reading.
    """
    matching = diagnoses.where(
        (F.col("icd_version") == 10) & starts_with_any(F.col("icd_code"), prefixes)
    )
    length = boundaries("hour", "intime", "outtime")
    first = fl.first_stays(stays).where(
        (length > 24) & F.col("first_careunit").isin(list(units))
    )
    in_age = ages_.where(F.col("age").between(18, 89)).select("subject_id", "hadm_id")
    eligible = fl.keep(first, matching).join(in_age, ["subject_id", "hadm_id"], "left_semi")
    parts = {
        "gcs_eye": rules.SCORE_EYE, "gcs_verbal": rules.SCORE_VERBAL,
        "gcs_motor": rules.SCORE_MOTOR,
    }
    early = (
        charts.where(F.col("itemid").isin(list(rules.SCORE_ITEMS)))
        .select("stay_id", "itemid", "charttime", "valuenum")
        .join(eligible.select("stay_id", "intime"), "stay_id")
        .where(F.col("charttime").between(F.col("intime"), plus_hours("intime", hours)))
        .groupBy("stay_id")
        .agg(*[F.min(F.when(F.col("itemid") == i, F.col("valuenum"))).alias(n)
               for n, i in parts.items()])
    )
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in parts])
    scored = early.withColumn("gcs_total", total).where(
        (F.col("gcs_total") <= max_total) & (F.col("gcs_total") > 0)
    )
    return eligible.join(scored, "stay_id").select(
        "subject_id", "hadm_id", "stay_id", "intime", "outtime", "first_careunit",
        "gcs_total", *parts,
    )


def status_change_labels(cohort: DataFrame, charts: DataFrame, encounters: DataFrame) -> DataFrame:
    """First status other than full code, hours to it, label and outcome.

    The branch order of the outcome decides: "hospice" is reached only when the
    death flag is missing.
    """
    status = charts.where(
        (F.col("itemid") == rules.CODE_STATUS) & ~F.col("value").isin(list(rules.FULL_CODE))
    )
    first = status.groupBy("stay_id").agg(
        F.min("charttime").alias("code_status_time"),
        F.min_by("value", F.struct("charttime", "value")).alias("code_status_value"),
    )
    ends = encounters.select(
        "hadm_id", "hospital_expire_flag", "deathtime", "discharge_location"
    )
    joined = cohort.join(first, "stay_id", "left").join(ends, "hadm_id", "left")
    value, died = F.col("code_status_value"), F.col("hospital_expire_flag")
    hospice = F.col("discharge_location") == "HOSPICE"
    outcome = (
        F.when(value.isin(list(rules.COMFORT_ONLY)) & (died == 1), "CMO_death")
        .when(value.isin(list(rules.NO_RESUSCITATION)) & (died == 1), "DNR_death")
        .when(value.isNotNull() & (died == 0), "limited_code_survived")
        .when(value.isNull() & (died == 1), "full_code_death")
        .when(value.isNull() & (died == 0), "full_code_survived")
        .when(hospice, "hospice")
        .otherwise("other")
    )
    return joined.withColumns({
        "hours_to_code_change": boundaries("hour", "intime", "code_status_time"),
        "wlst_label": F.when(value.isNotNull() | hospice, 1).otherwise(0),
        "outcome_category": outcome,
    })


# --- treatment arms ---------------------------------------------------------------


@dataclass(frozen=True)
class Arm:
    """A treatment arm: who received it; a control arm is everyone else."""

    label: str
    matches: DataFrame
    control: bool = False


def drug_arm(
    label: str,
    prescriptions: DataFrame,
    concepts: DataFrame,
    edges: DataFrame,
    concept_id: str,
    control: bool = False,
) -> Arm:
    """Received a drug mapped to the concept or to one of its descendants."""
    start = edges.sparkSession.range(1).select(F.lit(concept_id).alias("start"))
    wanted = concepts.join(
        reachable(edges, start).select(F.col("node").alias("concept_id")).distinct(), "concept_id", "left_semi"
    )
    names = wanted.select(F.lower("name").alias("_name")).distinct()
    given = prescriptions.withColumn("_name", F.lower("drug")).join(names, "_name", "left_semi")
    return Arm(label, given.select("hadm_id"), control)


def drug_name_arm(
    label: str, prescriptions: DataFrame, names: Sequence[str], control: bool = False
) -> Arm:
    """C8 with the drug names already known."""
    given = prescriptions.where(F.lower("drug").isin([n.lower() for n in names]))
    return Arm(label, given.select("hadm_id"), control)


def procedure_arm(label: str, procedures: DataFrame, code: str, control: bool = False) -> Arm:
    """Had a version-10 procedure with the code or one below it."""
    done = procedures.where(
        (F.col("icd_version") == 10) & F.col("icd_code").startswith(plain_prefix(code))
    )
    return Arm(label, done.select("hadm_id"), control)


def lab_arm(
    label: str, labs: DataFrame, lab_concepts: DataFrame, loinc: str, control: bool = False
) -> Arm:
    """Had a laboratory item of the concept a LOINC code stands for."""
    concept = lab_concepts.where(F.col("loinc") == loinc.strip()).select("concept_id").distinct()
    items = lab_concepts.join(concept, "concept_id", "left_semi").select("itemid").distinct()
    return Arm(label, labs.join(items, "itemid", "left_semi").select("hadm_id"), control)


def assign_arms(encounters: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """The arm of each encounter that matches exactly one.

    All arms' matches are stacked and reduced to one row of flags per encounter,
    so the cohort is joined once however many arms there are.
    """
    if len(arms) < 2:
        raise ValueError("at least two arms are needed")
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [a.matches.select("hadm_id", F.lit(i).alias("_arm")).distinct()
         for i, a in enumerate(arms)],
    )
    flags = stacked.groupBy("hadm_id").agg(
        *[F.max((F.col("_arm") == i).cast("int")).alias(f"_in{i}") for i in range(len(arms))]
    )
    joined = encounters.select("subject_id", "hadm_id").distinct().join(flags, "hadm_id", "left")
    received = [
        (1 - F.coalesce(F.col(f"_in{i}"), F.lit(0))) if a.control
        else F.coalesce(F.col(f"_in{i}"), F.lit(0))
        for i, a in enumerate(arms)
    ]
    n = reduce(lambda a, b: a + b, received)
    arm = F.coalesce(*[F.when(r == 1, F.lit(i)) for i, r in enumerate(received)])
    label = F.coalesce(*[F.when(r == 1, F.lit(a.label)) for r, a in zip(received, arms)])
    return joined.select(
        "subject_id", "hadm_id",
        F.when(n == 1, arm).alias("T"),
        F.when(n == 1, label).alias("intervention_label"),
        n.alias("n_matching"),
    )


def arm_counts(assignment: DataFrame) -> DataFrame:
    """How many encounters were assigned, unassigned, and matched several arms."""
    n = F.col("n_matching")
    return assignment.agg(
        F.count(F.lit(1)).alias("n_cohort"),
        F.count_if(n == 1).alias("n_assigned"),
        F.count_if(n == 0).alias("n_unassigned"),
        F.count_if(n >= 2).alias("n_overlapping"),
    )


# --- covariates ---------------------------------------------------------------------


def gender_flags() -> dict[str, Column]:
    gender = F.col("gender")
    known = F.coalesce(gender.isin("M", "F"), F.lit(False))
    return {
        "gender_M": F.coalesce((gender == "M").cast("int"), F.lit(0)),
        "gender_F": F.coalesce((gender == "F").cast("int"), F.lit(0)),
        "gender_unknown": (~known).cast("int"),
    }


def one_hot(column: str, domain: Sequence[str], prefix: str, other: bool = True) -> dict[str, Column]:
    """One 0/1 column per value of a frozen domain and one for the rest."""
    value = F.col(column)
    flags = {
        f"{prefix}_{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in domain
    }
    if other:
        known = F.coalesce(value.isin(list(domain)), F.lit(False))
        flags[f"{prefix}_other"] = (~known).cast("int")
    return flags


def covariates(
    encounters: DataFrame, subjects: DataFrame, admission_types: Sequence[str] | None = None
) -> DataFrame:
    """C11: age and gender flags; with a type domain also type flags and length."""
    joined = encounters.join(
        subjects.select("subject_id", "gender", F.col("anchor_age").alias("age")), "subject_id"
    )
    columns: dict[str, Column] = {"age": F.col("age"), **gender_flags()}
    if admission_types is not None:
        columns |= one_hot("admission_type", admission_types, "admission_type")
        columns["hospital_los_days"] = days_between("admittime", "dischtime")
    return joined.select("hadm_id", *[c.alias(n) for n, c in columns.items()])


# --- outcomes -------------------------------------------------------------------------


def outcome_readmitted(encounters: DataFrame, days: int) -> DataFrame:
    """1 when the next admission starts within ``days`` of discharge."""
    following = with_next_admission(
        encounters.select("subject_id", "hadm_id", "admittime", "dischtime")
    )
    soon = days_between("dischtime", "next_admittime") <= days
    return following.select("hadm_id", F.when(soon, 1).otherwise(0).alias("value"))


def outcome_died(encounters: DataFrame) -> DataFrame:
    """In-hospital death; a missing flag counts as 0."""
    return encounters.select(
        "hadm_id", F.coalesce("hospital_expire_flag", F.lit(0)).alias("value")
    )


def outcome_survival(
    encounters: DataFrame,
    subjects: DataFrame,
    horizon_days: float,
    clock: str = "admission",
    stays: DataFrame | None = None,
) -> DataFrame:
    """C14: (time, event) from a clock to death, censored at the horizon."""
    if clock == "icu_out":
        start = stays.groupBy("hadm_id").agg(F.max("outtime").alias("_t0"))
        clocked = encounters.select("hadm_id", "subject_id").join(start, "hadm_id", "left")
    else:
        column = {"admission": "admittime", "discharge": "dischtime"}[clock]
        clocked = encounters.select("hadm_id", "subject_id", F.col(column).alias("_t0"))
    joined = clocked.join(subjects.select("subject_id", "dod"), "subject_id")
    days = days_between("_t0", F.col("dod").cast("timestamp_ntz"))
    event = F.coalesce(days.between(0, horizon_days), F.lit(False))
    limit = F.lit(float(horizon_days))
    time = F.least(limit, F.greatest(F.lit(0.0), F.when(event, days).otherwise(limit)))
    return joined.select("hadm_id", time.alias("time"), event.cast("int").alias("event"))


def outcome_icu_days(encounters: DataFrame, stays: DataFrame) -> DataFrame:
    """Summed length of an encounter's stays, 0 without one."""
    sums = stays.groupBy("hadm_id").agg(F.sum("los").alias("_days"))
    return encounters.select("hadm_id").join(sums, "hadm_id", "left").select(
        "hadm_id", F.coalesce("_days", F.lit(0.0)).alias("value")
    )


def outcome_hospital_days(encounters: DataFrame) -> DataFrame:
    """Days from admission to discharge."""
    return encounters.select("hadm_id", days_between("admittime", "dischtime").alias("value"))


def outcome_biomarker(
    encounters: DataFrame, labs: DataFrame, dictionary: DataFrame, label: str, how: str = "max"
) -> DataFrame:
    """Peak, low or mean of a measured label; NULL when never measured."""
    pick = fl.AGGREGATES[how]
    readings = fl.measured(labs, dictionary=dictionary, label=label)
    values = readings.groupBy("hadm_id").agg(pick("valuenum").alias("value"))
    return encounters.select("hadm_id").join(values, "hadm_id", "left")


def outcome_diagnosis(
    encounters: DataFrame,
    diagnoses: DataFrame,
    prefixes: Sequence[str],
    horizon_days: int,
    within: DataFrame | None = None,
) -> DataFrame:
    """C17: 1 when a later admission within the horizon has a matching diagnosis.

    ``encounters`` are the index rows, ``within`` all admissions (the same by
    default); horizon 0 looks at the index admission itself.  The next matching
    admission decides, so it is carried back over the subject's time line and no
    pairs of admissions are formed.
    """
    matching = diagnoses.where(
        (F.col("icd_version") == 10)
        & starts_with_any(F.col("icd_code"), [p.upper() for p in prefixes])
    ).select("hadm_id").distinct()
    index = encounters.select("hadm_id", "subject_id", "dischtime")
    if horizon_days == 0:
        hits = matching.withColumn("_hit", F.lit(1))
        return index.join(hits, "hadm_id", "left").select(
            "hadm_id", F.coalesce("_hit", F.lit(0)).alias("value")
        )
    pool = encounters if within is None else within
    marks = pool.join(matching, "hadm_id", "left_semi").select(
        "subject_id", F.col("admittime").alias("at"), F.lit(0).alias("side"),
        F.lit(None).cast("bigint").alias("hadm_id"), F.col("admittime").alias("mark"),
    ).distinct()
    asks = index.select(
        "subject_id", F.col("dischtime").alias("at"), F.lit(1).alias("side"), "hadm_id",
        F.lit(None).cast("timestamp_ntz").alias("mark"),
    )
    line = carried(
        marks.unionByName(asks), ["subject_id"], ["at", "side", "hadm_id"], {"next_mark": "mark"},
        backward=True,
    )
    soon = F.col("next_mark") <= plus_hours("at", 24 * horizon_days)
    return line.where(F.col("side") == 1).select(
        "hadm_id", F.when(soon, 1).otherwise(0).alias("value")
    )


def cohort_frame(
    encounters: DataFrame,
    arms: Sequence[Arm],
    covariate_rows: DataFrame,
    outcomes: Mapping[str, DataFrame],
) -> DataFrame:
    """Assigned encounters with covariates and outcomes.

    Rows that miss a covariate are dropped.  An outcome frame has ``value`` or
    ``time`` and ``event`` columns, which take the outcome's name.
    """
    assigned = assign_arms(encounters, arms).where(F.col("T").isNotNull())
    names = [c for c in covariate_rows.columns if c != "hadm_id"]
    frame = assigned.join(covariate_rows, "hadm_id", "left").dropna(subset=names)
    for name, rows in outcomes.items():
        if "event" in rows.columns:
            rows = rows.select(
                "hadm_id", F.col("time").alias(f"{name}_time"),
                F.col("event").alias(f"{name}_event"),
            )
        else:
            rows = rows.select("hadm_id", F.col("value").alias(name))
        frame = frame.join(rows, "hadm_id", "left")
    return frame


def cohort_drops(
    encounters: DataFrame, arms: Sequence[Arm], covariate_rows: DataFrame
) -> DataFrame:
    """How many encounters were asked for, were left out and why, and stay."""
    names = [c for c in covariate_rows.columns if c != "hadm_id"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names], F.lit(True))
    known = covariate_rows.select("hadm_id", whole.alias("_whole"))
    rows = assign_arms(encounters, arms).join(known, "hadm_id", "left")
    n, complete = F.col("n_matching"), F.coalesce("_whole", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(n == 0).alias("n_unassigned"),
        F.count_if(n >= 2).alias("n_overlapping"),
        F.count_if((n == 1) & ~complete).alias("n_missing_covariates"),
        F.count_if((n == 1) & complete).alias("n_final"),
    )


# --- events of a cohort -----------------------------------------------------------------


def lab_rows(
    labs: DataFrame, dictionary: DataFrame, name: str, encounters: DataFrame,
    fluids: Sequence[str] = (), window: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Readings whose label contains the name, with their dictionary entry."""
    known = fl.keep(labs.where(F.col("valuenum").isNotNull()), encounters)
    known = window(known) if window else known
    items = dictionary.where(contains_any(F.col("label"), [name]))
    if fluids:
        items = items.where(contains_any(F.col("fluid"), fluids))
    return known.join(items, "itemid")


def vital_rows(
    charts: DataFrame, dictionary: DataFrame, name: str, encounters: DataFrame,
    window: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Charted readings whose label contains the name."""
    return lab_rows(charts, dictionary, name, encounters, window=window)


def drug_rows(
    prescriptions: DataFrame, name: str, encounters: DataFrame,
    window: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Prescriptions of a drug or drug group."""
    terms = fl.drug_terms(name) or [name]
    known = fl.keep(prescriptions.where(contains_any(F.col("drug"), terms)), encounters)
    return window(known) if window else known


def diagnosis_rows(
    diagnoses: DataFrame, dictionary: DataFrame, text: str, encounters: DataFrame
) -> DataFrame:
    """Diagnoses by title or code prefix; codes may lack a title."""
    titled = fl.keep(diagnoses, encounters).join(dictionary, ["icd_code", "icd_version"], "left")
    hit = F.coalesce(contains_any(F.col("long_title"), [text]), F.lit(False))
    return titled.where(hit | F.col("icd_code").startswith(text))


def culture_rows(
    cultures: DataFrame, name: str, encounters: DataFrame,
    window: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Cultures whose specimen or organism contains the name."""
    hit = F.coalesce(contains_any(F.col("spec_type_desc"), [name]), F.lit(False)) | F.coalesce(
        contains_any(F.col("org_name"), [name]), F.lit(False)
    )
    known = fl.keep(cultures.where(hit), encounters)
    return window(known) if window else known


def subject_rows(subjects: DataFrame, encounters: DataFrame) -> DataFrame:
    """Subjects of the cohort."""
    return fl.keep(subjects, encounters, "subject_id").select("subject_id", "gender", "anchor_age")


def encounter_rows(encounters: DataFrame, all_encounters: DataFrame) -> DataFrame:
    """Encounters of the cohort with their readmission labels."""
    flags = readmission_flags(all_encounters)
    return encounters.join(flags, "hadm_id", "left").select(
        "hadm_id", "subject_id", "admittime", "dischtime", "admission_type",
        "discharge_location", "hospital_expire_flag",
        F.coalesce("readmitted_30d", F.lit(0)).alias("readmitted_30d"),
        F.coalesce("readmitted_60d", F.lit(0)).alias("readmitted_60d"),
    )


def stay_rows(stays: DataFrame, encounters: DataFrame) -> DataFrame:
    """C20: stays of the cohort."""
    return fl.keep(stays, encounters).select(
        "stay_id", "hadm_id", "subject_id", "intime", "outtime", "los"
    )
