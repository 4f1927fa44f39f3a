"""Features of the first hours of a stay.

``cohort`` is one row per stay with stay_id, hadm_id, subject_id and intime.
Each group of features is one aggregate over the window's rows, so the wide
columns come out of the aggregate itself and need no separate pivot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.texts import contains_any
from caseweave.functions.times import boundaries, plus_hours, seconds_between
from caseweave.operators import filters as fl
from caseweave.operators.codes import match_prefixes
from caseweave.operators.joins import mean_until, merge_features
from caseweave.operators.windows import binned_means, distinct_on, in_first_hours, score_totals
from caseweave.plans.ordered import running

HOURS = 48


def demographics(
    cohort: DataFrame, ages: DataFrame, subjects: DataFrame, encounters: DataFrame,
    measures: DataFrame,
) -> DataFrame:
    """O1: age, male flag, and mean body mass index measured up to admission."""
    base = (
        cohort.select("stay_id", "hadm_id", "subject_id")
        .join(ages.select("hadm_id", "age"), "hadm_id")
        .join(subjects.select("subject_id", "gender"), "subject_id")
        .select("stay_id", "age",
                F.coalesce((F.col("gender") == "M").cast("int"), F.lit(0)).alias("is_male"))
    )
    admitted = cohort.select("stay_id", "hadm_id", "subject_id").join(
        encounters.select("hadm_id", "admittime"), "hadm_id"
    )
    bmi = mean_until(
        admitted, measures.where(F.col("result_name").contains("BMI")), "subject_id",
        "admittime", "chartdate", F.col("result_value").try_cast("double"), "stay_id", "bmi",
    )
    return base.join(bmi, "stay_id", "left")


def window_scores(charts: DataFrame, cohort: DataFrame, hours: float = HOURS) -> DataFrame:
    """Score components and total per stay and time of the window."""
    items = charts.where(F.col("itemid").isin(list(rules.SCORE_ITEMS)))
    return score_totals(in_first_hours(items, cohort, hours))


def score_features(charts: DataFrame, cohort: DataFrame, hours: float = HOURS) -> DataFrame:
    """O2: range and mean of the total, motor change, first total, count."""
    scores = window_scores(charts, cohort, hours)
    motor, total, at = F.col("motor"), F.col("total"), F.col("charttime")
    first_motor, last_motor = F.min_by(motor, at), F.max_by(motor, at)
    return scores.groupBy("stay_id").agg(
        F.min(total).alias("gcs_total_min"), F.max(total).alias("gcs_total_max"),
        F.avg(total).alias("gcs_total_mean"),
        F.min(motor).alias("gcs_motor_min"), F.max(motor).alias("gcs_motor_max"),
        (last_motor - first_motor).alias("gcs_motor_delta"),
        F.when(last_motor > first_motor, 1).otherwise(0).alias("gcs_improving"),
        F.min_by(total, at).alias("gcs_admission_total"),
        F.count(F.lit(1)).alias("gcs_measurement_count"),
    )


def score_bins(charts: DataFrame, cohort: DataFrame, hours: int = HOURS) -> DataFrame:
    """O3: mean motor component per 12 hours."""
    return binned_means(charts, cohort, rules.SCORE_MOTOR, "gcs_motor", 12, hours)


def oxygen_features(charts: DataFrame, cohort: DataFrame, hours: float = HOURS) -> DataFrame:
    """Whether oxygen flow was charted, its mean and peak."""
    rows = charts.where(
        (F.col("itemid") == rules.OXYGEN_FLOW) & F.col("valuenum").isNotNull()
    )
    found = in_first_hours(rows, cohort, hours).groupBy("stay_id").agg(
        F.avg("valuenum").alias("o2_flow_mean"), F.max("valuenum").alias("o2_flow_max")
    )
    return cohort.select("stay_id").join(found, "stay_id", "left").select(
        "stay_id", F.col("o2_flow_mean").isNotNull().cast("int").alias("o2_flow_any"),
        "o2_flow_mean", "o2_flow_max",
    )


def clipped_hours(
    rows: DataFrame, hours: float, name: str, merge_overlaps: bool = False
) -> DataFrame:
    """Hours of each stay's intervals, cut at the end of the window.

    By default overlapping intervals count twice.  With ``merge_overlaps`` each
    interval adds only what lies beyond the latest end before it.
    """
    until = F.least(F.col("endtime"), plus_hours("intime", hours))
    if not merge_overlaps:
        minutes = boundaries("minute", "starttime", until)
        return rows.groupBy("stay_id").agg((F.sum(minutes) / 60.0).alias(name))
    cut = rows.select("stay_id", "starttime", until.alias("until")).where(
        F.col("until") > F.col("starttime")
    ).distinct()
    line = running(
        cut, ["stay_id"], ["starttime", "until"], {"covered": "until"}, how="max", inclusive=False
    )
    begin = F.greatest(F.col("starttime"), F.coalesce("covered", "starttime"))
    gain = F.greatest(F.lit(0.0), seconds_between(begin, "until") / 3600.0)
    return line.groupBy("stay_id").agg(F.sum(gain).alias(name))


def pressure_features(
    charts: DataFrame, inputs: DataFrame, items: DataFrame, cohort: DataFrame,
    hours: float = HOURS, merge_overlaps: bool = False,
) -> DataFrame:
    """Arterial pressure statistics and vasopressor use.

    One row per stay with a pressure reading; the deviation is the sample one.
    """
    pressure = charts.where(
        F.col("itemid").isin(rules.PRESSURE_LINE, rules.PRESSURE_CUFF)
        & F.col("valuenum").isNotNull()
    )
    stats = in_first_hours(pressure, cohort, hours).groupBy("stay_id").agg(
        F.avg("valuenum").alias("map_mean"), F.min("valuenum").alias("map_min"),
        F.max("valuenum").alias("map_max"), F.stddev_samp("valuenum").alias("map_std"),
    )
    drugs = items.where(F.lower("label").isin(list(rules.VASOPRESSORS))).select("itemid", "label")
    given = in_first_hours(inputs.join(drugs, "itemid"), cohort, hours, "starttime")
    use = given.groupBy("stay_id").agg(
        F.lit(1).alias("vasopressor_any"),
        F.count_distinct("label").alias("vasopressor_drug_count"),
        F.max("rate").alias("vasopressor_max_rate"),
    ).join(clipped_hours(given, hours, "vasopressor_hours", merge_overlaps), "stay_id", "left")
    return stats.join(use, "stay_id", "left").fillna(0, ["vasopressor_any"])


def lab_features(
    labs: DataFrame, cohort: DataFrame, hours: float = HOURS,
    items: Mapping[int, str] = rules.LAB_ITEMS,
) -> DataFrame:
    """Low, high, mean, first and last of each laboratory item, wide."""
    rows = in_first_hours(
        labs.where(F.col("itemid").isin(list(items)) & F.col("valuenum").isNotNull()),
        cohort, hours, key="hadm_id",
    )
    place = F.struct("charttime", "labevent_id", "valuenum")
    columns = []
    for itemid, name in items.items():
        mine = F.col("itemid") == itemid
        value, at = F.when(mine, F.col("valuenum")), F.when(mine, place)
        columns += [
            F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"),
            F.avg(value).alias(f"{name}_mean"),
            F.min_by(F.col("valuenum"), at).alias(f"{name}_first"),
            F.max_by(F.col("valuenum"), at).alias(f"{name}_last"),
        ]
    return rows.groupBy("stay_id").agg(*columns)


def ventilation_features(
    procedures: DataFrame, cohort: DataFrame, hours: float = HOURS, merge_overlaps: bool = False
) -> DataFrame:
    """Ventilation begun, hours to it, clipped duration."""
    rows = in_first_hours(
        procedures.where(F.col("itemid") == rules.VENTILATION), cohort, hours, "starttime"
    )
    found = rows.groupBy("stay_id").agg(
        F.min(boundaries("hour", "intime", "starttime")).alias("hours_to_vent")
    ).join(clipped_hours(rows, hours, "vent_duration_48h", merge_overlaps), "stay_id", "left")
    return cohort.select("stay_id").join(found, "stay_id", "left").select(
        "stay_id", F.col("hours_to_vent").isNotNull().cast("int").alias("vent_initiated"),
        "hours_to_vent", "vent_duration_48h",
    )


def procedure_features(
    procedures: DataFrame, cohort: DataFrame, hours: float = HOURS,
    items: Mapping[str, int] = rules.NEUROSURGERY,
) -> DataFrame:
    """Whether any and each of the procedures began in the window."""
    rows = in_first_hours(
        procedures.where(F.col("itemid").isin(list(items.values()))), cohort, hours, "starttime"
    )
    flags = rows.groupBy("stay_id").agg(
        F.lit(1).alias("any_neurosurgery"),
        *[F.max((F.col("itemid") == i).cast("int")).alias(n) for n, i in items.items()],
    )
    return cohort.select("stay_id").join(flags, "stay_id", "left").fillna(0)


def brain_pressure_drugs(
    inputs: DataFrame, items: DataFrame, prescriptions: DataFrame, cohort: DataFrame,
    hours: float = HOURS, keywords: Sequence[str] = rules.PRESSURE_DRUGS,
) -> DataFrame:
    """Count of infusions and a flag per drug, from infusions or prescriptions."""
    def flag(column: str, word: str) -> Column:
        return F.max(F.lower(column).contains(word).cast("int"))

    names = {w: w.replace(" ", "_") + "_given" for w in keywords}
    wanted = items.where(contains_any(F.col("label"), keywords)).select("itemid", "label")
    infused = in_first_hours(
        inputs.join(wanted, "itemid"), cohort, hours, "starttime"
    ).groupBy("stay_id").agg(
        F.count(F.lit(1)).alias("icp_med_count"),
        *[flag("label", w).alias(n) for w, n in names.items()],
    )
    ordered = in_first_hours(
        prescriptions.where(contains_any(F.col("drug"), keywords)), cohort, hours, "starttime",
        key="hadm_id",
    ).groupBy("stay_id").agg(*[flag("drug", w).alias(f"rx_{n}") for w, n in names.items()])
    joined = merge_features(cohort.select("stay_id"), [infused, ordered], "stay_id").fillna(0)
    return joined.select(
        "stay_id", "icp_med_count",
        *[F.greatest(F.col(n), F.col(f"rx_{n}")).alias(n) for n in names.values()],
    )


def charlson(
    diagnoses: DataFrame, table: DataFrame, categories: Sequence[str] = tuple(rules.CHARLSON)
) -> DataFrame:
    """Comorbidity index and one flag per category, for coded encounters.

    ``table`` has category, weight and prefix.  A category counts once.
    """
    coded = diagnoses.where(F.col("icd_version") == 10).select(
        "hadm_id", F.regexp_replace("icd_code", r"\.", "").alias("icd_code")
    ).distinct()
    hits = match_prefixes(coded, "icd_code", table).select(
        "icd_code", "category", "weight"
    ).distinct()
    rows = coded.join(hits, "icd_code", "left").select("hadm_id", "category", "weight").distinct()
    return rows.groupBy("hadm_id").agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("charlson_index"),
        *[
            F.max(F.coalesce((F.col("category") == c).cast("int"), F.lit(0)))
            .alias(f"charlson_{c}")
            for c in categories
        ],
    )


def confounders(
    cohort: DataFrame, encounters: DataFrame, services: DataFrame, transfers: DataFrame,
    charlson_rows: DataFrame,
) -> DataFrame:
    """Language, first service, transfers and comorbidity index."""
    language = cohort.select("hadm_id").distinct().join(encounters, "hadm_id").select(
        "hadm_id",
        F.when(F.col("language") != "ENGLISH", 1).otherwise(0).alias("language_barrier"),
    )
    order = [c for c in ("transfertime", "service_no", "curr_service") if c in services.columns]
    first = distinct_on(services, ["hadm_id"], order).select(
        "hadm_id",
        F.when(F.col("curr_service").isin(list(rules.NEURO_SERVICES)), 1).otherwise(0)
        .alias("is_neuro_service"),
    )
    moves = transfers.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("transfer_count"))
    return merge_features(language, [first, moves, charlson_rows])


def severity_of(code: Column, table: Mapping[str, int | str], shortest: int = 3) -> Column:
    """Severity of the longest prefix in the table, 0 without one."""
    # A range such as "4-5" means its upper end.
    scores = {p: int(str(s).split("-")[-1]) for p, s in table.items()}
    lookup = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    longest = max(len(p) for p in scores)
    tries = [
        F.when(F.length(code) >= n, F.try_element_at(lookup, F.substring(code, 1, n)))
        for n in range(longest, shortest - 1, -1)
    ]
    return F.coalesce(*tries, F.lit(0))


def head_severity(
    diagnoses: DataFrame, cohort: DataFrame,
    table: Mapping[str, int | str] = rules.HEAD_SEVERITY, family: str = "S06",
) -> DataFrame:
    """Highest head-injury severity per encounter."""
    rows = fl.keep(
        diagnoses.where((F.col("icd_version") == 10) & F.col("icd_code").startswith(family)),
        cohort,
    )
    return rows.groupBy("hadm_id").agg(
        F.max(severity_of(F.col("icd_code"), table)).alias("head_ais_score")
    )


def assemble(cohort: DataFrame, by_stay: Sequence[DataFrame], by_encounter: Sequence[DataFrame]) -> DataFrame:
    """All feature groups joined to the cohort."""
    base = cohort.select("stay_id", "hadm_id", "subject_id")
    return merge_features(merge_features(base, by_stay, "stay_id"), by_encounter, "hadm_id")


EVENT_COLUMNS = ("stay_id", "kind", "name", "start_ts", "end_ts", "value")


def window_events(
    cohort: DataFrame, charts: DataFrame, inputs: DataFrame, procedures: DataFrame,
    labs: DataFrame, items: DataFrame, lab_items: DataFrame, hours: float = HOURS,
) -> DataFrame:
    """The window's series as event rows; an instant has equal ends."""
    def row(kind: str, name: Column, start: str, end: str, value: Column) -> list[Column]:
        return [
            F.col("stay_id"), F.lit(kind).alias("kind"), name.alias("name"),
            F.col(start).alias("start_ts"), F.col(end).alias("end_ts"),
            value.cast("double").alias("value"),
        ]

    labels = items.select("itemid", "label")
    scores = window_scores(charts, cohort, hours).where(F.col("total") > 0)
    pressure = in_first_hours(
        charts.where(F.col("itemid").isin(rules.PRESSURE_LINE, rules.PRESSURE_CUFF)
                     & F.col("valuenum").isNotNull()),
        cohort, hours,
    )
    line = F.when(F.col("itemid") == rules.PRESSURE_LINE, "Arterial BP Mean").otherwise(
        "Non Invasive BP Mean"
    )
    infusions = in_first_hours(inputs.join(labels, "itemid"), cohort, hours, "starttime")
    done = in_first_hours(procedures.join(labels, "itemid", "left"), cohort, hours, "starttime")
    readings = in_first_hours(
        labs.where(F.col("itemid").isin(list(rules.LAB_ITEMS)) & F.col("valuenum").isNotNull()),
        cohort, hours, key="hadm_id",
    ).join(lab_items.select("itemid", "label"), "itemid")
    parts = [
        scores.select(*row("gcs", F.lit("total"), "charttime", "charttime", F.col("total"))),
        pressure.select(*row("map", line, "charttime", "charttime", F.col("valuenum"))),
        infusions.where(F.lower("label").isin(list(rules.VASOPRESSORS))).select(
            *row("vasopressor", F.col("label"), "starttime", "endtime", F.col("rate"))),
        infusions.where(contains_any(F.col("label"), rules.PRESSURE_DRUGS)).select(
            *row("icp_medication", F.col("label"), "starttime", "endtime", F.col("amount"))),
        done.where(F.col("itemid") == rules.VENTILATION).select(
            *row("ventilation", F.col("label"), "starttime", "endtime", F.lit(None))),
        done.where(F.col("itemid").isin(list(rules.NEUROSURGERY.values()))).select(
            *row("neurosurgery", F.col("label"), "starttime", "endtime", F.lit(None))),
        readings.select(*row("lab", F.col("label"), "charttime", "charttime", F.col("valuenum"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
