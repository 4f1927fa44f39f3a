"""Single-concept aggregates, group comparisons, summaries and profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.texts import contains_any, specimen_term
from caseweave.functions.times import days_between
from caseweave.operators import cohorts
from caseweave.operators import filters as fl
from caseweave.operators.joins import in_interval
from caseweave.operators.windows import with_share
from caseweave.plans.ordered import most_common, percentiles, value_at_rank
from caseweave.plans.sizes import take_bounded

AGGREGATES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "mean": ("mean_value", F.avg),
    "max": ("max_value", F.max),
    "min": ("min_value", F.min),
    "count": ("count_value", F.count),
    "sum": ("sum_value", F.sum),
}


def event_aggregate(readings: DataFrame, cohort: DataFrame, how: str) -> DataFrame:
    """One aggregate of a measured concept over a cohort.

    Each reading counts once, however many of its encounter's codes matched.
    """
    rows = fl.keep(readings, cohort)
    if how == "median":
        return percentiles(rows, [], "valuenum", {"median_value": 0.5})
    if how == "exists":
        return rows.agg((F.count(F.lit(1)) > 0).alias("exists_value"))
    name, fold = AGGREGATES[how]
    return rows.agg(fold(F.col("valuenum")).alias(name))


def screened_aggregate(screened: DataFrame, how: str, by: Sequence[str] = ()) -> DataFrame:
    """A2: the aggregate with and without implausible values, in one pass."""
    name, fold = AGGREGATES[how]
    value, clean = F.col("valuenum"), F.col("clean")
    return screened.groupBy(*by).agg(
        fold(F.when(clean, value)).alias(name),
        fold(value).alias(f"{name}_with_outliers"),
        F.count_if(~clean).alias("n_outliers"),
        F.count(value).alias("n_total"),
    )


def axis_values(
    encounters: DataFrame, subjects: DataFrame, axis: str
) -> DataFrame:
    """A3: (hadm_id, group_value) for a comparison axis.

    Subjects or labels are joined only when the axis needs them.
    """
    if axis in ("gender", "age"):
        column = "gender" if axis == "gender" else "anchor_age"
        return encounters.join(subjects, "subject_id").select(
            "hadm_id", F.col(column).alias("group_value")
        )
    if axis.startswith("readmitted_"):
        return cohorts.readmission_flags(encounters).select(
            "hadm_id", F.col(axis).alias("group_value")
        )
    return encounters.select("hadm_id", F.col(axis).alias("group_value"))


def condition_values(encounters: DataFrame, matching: DataFrame) -> DataFrame:
    """A4: (hadm_id, yes or no) by whether the encounter matches a condition."""
    hits = matching.select("hadm_id").distinct().withColumn("_hit", F.lit(True))
    return encounters.select("hadm_id").join(hits, "hadm_id", "left").select(
        "hadm_id", F.when(F.col("_hit"), "yes").otherwise("no").alias("group_value")
    )


def compare_values(readings: DataFrame, groups: DataFrame) -> DataFrame:
    """A3/A4: mean and count of readings per group."""
    return readings.join(groups, "hadm_id").groupBy("group_value").agg(
        F.avg("valuenum").alias("avg_value"), F.count("valuenum").alias("count")
    )


def encounter_count(rows: DataFrame, encounters: DataFrame) -> DataFrame:
    """Distinct encounters of the cohort that have a matching row."""
    return fl.keep(rows, encounters).agg(F.count_distinct("hadm_id").alias("count_value"))


def compare_encounters(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A5-A7 compared: distinct encounters per group."""
    hits = rows.select("hadm_id").distinct().join(groups, "hadm_id")
    return hits.groupBy("group_value").agg(F.count_distinct("hadm_id").alias("count"))


def cultures_of(
    cultures: DataFrame, names: Sequence[str], attributes: Sequence[str] = (),
    status: str | None = None,
) -> DataFrame:
    """Cultures whose specimen or organism matches a name and every attribute."""
    def either(terms: Sequence[str]) -> Column:
        plain = [specimen_term(t.strip()) for t in terms if t.strip()]
        return F.coalesce(contains_any(F.col("spec_type_desc"), plain), F.lit(False)) | F.coalesce(
            contains_any(F.col("org_name"), plain), F.lit(False)
        )

    rows = cultures.where(either(names))
    for attribute in attributes:
        if attribute.strip():
            rows = rows.where(either([attribute]))
    return fl.with_culture_status(rows, status)


def diagnoses_of(
    diagnoses: DataFrame, dictionary: DataFrame, names: Sequence[str],
    codes: Sequence[str] = (), principal_only: bool = False,
) -> DataFrame:
    """Diagnoses by code prefixes if given, otherwise by title or code text."""
    known = diagnoses.join(
        dictionary.select("icd_code", "icd_version").distinct(),
        ["icd_code", "icd_version"], "left_semi",
    )
    if codes:
        rows = known.where(fl.prefix_condition(any_version=codes))
    else:
        found = reduce(
            lambda a, b: a.unionByName(b), [fl.codes_like(dictionary, n) for n in names]
        ).distinct()
        rows = known.join(found, ["icd_code", "icd_version"], "left_semi")
    return rows.where(F.col("seq_num") == 1) if principal_only else rows


def diagnosis_list(
    diagnoses: DataFrame, dictionary: DataFrame, encounters: DataFrame, text: str
) -> DataFrame:
    """Subject, encounter, code and title of matching diagnoses, in order."""
    rows = cohorts.diagnosis_rows(diagnoses, dictionary, text, encounters)
    owners = encounters.select("hadm_id", "subject_id")
    return rows.join(owners, "hadm_id").select(
        F.col("subject_id").alias("subjectId"), F.col("hadm_id").alias("hadmId"),
        F.col("icd_code").alias("icdCode"), F.col("long_title").alias("longTitle"),
    ).orderBy("subjectId", "hadmId", "icdCode")


def outcome_rate(flags: DataFrame, flag: str, groups: DataFrame | None = None) -> DataFrame:
    """Encounters per flag value and their share, within each group if given."""
    if groups is None:
        counts = flags.groupBy(flag).agg(F.count_distinct("hadm_id").alias("count"))
        return with_share(counts)
    counts = flags.join(groups, "hadm_id").groupBy("group_value", flag).agg(
        F.count_distinct("hadm_id").alias("count")
    )
    return with_share(counts, within=["group_value"])


# --- summaries per encounter --------------------------------------------------------


def spread(value: Column) -> Column:
    """Population deviation, 0 for a single reading."""
    return F.when(F.count(value) > 1, F.stddev_pop(value)).otherwise(F.lit(0.0))


def abnormal(value: Column) -> Column:
    """1 when a value lies outside its own row's reference range."""
    low, high = F.col("ref_range_lower"), F.col("ref_range_upper")
    return F.when(value < low, 1.0).when(value > high, 1.0).otherwise(0.0)


def lab_summary(
    labs: DataFrame, dictionary: DataFrame, stays: DataFrame, cohort: DataFrame, few: bool | None = None
) -> DataFrame:
    """Statistics per encounter and label over readings inside a stay; ``few`` is handed on to :func:`in_interval`."""
    readings = labs.where(F.col("valuenum").isNotNull()).join(
        dictionary.select("itemid", "label"), "itemid"
    )
    rows = in_interval(readings, fl.keep(stays, cohort), "hadm_id", few=few)
    value, place = F.col("valuenum"), F.struct("charttime", "labevent_id", "valuenum")
    return rows.groupBy("hadm_id", "label").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        spread(value).alias("std"), F.count(value).alias("count"),
        F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last"),
        F.avg(abnormal(value)).alias("abnormal_rate"),
    )


def vital_summary(
    charts: DataFrame, dictionary: DataFrame, stays: DataFrame, cohort: DataFrame
) -> DataFrame:
    """Statistics per encounter and label over charted readings."""
    rows = (
        charts.where(F.col("valuenum").isNotNull())
        .select("stay_id", "itemid", "valuenum")
        .join(dictionary.select("itemid", "label"), "itemid")
        .join(fl.keep(stays, cohort).select("stay_id", "hadm_id"), "stay_id")
    )
    value = F.col("valuenum")
    stats = rows.groupBy("hadm_id", "label").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        spread(value).alias("std"), F.count(value).alias("count"),
    )
    variation = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.col("mean"))
    return stats.withColumn("cv", variation)


def medication_summary(cohort: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Distinct drugs and summed days per encounter, 0 without a prescription."""
    dated = prescriptions.where(F.col("starttime").isNotNull() & F.col("stoptime").isNotNull())
    sums = dated.groupBy("hadm_id").agg(
        F.count_distinct("drug").alias("num_distinct_meds"),
        F.sum(days_between("starttime", "stoptime")).alias("total_prescription_days"),
    )
    joined = cohort.select("hadm_id").distinct().join(sums, "hadm_id", "left")
    return joined.select(
        "hadm_id",
        F.coalesce("num_distinct_meds", F.lit(0)).alias("num_distinct_meds"),
        F.coalesce("total_prescription_days", F.lit(0.0)).alias("total_prescription_days"),
        F.col("num_distinct_meds").isNotNull().cast("int").alias("has_prescription"),
    )


def diagnosis_summary(cohort: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Number of diagnoses and first letter of the principal code."""
    principal = F.min(F.when(F.col("seq_num") == 1, F.col("icd_code")))
    sums = diagnoses.groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("num_diagnoses"),
        F.upper(F.substring(principal, 1, 1)).alias("primary_chapter"),
    )
    joined = cohort.select("hadm_id").distinct().join(sums, "hadm_id", "left")
    return joined.select(
        "hadm_id", F.coalesce("num_diagnoses", F.lit(0)).alias("num_diagnoses"),
        F.coalesce("primary_chapter", F.lit("Unknown")).alias("primary_chapter"),
    )


def widen(
    long: DataFrame, key: str, name: str, statistics: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """One row per key with a ``{name}_{statistic}`` column each.

    The names are given, so no extra pass looks for them.
    """
    columns = [
        F.max(F.when(F.col(name) == n, F.col(s))).alias(f"{n}_{s}")
        for n in names for s in statistics
    ]
    return long.groupBy(key).agg(*columns)


def one_hot_from_data(df: DataFrame, column: str, prefix: str, limit: int) -> DataFrame:
    """A 0/1 column per value found; the caller says how many columns the result may get."""
    found = take_bounded(
        df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column),
        limit, f"values of {column}",
    )
    flags = cohorts.one_hot(column, [r[0] for r in found], prefix, other=False)
    return df.drop(column).withColumns({}) if not flags else df.withColumns(flags).drop(column)


def categorical_domain(df: DataFrame, column: str) -> DataFrame:
    """Values and counts, most common first, then by value."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")
    )


def unpivoted(df: DataFrame, columns: Sequence[str], keep_columns: Sequence[str] = ()) -> DataFrame:
    """(kept columns, feature, value) rows of the given numeric columns."""
    numbers = df.select(*keep_columns, *[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot(list(keep_columns), list(columns), "feature", "value")


def reference_ranges(
    features: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """Robust range per feature; features without spread are dropped."""
    long = unpivoted(features, columns).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    bounds = percentiles(long, ["feature"], "value", {"low": low, "high": high})
    counts = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return bounds.join(counts, "feature").where(F.col("high") > F.col("low"))


def distribution(events: DataFrame, itemid: int, cohort: DataFrame, min_n: int = 1) -> DataFrame:
    """Count, mean, median, 95th percentile and usual unit of an item in a cohort."""
    rows = fl.keep(
        events.where((F.col("itemid") == itemid) & F.col("valuenum").isNotNull()), cohort
    ).select("itemid", "valuenum", "valueuom")
    counts = rows.groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("valuenum").alias("mean")
    )
    marks = percentiles(rows, ["itemid"], "valuenum", {"p50": 0.5, "p95": 0.95})
    units = most_common(rows, ["itemid"], "valueuom", "units")
    return (
        counts.where(F.col("n") >= min_n).join(marks, "itemid").join(units, "itemid", "left")
    )


def approximate_distribution(
    events: DataFrame, itemid: int, cohort: DataFrame, accuracy: int = 10000
) -> DataFrame:
    """A23, approximate: the same from a bounded sketch."""
    rows = fl.keep(
        events.where((F.col("itemid") == itemid) & F.col("valuenum").isNotNull()), cohort
    )
    marks = F.percentile_approx("valuenum", F.array(F.lit(0.5), F.lit(0.95)), accuracy)
    return rows.groupBy("itemid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("valuenum").alias("mean"), marks.alias("_marks")
    ).select("itemid", "n", "mean", F.col("_marks")[0].alias("p50"), F.col("_marks")[1].alias("p95"))


def catalog_rows(rows: DataFrame, keys: Sequence[str], ranges: bool) -> DataFrame:
    """Statistics per group: mean, values at ranks n/2 and 0.95n, usual unit and range."""
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("valuenum").alias("mean")
    )
    parts = [
        value_at_rank(rows, keys, "valuenum", {"p50": 0.5, "p95": 0.95}),
        most_common(rows, keys, "valueuom", "units"),
    ]
    if ranges:
        parts += [
            most_common(rows, keys, "ref_range_lower", "ref_lo"),
            most_common(rows, keys, "ref_range_upper", "ref_hi"),
        ]
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts, base)


def eligible_items(events: DataFrame, min_rows: int, top_n: int) -> DataFrame:
    """The most frequent items with enough readings."""
    return (
        events.where(F.col("valuenum").isNotNull()).groupBy("itemid")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
        .orderBy(F.col("n").desc(), "itemid").limit(top_n)
    )


def item_catalog(events: DataFrame, min_rows: int, top_n: int, ranges: bool = True) -> DataFrame:
    """Statistics of every eligible item."""
    rows = fl.keep(
        events.where(F.col("valuenum").isNotNull()), eligible_items(events, min_rows, top_n),
        "itemid",
    )
    return catalog_rows(rows, ["itemid"], ranges)


def cohort_memberships(
    diagnoses: DataFrame, cohorts_: Mapping[str, Mapping[str, Sequence[str]]] = rules.COHORTS
) -> DataFrame:
    """(hadm_id, cohort); an encounter may be in several cohorts.

    Cohorts are found for the distinct codes and joined back to the encounters.
    """
    names = F.array_compact(
        F.array(
            *[
                F.when(fl.prefix_condition(spec["icd10"], spec["icd9"]), F.lit(name))
                for name, spec in cohorts_.items()
            ]
        )
    )
    codes = diagnoses.select("icd_code", "icd_version").distinct().select(
        "icd_code", "icd_version", F.explode(names).alias("cohort")
    )
    return diagnoses.join(codes, ["icd_code", "icd_version"]).select("hadm_id", "cohort").distinct()


def stratified_catalog(
    events: DataFrame, diagnoses: DataFrame, min_rows: int, top_n: int, min_cohort_n: int
) -> DataFrame:
    """The catalog per cohort and for all encounters together."""
    rows = fl.keep(
        events.where(F.col("valuenum").isNotNull()), eligible_items(events, min_rows, top_n),
        "itemid",
    ).select("hadm_id", "itemid", "valuenum", "valueuom")
    in_cohorts = rows.join(cohort_memberships(diagnoses), "hadm_id")
    everyone = rows.withColumn("cohort", F.lit("all"))
    stats = catalog_rows(in_cohorts.unionByName(everyone), ["itemid", "cohort"], ranges=False)
    return stats.where((F.col("cohort") == "all") | (F.col("n") >= min_cohort_n))


def count_by(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), column)


def distinct_drugs(prescriptions: DataFrame, stays: DataFrame) -> DataFrame:
    """Distinct drugs per encounter with a stay."""
    return fl.keep(prescriptions, stays).groupBy("hadm_id").agg(
        F.count_distinct("drug").alias("n_drugs")
    )


def stay_hours(stays: DataFrame) -> DataFrame:
    """Hours of all closed stays of an encounter."""
    closed = stays.where(F.col("outtime").isNotNull())
    return closed.groupBy("hadm_id").agg(
        F.sum(days_between("intime", "outtime") * 24.0).alias("hours")
    )


def any_positive(df: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """1 when any row of the key is positive."""
    return df.groupBy(key).agg(F.max(label).alias(name))


# Parts of a feature name that mean "absent is 0".
ZERO_PARTS = (
    "_count", "num_", "has_", "total_", "gender_", "admission_type_", "icd_chapter_",
)


def fill_missing(df: DataFrame, skip: Sequence[str]) -> DataFrame:
    """Counts and flags get 0, other numbers the column's median.

    All medians come from one pass over (feature, value) rows; the result of that
    pass is one row per column.
    """
    numeric = [
        c for c, kind in df.dtypes
        if c not in skip and kind in ("int", "bigint", "double", "float")
    ]
    zeros = [c for c in numeric if any(part in c.lower() for part in ZERO_PARTS)]
    others = [c for c in numeric if c not in zeros]
    filled = df.fillna(0, zeros) if zeros else df
    if not others:
        return filled
    medians = {
        r["feature"]: r["median"]
        for r in percentiles(
            unpivoted(df, others), ["feature"], "value", {"median": 0.5}
        ).collect()
    }
    return filled.fillna({c: float(medians.get(c) or 0.0) for c in others})


def cohort_summary(labels: DataFrame) -> DataFrame:
    """Size, label and death counts, early share of status changes, medians."""
    change = F.col("hours_to_code_change")
    counts = labels.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("wlst_label").alias("n_positive"),
        F.avg("wlst_label").alias("positive_rate"),
        F.sum("hospital_expire_flag").alias("n_died"),
        F.avg("gcs_total").alias("gcs_mean"),
        F.min("gcs_total").alias("gcs_min"),
        F.max("gcs_total").alias("gcs_max"),
        F.count_if(change <= 48).alias("n_changed_48h"),
        F.avg(F.when(change.isNotNull(), (change <= 48).cast("int"))).alias("share_changed_48h"),
    )
    score = percentiles(labels, [], "gcs_total", {"gcs_median": 0.5})
    hours = percentiles(labels, [], "hours_to_code_change", {"hours_median": 0.5})
    # Three one-row results side by side.
    return counts.withColumns({
        "gcs_median": score.select("gcs_median").scalar(),
        "hours_median": hours.select("hours_median").scalar(),
    })


def flag_counts(encounters: DataFrame, flag: str = "hospital_expire_flag") -> DataFrame:
    """Distinct encounters per flag value; a missing flag is left out."""
    return encounters.where(F.col(flag).isNotNull()).groupBy(flag).agg(
        F.count_distinct("hadm_id").alias("count")
    )


# --- feature matrix profile -------------------------------------------------------------


def profile(df: DataFrame, columns: Sequence[str], low_variance: float = 0.01) -> DataFrame:
    """One row per feature: moments, quartiles, mode, missing share, variance class."""
    long = unpivoted(df, columns)
    value = F.col("value")
    stats = long.groupBy("feature").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value.isNull().cast("int")).alias("missing_share"),
        F.var_samp(value).alias("variance"),
    )
    quartiles = percentiles(
        long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    )
    modes = most_common(long, ["feature"], "value", "mode")
    kind = (
        F.when(F.col("variance") == 0, "zero")
        .when(F.col("variance") < low_variance, "low")
        .otherwise("normal")
    )
    return (
        stats.join(quartiles, "feature", "left").join(modes, "feature", "left")
        .withColumn("variance_class", kind)
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per label value and their share."""
    return with_share(df.groupBy(label).agg(F.count(F.lit(1)).alias("count")))


def label_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each feature with the label, strongest first."""
    long = unpivoted(df, columns, [label])
    both = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    return both.groupBy("feature").agg(
        F.corr("value", F.col(label).cast("double")).alias("correlation")
    ).orderBy(F.abs("correlation").desc_nulls_last(), "feature")


def rate_by(df: DataFrame, category: str, label: str) -> DataFrame:
    """Rows, positives and rate of a label per category."""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_positive"), F.avg(label).alias("rate")
    )


def subject_overview(subjects: DataFrame) -> DataFrame:
    """Subjects and mean age per gender."""
    return subjects.groupBy("gender").agg(
        F.count(F.lit(1)).alias("n"), F.avg("anchor_age").alias("mean_age")
    )


def readmission_overview(flags: DataFrame) -> DataFrame:
    """Encounters and how many were readmitted."""
    return flags.agg(
        F.count(F.lit(1)).alias("total"), F.sum("readmitted_30d").alias("readmitted_30d"),
        F.sum("readmitted_60d").alias("readmitted_60d"),
    )


def stay_length_overview(stays: DataFrame) -> DataFrame:
    """Number, mean, median, low and high of stay lengths."""
    base = stays.agg(
        F.count("los").alias("n"), F.avg("los").alias("mean_days"),
        F.min("los").alias("min_days"), F.max("los").alias("max_days"),
    )
    median = percentiles(stays, [], "los", {"median_days": 0.5})
    return base.withColumn("median_days", median.select("median_days").scalar())


def top_codes(diagnoses: DataFrame, dictionary: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent codes with their titles."""
    counts = diagnoses.groupBy("icd_code", "icd_version").agg(F.count(F.lit(1)).alias("count"))
    return (
        counts.join(dictionary, ["icd_code", "icd_version"], "left")
        .select("icd_code", "long_title", "count")
        .orderBy(F.col("count").desc(), "icd_code").limit(n)
    )


def one_subject(
    subjects: DataFrame, encounters: DataFrame, stays: DataFrame
) -> DataFrame:
    """The first subject with encounters: age, gender, encounter and stay counts."""
    first = encounters.agg(F.min("subject_id")).scalar()
    own = encounters.where(F.col("subject_id") == first)
    n_stays = fl.keep(stays, own).agg(F.count(F.lit(1))).scalar()
    n_encounters = own.agg(F.count(F.lit(1))).scalar()
    return subjects.where(F.col("subject_id") == first).select(
        "subject_id", "gender", "anchor_age",
        n_encounters.alias("n_encounters"), n_stays.alias("n_stays"),
    )
