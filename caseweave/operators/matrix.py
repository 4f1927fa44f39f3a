"""The feature matrix: one row per labelled encounter of a cohort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators import aggregates as ag, cohorts as co, filters as fl, graph as gr
from caseweave.operators import temporal as tp
from caseweave.operators.joins import few_per_key, merge_features
from caseweave.session import materialise

IDS = ("hadm_id", "subject_id")
LABELS = ("readmitted_30d", "readmitted_60d")
LAB_STATISTICS = ("mean", "min", "max", "std", "count", "first", "last", "abnormal_rate")
VITAL_STATISTICS = ("mean", "min", "max", "std", "cv", "count")


def stay_features(
    cohort: DataFrame, stays: DataFrame, admission_types: Sequence[str]
) -> DataFrame:
    """Hours and days over the encounter's stays, and its type as flags."""
    sums = stays.groupBy("hadm_id").agg(
        (F.sum("los") * 24.0).alias("icu_los_hours"),
        F.sum(tp.days_spanned("intime", "outtime")).alias("num_icu_days"),
    )
    flags = co.one_hot("admission_type", admission_types, "admission_type", other=False)
    return cohort.select("hadm_id", *[c.alias(n) for n, c in flags.items()]).join(
        sums, "hadm_id", "left"
    )


def diagnosis_features(
    cohort: DataFrame, diagnoses: DataFrame, chapters: Sequence[str]
) -> DataFrame:
    """Number of diagnoses and the principal code's chapter as flags."""
    flags = co.one_hot("primary_chapter", chapters, "icd_chapter")
    return ag.diagnosis_summary(cohort, diagnoses).select(
        "hadm_id", "num_diagnoses", *[c.alias(n) for n, c in flags.items()]
    )


def graph_features(record: gr.Record) -> DataFrame:
    """Neighbourhood of each encounter in the graph of encounters and stays."""
    edges = gr.encounter_edges(record.encounters).unionByName(gr.stay_edges(record.stays))
    seeds = record.encounters.select("hadm_id", gr.encounter_node().alias("id"))
    found = gr.subgraph_features(seeds, edges).select(
        F.col("seed").alias("id"), F.col("n_nodes").alias("patient_subgraph_nodes"),
        F.col("n_edges").alias("patient_subgraph_edges"),
        F.col("density").alias("patient_subgraph_density"),
        F.col("mean_degree").alias("mean_node_degree"),
        F.col("max_degree").alias("max_node_degree"),
    )
    return seeds.join(found, "id").drop("id")


def _labelled(events: DataFrame, items: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The readings and items of the labels that get columns, told by their item before the readings are joined to anything."""
    asked = items.where(F.col("label").isin(*names))
    return fl.keep(events, asked, "itemid"), asked


def _apart(features: DataFrame) -> DataFrame:
    """One row per encounter, handed over by a shuffle: what it is made of is dealt by encounter, too, and would otherwise
    be sorted in the same tasks as all other features."""
    return features.repartition("hadm_id")


def feature_matrix(
    record: gr.Record, cohort: DataFrame, *, lab_names: Sequence[str], vital_names: Sequence[str],
    admission_types: Sequence[str], chapters: Sequence[str], extra: Sequence[DataFrame] = (),
    fill: bool = True,
) -> DataFrame:
    """J15/IO10: labels, demographics and every feature group side by side.

    ``cohort`` has hadm_id.  The names of labels, types and chapters are given, so
    the columns are the same for every cohort; ``extra`` takes further frames keyed
    by hadm_id, such as concept flags.
    """
    # Written once: every feature group starts from the cohort's encounters and stays.
    encounters = materialise(fl.keep(record.encounters, cohort))
    stays = materialise(fl.keep(record.stays, encounters))
    own = replace(
        record, subjects=fl.keep(record.subjects, encounters, "subject_id"), encounters=encounters, stays=stays,
        **{n: fl.keep(getattr(record, n), encounters) for n in ("labs", "charts", "prescriptions", "cultures")},
    )
    labels = fl.keep(co.readmission_labels(record.encounters), encounters).select(
        "hadm_id", "subject_id", *LABELS
    )
    people = co.ages(own.subjects, encounters).join(
        own.subjects.select("subject_id", "gender"), "subject_id"
    )
    genders = {n: c for n, c in co.gender_flags().items() if n != "gender_unknown"}
    labs, lab_items = _labelled(record.labs, record.lab_items, lab_names)
    charts, chart_items = _labelled(record.charts, record.chart_items, vital_names)
    # Asked once for both readers of the labs.
    few = few_per_key(own.labs, own.stays, "hadm_id")
    frames = [
        people.select("hadm_id", "age", *[c.alias(n) for n, c in genders.items()]),
        stay_features(encounters, own.stays, admission_types),
        _apart(ag.widen(
            ag.lab_summary(fl.keep(labs, encounters), lab_items, own.stays, encounters, few), "hadm_id",
            "label", LAB_STATISTICS, lab_names,
        )),
        _apart(ag.widen(
            ag.vital_summary(fl.keep(charts, encounters), chart_items, own.stays, encounters), "hadm_id",
            "label", VITAL_STATISTICS, vital_names,
        )),
        _apart(ag.medication_summary(encounters, own.prescriptions)),
        # Codes are counted per encounter before they are shuffled; those of other encounters are not joined.
        _apart(diagnosis_features(encounters, record.diagnoses, chapters)),
        _apart(tp.temporal_features(encounters, own.labs, own.charts, own.stays, few)),
        graph_features(own),
        *extra,
    ]
    matrix = merge_features(labels, frames)
    if not fill:
        return matrix
    # Written once: the medians and the filled rows read it back.
    return ag.fill_missing(materialise(matrix), [*IDS, *LABELS])
