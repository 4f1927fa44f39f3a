"""The clinical graph as node and edge rows.

A node is ``(id, type, ...)`` and an edge ``(src, predicate, dst)``; the typed
form for learning adds the two node types and a time difference in days.  Ids
are made from the row's own key, so nodes and edges are written without any
lookup, and merging partial graphs is a union.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.texts import slug
from caseweave.functions.times import days_between
from caseweave.operators import codes as cd, filters as fl
from caseweave.operators.cohorts import readmission_flags
from caseweave.operators.evaluation import split_subjects
from caseweave.operators.joins import MOST_COMPARED, assign_stay
from caseweave.operators.observation import charlson
from caseweave.operators.temporal import day_of, stay_days, with_day
from caseweave.operators.windows import followed_by, top_per_group
from caseweave.plans.fixpoint import components
from caseweave.plans.ordered import numbered, percentiles
from caseweave.plans.sizes import has_hot_group
from caseweave.session import materialise


def node_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[p.cast("string") for p in parts])


def stamp(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyyMMddHHmmss"), F.lit("nostart"))


def subject_node() -> Column:
    return node_id("PA", F.col("subject_id"))


def encounter_node(hadm_id: str = "hadm_id") -> Column:
    return node_id("HA", F.col(hadm_id))


def stay_node() -> Column:
    return node_id("IS", F.col("stay_id"))


def day_node() -> Column:
    return F.concat(
        F.lit("ID-"), F.col("stay_id").cast("string"), F.lit("-D"),
        F.col("day_number").cast("string"),
    )


def link(rows: DataFrame, src: Column, predicate: str, dst: Column) -> DataFrame:
    return rows.select(src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"))


def both_ways(rows: DataFrame, src: Column, there: str, dst: Column, back: str) -> DataFrame:
    """Edges in both directions, from one pass over the rows."""
    return rows.select(F.inline(F.array(*_there_and_back(src, there, dst, back))))


def _there_and_back(src: Column, there: str, dst: Column, back: str) -> list[Column]:
    return [
        F.struct(src.alias("src"), F.lit(there).alias("predicate"), dst.alias("dst")),
        F.struct(dst.alias("src"), F.lit(back).alias("predicate"), src.alias("dst")),
    ]


# --- nodes and edges of the record ------------------------------------------------------


def subject_nodes(subjects: DataFrame) -> DataFrame:
    """G1: subjects with gender and age."""
    return subjects.select(
        subject_node().alias("id"), F.lit("Patient").alias("type"), "subject_id", "gender",
        F.col("anchor_age").alias("age"),
    )


def encounter_nodes(encounters: DataFrame, all_encounters: DataFrame | None = None) -> DataFrame:
    """G1: encounters as intervals with labels and admission attributes."""
    flags = readmission_flags(all_encounters if all_encounters is not None else encounters)
    return encounters.join(flags, "hadm_id").select(
        encounter_node().alias("id"), F.lit("HospitalAdmission").alias("type"), "hadm_id", "subject_id",
        F.col("admittime").alias("start_ts"), F.col("dischtime").alias("end_ts"),
        "admission_type", "discharge_location", "hospital_expire_flag",
        "readmitted_30d", "readmitted_60d",
    )


def encounter_edges(encounters: DataFrame) -> DataFrame:
    """Subject-encounter links both ways, and each encounter's successor."""
    owned = both_ways(encounters, subject_node(), "hasAdmission", encounter_node(), "admissionOf")
    order = link(
        followed_by(encounters), encounter_node(), "followedBy", encounter_node("next_hadm_id")
    )
    return owned.unionByName(order)


def stay_nodes(stays: DataFrame) -> DataFrame:
    """Stays as intervals with their length in days."""
    return stays.select(
        stay_node().alias("id"), F.lit("ICUStay").alias("type"), "stay_id", "hadm_id",
        F.col("intime").alias("start_ts"), F.col("outtime").alias("end_ts"),
        F.col("los").alias("days"),
    )


def stay_edges(stays: DataFrame) -> DataFrame:
    """Encounter-stay and stay-day links."""
    days = both_ways(stay_days(stays), stay_node(), "hasICUDay", day_node(), "partOf")
    return both_ways(stays, encounter_node(), "containsICUStay", stay_node(), "partOf").unionByName(days)


def day_nodes(stays: DataFrame) -> DataFrame:
    """T5 as nodes: days of stays."""
    return stay_days(stays).select(
        day_node().alias("id"), F.lit("ICUDay").alias("type"), "stay_id", "day_number",
        F.col("day_begin").alias("start_ts"), F.col("day_end").alias("end_ts"),
    )


EVENT_FIELDS = ("id", "type", "hadm_id", "stay_id", "day_number", "name", "start_ts", "end_ts",
                "value", "unit", "concept_key")


def _event_rows(
    rows: DataFrame, kind: str, id_: Column, name: Column, start: str, end: str | None,
    value: Column | None, unit: Column | None, key: Column, by: Sequence[str] = (),
) -> DataFrame:
    """One row per event id; a repeated key keeps its smallest row.

    Rows that differ in ``by`` have different ids, so rows that lie together by it are not shuffled again.
    """
    varying = {
        "hadm_id": F.col("hadm_id"), "stay_id": F.col("stay_id"), "day_number": F.col("day_number"), "name": name,
        "start_ts": F.col(start),
        **({"end_ts": F.col(end)} if end else {}),
        **({} if value is None else {"value": value.cast("double")}),
        **({} if unit is None else {"unit": unit.cast("string")}),
        "concept_key": key.cast("string"),
    }
    rest = F.struct(*[c for c in varying if c not in by])
    least = rows.select(id_.alias("id"), *[c.alias(n) for n, c in varying.items()]).groupBy(*by, "id").agg(
        F.min(rest).alias("_r")
    )
    fixed = {
        "type": F.lit(kind), "end_ts": F.col("_r.start_ts"), "value": F.lit(None).cast("double"), "unit": F.lit(None).cast("string"),
    }
    return least.select("id", *[
        F.col(c) if c in by else (F.col(f"_r.{c}") if c in varying else fixed[c]).alias(c) for c in EVENT_FIELDS if c != "id"
    ])


def plain_stays(stays: DataFrame) -> bool:
    """True when every stay has an id of its own, ids are whole numbers and no encounter has many stays."""
    whole = {dict(stays.dtypes)[c] for c in ("stay_id", "hadm_id")} <= {"bigint", "int", "smallint", "tinyint"}
    return whole and not any(
        has_hot_group(stays.where(F.col(c).isNotNull()).select(c), [c], most) for c, most in (("stay_id", 1), ("hadm_id", MOST_COMPARED))
    )


def _placed(
    events: DataFrame, source: DataFrame, stays: DataFrame, time: str = "charttime", plain: bool | None = None
) -> tuple[DataFrame, tuple[str, ...]]:
    """J8 and T6 together: events of a stay with its day, and what rows of one event id have in common.

    Where stays are plain (:func:`plain_stays`, unless the caller knows it) and no encounter has more events than one
    task should take, events meet the few stays of their encounter, sorted, by the encounter alone; what lies together by
    encounter stays so.  ``source`` has the events before they were narrowed and is all that is counted.  Otherwise they meet on the time line of :func:`assign_stay`, and their days by stay.
    """
    plain = plain_stays(stays) if plain is None else plain
    if not plain or has_hot_group(source.select("hadm_id").where("hadm_id IS NOT NULL"), ["hadm_id"]):
        return with_day(assign_stay(events, stays, time), stays, time), ()
    open_end = F.lit("9999-12-31 00:00:00").cast(dict(stays.dtypes)["outtime"])
    held = stays.where("hadm_id IS NOT NULL AND intime IS NOT NULL").groupBy("hadm_id").agg(
        F.sort_array(F.collect_list(F.struct("intime", "stay_id", "outtime"))).alias("_stays")
    )
    at = F.col(time)
    first = F.get(F.filter(
        "_stays", lambda s: (s["intime"] <= at) & (at <= F.coalesce(s["outtime"], open_end))
    ), F.lit(0))
    known = events.drop("stay_id", "intime", "outtime").where(F.col("hadm_id").isNotNull() & at.isNotNull())
    found = known.join(held, "hadm_id").withColumn("_stay", first)
    return found.where("_stay.stay_id IS NOT NULL").withColumns({
        "stay_id": F.col("_stay.stay_id"), "day_number": day_of(at, F.col("_stay.intime"), F.col("_stay.outtime")),
    }).drop("_stays", "_stay"), ("hadm_id",)


def lab_nodes(labs: DataFrame, dictionary: DataFrame, stays: DataFrame, plain: bool | None = None) -> DataFrame:
    """Laboratory readings inside a stay, with its day."""
    named = labs.where(F.col("valuenum").isNotNull()).join(
        dictionary.select("itemid", "label"), "itemid"
    )
    placed, by = _placed(named, labs, stays, plain=plain)
    return _event_rows(
        placed, "lab", node_id("BME", F.col("stay_id"), F.col("itemid"), stamp(F.col("charttime"))),
        F.col("label"), "charttime", None, F.col("valuenum"), F.col("valueuom"), F.col("itemid"), by,
    )


def vital_nodes(charts: DataFrame, dictionary: DataFrame, stays: DataFrame, plain: bool | None = None) -> DataFrame:
    """Charted readings of a stay."""
    named = charts.where(F.col("valuenum").isNotNull()).join(
        dictionary.select("itemid", "label"), "itemid"
    )
    plain = plain_stays(stays) if plain is None else plain
    return _event_rows(
        with_day(named, stays), "vital",
        node_id("CSE", F.col("stay_id"), F.col("itemid"), stamp(F.col("charttime"))),
        F.col("label"), "charttime", None, F.col("valuenum"), None, F.col("itemid"), ("stay_id",) if plain else (),
    )


def culture_nodes(cultures: DataFrame, stays: DataFrame, plain: bool | None = None) -> DataFrame:
    """Cultures taken inside a stay."""
    # The same id may come in several encounters.
    placed, _ = _placed(cultures, cultures, stays, plain=plain)
    return _event_rows(
        placed, "microbiology", node_id("MBE", F.col("microevent_id")),
        F.col("spec_type_desc"), "charttime", None, None, None,
        F.col("org_name"),
    )


def prescription_nodes(prescriptions: DataFrame, stays: DataFrame, plain: bool | None = None) -> DataFrame:
    """One interval per encounter, drug and start, inside a stay."""
    dated = prescriptions.where(F.col("starttime").isNotNull())
    once = dated.groupBy("hadm_id", "drug", "starttime").agg(
        F.min(F.struct("stoptime", "dose_val_rx", "dose_unit_rx", "route")).alias("_r")
    ).select("hadm_id", "drug", "starttime", "_r.*")
    placed, by = _placed(once, prescriptions, stays, "starttime", plain)
    return _event_rows(
        placed, "drug", node_id("RXE", F.col("hadm_id"), slug(F.col("drug")), stamp(F.col("starttime"))),
        F.col("drug"), "starttime", "stoptime", F.col("dose_val_rx"), F.col("dose_unit_rx"),
        F.lower("drug"), by,
    )


def diagnosis_nodes(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One node per encounter and sequence number."""
    least = diagnoses.groupBy("hadm_id", "seq_num").agg(F.min(F.struct("icd_code", "icd_version")).alias("_r"))
    title = F.min(F.struct("long_title")).alias("_t")
    titles = dictionary.groupBy("icd_code", "icd_version").agg(title).select(
        "icd_code", "icd_version", F.col("_t.long_title").alias("long_title")
    )
    return least.select("hadm_id", "seq_num", "_r.*").join(titles, ["icd_code", "icd_version"], "left").select(
        node_id("DXE", F.col("hadm_id"), F.col("seq_num")).alias("id"),
        F.lit("diagnosis").alias("type"), "hadm_id", "seq_num", "icd_code", "icd_version", "long_title",
    )


def comorbidity_nodes(
    diagnoses: DataFrame, encounters: DataFrame, prefixes: DataFrame,
    categories: Sequence[str] = tuple(rules.CHARLSON),
) -> DataFrame:
    """Categories present in a subject's pooled diagnoses."""
    pooled = diagnoses.join(encounters.select("hadm_id", "subject_id"), "hadm_id").select(
        F.col("subject_id").alias("hadm_id"), "icd_code", "icd_version"
    )
    flags = charlson(pooled, prefixes, categories)
    present = F.array_compact(
        F.array(*[F.when(F.col(f"charlson_{c}") == 1, F.lit(c)) for c in categories])
    )
    return flags.select(F.col("hadm_id").alias("subject_id"), F.explode(present).alias("name")).select(
        node_id("CM", F.col("subject_id"), F.col("name")).alias("id"),
        F.lit("Comorbidity").alias("type"), "subject_id", "name",
    )


def neuro_nodes(window_events: DataFrame, stays: DataFrame) -> DataFrame:
    """Events of the observation window as nodes, with their day."""
    keyed = window_events.withColumn("hadm_id", F.lit(None).cast("bigint")).join(
        stays.select("stay_id", F.col("hadm_id").alias("_h")), "stay_id"
    ).withColumn("hadm_id", F.col("_h")).drop("_h")
    placed = with_day(keyed, stays, "start_ts")
    prefix = F.upper("kind")
    return _event_rows(
        placed, "neuro",
        F.concat_ws("-", prefix, F.col("stay_id").cast("string"), slug(F.col("name")),
                    stamp(F.col("start_ts"))),
        F.col("name"), "start_ts", "end_ts", F.col("value"), None, F.col("kind"),
    )


def event_edges(events: DataFrame) -> DataFrame:
    """Events linked both ways to their stay and, if they have one, their day, from one pass over the events."""
    to_stay = _there_and_back(F.col("id"), "associatedWithICUStay", stay_node(), "hasICUStayEvent")
    to_day = _there_and_back(F.col("id"), "associatedWithICUDay", day_node(), "hasICUDayEvent")
    dated = F.col("day_number").isNotNull()
    return events.select(F.inline(F.when(dated, F.array(*to_stay, *to_day)).otherwise(F.array(*to_stay))))


def diagnosis_edges(nodes: DataFrame) -> DataFrame:
    """Encounter-diagnosis links."""
    return both_ways(nodes, encounter_node(), "hasDiagnosis", F.col("id"), "diagnosisOf")


def comorbidity_edges(nodes: DataFrame) -> DataFrame:
    """Subject-comorbidity links."""
    return both_ways(nodes, subject_node(), "hasComorbidity", F.col("id"), "comorbidityOf")


@dataclass(frozen=True)
class Record:
    """The clinical tables a graph is built from."""

    subjects: DataFrame
    encounters: DataFrame
    stays: DataFrame
    labs: DataFrame
    lab_items: DataFrame
    charts: DataFrame
    chart_items: DataFrame
    prescriptions: DataFrame
    diagnoses: DataFrame
    diagnosis_titles: DataFrame
    cultures: DataFrame
    comorbidity_prefixes: DataFrame

    def restricted(self, cohort: DataFrame) -> Record:
        """The same tables for the encounters of a cohort."""
        own = fl.keep(self.encounters, cohort)
        return Record(
            fl.keep(self.subjects, own, "subject_id"), own, fl.keep(self.stays, own),
            fl.keep(self.labs, own), self.lab_items, fl.keep(self.charts, own), self.chart_items,
            fl.keep(self.prescriptions, own), fl.keep(self.diagnoses, own),
            self.diagnosis_titles, fl.keep(self.cultures, own), self.comorbidity_prefixes,
        )


def event_nodes(record: Record) -> DataFrame:
    """G19-G22 together."""
    plain = plain_stays(record.stays)
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            lab_nodes(record.labs, record.lab_items, record.stays, plain),
            vital_nodes(record.charts, record.chart_items, record.stays, plain),
            culture_nodes(record.cultures, record.stays, plain),
            prescription_nodes(record.prescriptions, record.stays, plain),
        ],
    )


def cohort_nodes(record: Record) -> DataFrame:
    """(id, type) of every node of a record."""
    parts = [
        subject_nodes(record.subjects), encounter_nodes(record.encounters),
        stay_nodes(record.stays), day_nodes(record.stays), event_nodes(record),
        diagnosis_nodes(record.diagnoses, record.diagnosis_titles),
        comorbidity_nodes(record.diagnoses, record.encounters, record.comorbidity_prefixes),
    ]
    return reduce(lambda a, b: a.unionByName(b), [p.select("id", "type") for p in parts])


def cohort_edges(record: Record) -> DataFrame:
    """Every edge of a record."""
    parts = [
        encounter_edges(record.encounters), stay_edges(record.stays),
        event_edges(event_nodes(record)),
        diagnosis_edges(diagnosis_nodes(record.diagnoses, record.diagnosis_titles)),
        comorbidity_edges(
            comorbidity_nodes(record.diagnoses, record.encounters, record.comorbidity_prefixes)
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_graphs(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of edge sets, each edge once."""
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(
        ["src", "predicate", "dst"]
    )


# --- measures of the graph ----------------------------------------------------------------


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per type."""
    return nodes.groupBy("type").agg(F.count_distinct("id").alias("count")).orderBy(
        F.col("count").desc(), "type"
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per predicate."""
    return edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "predicate"
    )


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair of nodes."""
    return edges.select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree of every node that has an edge."""
    ends = simple_edges(edges).select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """Mean, median, largest and sample deviation of the degrees."""
    rows = degrees(edges)
    median = percentiles(rows, [], "degree", {"median": 0.5}).select("median").scalar()
    return rows.agg(
        F.avg("degree").alias("mean"), F.max("degree").alias("max"),
        F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("std"),
    ).withColumn("median", median)


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component), a component named by its smallest node."""
    return components(edges)


def neighbourhoods(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, node) within a number of undirected steps, the seed included.

    The rows are the answer itself; past one step a hub's neighbours reach each
    other, so ask for more steps with few seeds.
    """
    around = edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ).distinct()
    reached = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct()
    frontier = reached
    for _ in range(hops):
        step = frontier.join(around, F.col("node") == F.col("src")).select(
            "seed", F.col("dst").alias("node")
        ).distinct()
        frontier = step.join(reached, ["seed", "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached


def linked_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs (x < y) with the number of directed edges between them, one or two.

    Edges that stand together in both directions are one row before they are shuffled.
    """
    way = F.when(F.col("src") < F.col("dst"), 1).otherwise(0)
    return edges.where(F.col("src") != F.col("dst")).groupBy(
        F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")
    ).agg((F.max(way) + F.max(1 - way)).cast("bigint").alias("m"))


def triangles(pairs: DataFrame) -> DataFrame:
    """Triples of mutually linked nodes (u, v, w) with the edges of each side.

    A node with one link is in none.  Every pair points from the node with fewer links to the one with more, which
    leaves at most the square root of twice the pairs at any node; only those few
    are combined, so a hub is never paired with all of its neighbours at once.
    """
    ends = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    links = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = pairs.join(links.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y").join(
        links.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x"
    )
    up = F.struct("nx", "x") < F.struct("ny", "y")
    out = sized.select(
        F.when(up, F.col("x")).otherwise(F.col("y")).alias("u"),
        F.when(up, F.col("y")).otherwise(F.col("x")).alias("to"), "m",
    )
    wedges = out.select("u", F.col("to").alias("v"), F.col("m").alias("m_uv")).join(
        out.select("u", F.col("to").alias("w"), F.col("m").alias("m_uw")), "u"
    ).where(F.col("v") < F.col("w"))
    closing = pairs.select(F.col("x").alias("v"), F.col("y").alias("w"), F.col("m").alias("m_vw"))
    return wedges.join(closing, ["v", "w"])


#: So many first letters of an id tell kinds of nodes apart; of more kinds than that nothing is told.
KIND_LETTERS, MOST_KINDS = 3, 64


def of_kinds(ids: DataFrame, *columns: str) -> list[Column]:
    """For each column, whether its id begins as some id of ``ids`` does; what does not is none of them."""
    def kind(column: str) -> Column:
        return F.substring(F.col(column).cast("string"), 1, KIND_LETTERS)

    found = [r[0] for r in ids.select(kind("id")).distinct().take(MOST_KINDS + 1)]
    if len(found) > MOST_KINDS:
        return [F.lit(True) for _ in columns]
    return [kind(c).isin(*found) for c in columns]


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def _seeded_pairs(asked: DataFrame, edges: DataFrame) -> tuple[DataFrame, Column]:
    """Linked pairs that the neighbourhoods of the seeds need, with marks of the seeds among their ends, and a test of
    ``seed`` that every seed passes.

    Where the edges have no other nodes of the seeds' kinds, a seed is told by its kind, and pairs are not joined to
    the seeds and their neighbours; those of neighbouring kinds that are near no seed only form triangles without one.
    """
    src_kind, dst_kind, own_kind, x_kind, y_kind, seed_kind = of_kinds(asked, "src", "dst", "id", "x", "y", "seed")
    touching = edges.where(src_kind | dst_kind)
    ends = linked_pairs(touching).select(F.inline(F.array(
        F.struct(F.col("x").alias("id"), F.col("y").alias("other")), F.struct(F.col("y").alias("id"), F.col("x").alias("other")),
    ))).where(own_kind)
    if _ends(edges).where(own_kind).distinct().join(asked, "id", "left_anti").isEmpty():
        src_near, dst_near = of_kinds(_ends(touching), "src", "dst")
        pairs = linked_pairs(edges.where(src_near & dst_near))
        return materialise(pairs.withColumns({"seed_x": x_kind, "seed_y": y_kind})), seed_kind
    around = materialise(
        ends.join(asked, "id", "left_semi").select(F.col("other").alias("id"), F.lit(False).alias("seed"))
        .unionByName(asked.withColumn("seed", F.lit(True))).groupBy("id").agg(F.max("seed").alias("seed"))
    )
    src_kind, dst_kind = of_kinds(around, "src", "dst")
    pairs = linked_pairs(edges.where(src_kind & dst_kind))
    return materialise(pairs.join(around.select(F.col("id").alias("x"), F.col("seed").alias("seed_x")), "x").join(
        around.select(F.col("id").alias("y"), F.col("seed").alias("seed_y")), "y"
    ).select("x", "y", "m", "seed_x", "seed_y")), seed_kind


def subgraph_features(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and degrees of each seed's one-step neighbourhood.

    One step is what the published features contain.  An edge lies inside the
    neighbourhood of its own ends and of every node it forms a triangle with, so
    the degrees come from the edges and the triangles.  Edges whose ends are of other kinds than the nodes looked for
    are left out before anything is shuffled.
    """
    # Only what lies within one step of a seed is counted, so other triangles are never built.
    asked = seeds.select("id").where("id IS NOT NULL").distinct()
    pairs, of_seed = _seeded_pairs(asked, edges)
    own = pairs.select(F.inline(F.array(
        F.struct(F.when(F.col("seed_x"), F.col("x")).alias("seed"), "m"),
        F.struct(F.when(F.col("seed_y"), F.col("y")).alias("seed"), "m"),
    ))).where("seed IS NOT NULL").groupBy("seed").agg(
        F.count(F.lit(1)).alias("links"), F.sum("m").alias("own"), F.max("m").alias("most")
    )

    def rows(*parts: tuple[str, str, str, str]) -> Column:
        """(seed, node, links of the node to the third corner, links of the node to the seed)."""
        return F.inline(F.array(*[
            F.struct(F.col(s).alias("seed"), F.col(n).alias("node"), F.col(d).alias("d"), F.col(m).alias("m"))
            for s, n, d, m in parts
        ]))

    # In a triangle that has a seed; corners that are not asked for fall away in the last join.
    across = triangles(pairs.select("x", "y", "m")).select(rows(
        ("u", "v", "m_vw", "m_uv"), ("u", "w", "m_vw", "m_uw"), ("v", "u", "m_uw", "m_uv"), ("v", "w", "m_uw", "m_vw"),
        ("w", "u", "m_uv", "m_uw"), ("w", "v", "m_uv", "m_vw"),
    )).where(of_seed).groupBy("seed", "node").agg(F.sum("d").alias("d"), F.max("m").alias("m")).groupBy("seed").agg(
        F.sum("d").alias("across"), F.max(F.col("d") + F.col("m")).alias("most_across")
    )
    totals = own.join(across, "seed", "left").select(
        "seed", (F.col("links") + 1).alias("_n"),
        (F.col("own") * 2 + F.coalesce("across", F.lit(0))).alias("_sum"),
        F.greatest("own", "most", "most_across").alias("_max"),
    )
    asked = seeds.select(F.col("id").alias("seed")).distinct().join(totals, "seed", "left")
    n = F.coalesce("_n", F.lit(1))
    n_edges = F.coalesce(F.col("_sum") / 2, F.lit(0.0))
    return asked.select(
        "seed", n.alias("n_nodes"), n_edges.cast("bigint").alias("n_edges"),
        density(n_edges, n).alias("density"),
        F.when(n > 1, F.col("_sum") / n).otherwise(0.0).alias("mean_degree"),
        F.when(n > 1, F.col("_max")).otherwise(0).alias("max_degree"),
    )


def wider_subgraph_features(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """As :func:`subgraph_features`, within ``hops`` undirected steps of each seed.

    All links of a node that is reached before the last step lead to members, so its degree inside is its
    degree in the whole graph, and its links are not looked at.  A node of the last step has the links it was
    reached by, and those to other nodes of the last step; the latter are found from the end with fewer
    links, so a hub's links are not gone through for each seed around it.  The members themselves are counted,
    so there are rows for every (seed, member).
    """
    if hops < 1:
        raise ValueError("at least one step")
    pairs = materialise(linked_pairs(edges))
    around = pairs.select(F.inline(F.array(
        F.struct(F.col("x").alias("src"), F.col("y").alias("dst"), "m"),
        F.struct(F.col("y").alias("src"), F.col("x").alias("dst"), "m"),
    )))
    whole = around.groupBy(F.col("src").alias("node")).agg(F.sum("m").alias("d"))
    asked = seeds.select(F.col("id").alias("seed")).where("seed IS NOT NULL").distinct()
    reached = frontier = asked.withColumn("node", F.col("seed"))
    inner = None
    for _ in range(hops):
        inner = reached
        met = frontier.join(around, F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(
            F.sum("m").alias("d")
        )
        frontier = materialise(met.join(reached, ["seed", "node"], "left_anti"))
        reached = reached.unionByName(frontier.select("seed", "node"))
    last = frontier.select("seed", "node")
    # Links among nodes that are the last for some seed; the others are in no inner edge of a last step.
    ends = last.select("node").distinct()
    among = materialise(pairs.join(ends.withColumnRenamed("node", "x"), "x", "left_semi").join(
        ends.withColumnRenamed("node", "y"), "y", "left_semi"
    ))
    links = among.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    sized = among.join(links.select(F.col("node").alias("x"), F.col("n").alias("n_x")), "x").join(
        links.select(F.col("node").alias("y"), F.col("n").alias("n_y")), "y"
    )
    up = F.struct("n_x", "x") < F.struct("n_y", "y")
    upward = sized.select(
        F.when(up, F.col("x")).otherwise(F.col("y")).alias("src"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("dst"), "m"
    )
    across = last.join(upward, F.col("node") == F.col("src")).select("seed", "src", "dst", "m").join(
        last.withColumnRenamed("node", "dst"), ["seed", "dst"]
    ).select("seed", F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.col("m").alias("d")), F.struct(F.col("dst").alias("node"), F.col("m").alias("d")),
    )))
    # A node without links counts with none.
    inside = inner.join(whole, "node", "left").select("seed", "node", "d")
    degree = inside.unionByName(frontier).unionByName(across).groupBy("seed", "node").agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("_d")
    )
    totals = degree.groupBy("seed").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_sum"), F.max("_d").alias("_max")
    )
    n, n_edges = F.col("_n"), F.col("_sum") / 2
    return totals.select(
        "seed", n.alias("n_nodes"), n_edges.cast("bigint").alias("n_edges"), density(n_edges, n).alias("density"),
        F.when(n > 1, F.col("_sum") / n).otherwise(0.0).alias("mean_degree"), F.col("_max").alias("max_degree"),
    )


def density(n_edges: Column, n_nodes: Column) -> Column:
    """Edges as a share of the possible ordered pairs."""
    possible = n_nodes.cast("double") * (n_nodes - 1)
    return F.when(n_nodes > 1, n_edges / F.when(n_nodes > 1, possible)).otherwise(F.lit(0.0))


def density_class(edges: DataFrame, n_nodes: Column) -> DataFrame:
    """Density of a node set's edges and its class."""
    value = F.col("density")
    kind = (
        F.when(value < 0.01, "too_sparse").when(value <= 0.10, "optimal")
        .when(value <= 0.30, "dense").otherwise("too_dense")
    )
    return (
        edges.agg(F.count(F.lit(1)).alias("num_edges")).withColumn("_n", n_nodes)
        .select("num_edges", density(F.col("num_edges"), F.col("_n")).alias("density"))
        .withColumn("category", kind)
    )


# --- typed graph for learning ---------------------------------------------------------------


def dense_ids(nodes: DataFrame, kind: str = "type", key: str = "id") -> DataFrame:
    """Consecutive numbers from 0 within each type, in key order."""
    keys = nodes.select(kind, key).distinct()
    return numbered(keys, [kind], [key], "index").withColumn("index", F.col("index") - 1)


def concept_keys(rows: DataFrame, kind: str, fallback: str = "concept_key") -> DataFrame:
    """Events by concept, or by a key of their own when they have none."""
    own = F.concat(F.lit(f"unmapped:{kind}:"), F.coalesce(F.col(fallback), F.lit("None")))
    return rows.withColumn("concept", F.coalesce(F.col("concept_id"), own))


def concept_statistics(rows: DataFrame, concept: str = "concept") -> DataFrame:
    """Mean, sample deviation, range and abnormal share per concept."""
    value = F.col("valuenum")
    outside = F.coalesce(value < F.col("ref_range_lower"), F.lit(False)) | F.coalesce(
        value > F.col("ref_range_upper"), F.lit(False)
    )
    return rows.where(value.isNotNull()).groupBy(concept).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(outside.cast("int")).alias("abnormal_rate"),
    )


TYPED = ("src_type", "rel", "dst_type", "src_id", "dst_id", "delta_days")


def typed(
    rows: DataFrame, src_type: str, rel: str, dst_type: str, src: Column, dst: Column,
    delta: Column | None = None,
) -> DataFrame:
    return rows.select(
        F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"),
        F.lit(dst_type).alias("dst_type"), src.cast("string").alias("src_id"),
        dst.cast("string").alias("dst_id"),
        (F.lit(None) if delta is None else delta).cast("double").alias("delta_days"),
    )


def structural_edges(encounters: DataFrame, stays: DataFrame) -> DataFrame:
    """Subject-encounter, encounter-stay, stay-day, and encounter-next edges.

    The time of a next-encounter edge runs from start to start.
    """
    parts = [
        typed(encounters, "patient", "has_admission", "admission", subject_node(), encounter_node()),
        typed(stays, "admission", "contains_icu_stay", "icu_stay", encounter_node(), stay_node()),
        typed(stay_days(stays), "icu_stay", "has_icu_day", "icu_day", stay_node(), day_node()),
        typed(
            followed_by(encounters), "admission", "followed_by", "admission", encounter_node(),
            encounter_node("next_hadm_id"), days_between("admittime", "next_admittime"),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def clinical_edges(events: DataFrame, encounters: DataFrame, kind: str) -> DataFrame:
    """Day-concept edges, timed from the encounter's start."""
    rows = events.where(F.col("day_number").isNotNull()).join(
        encounters.select("hadm_id", "admittime"), "hadm_id"
    )
    return typed(
        rows, "icu_day", "has_event", kind, day_node(), F.col("concept"),
        days_between("admittime", "start_ts"),
    )


def diagnosis_concept_edges(rows: DataFrame) -> DataFrame:
    """Encounter-diagnosis edges."""
    return typed(rows, "admission", "has_diagnosis", "diagnosis", encounter_node(), F.col("concept"))


@dataclass(frozen=True)
class Concepts:
    """Concept tables: items and organisms by exact key, drugs by name, diagnoses by code."""

    lab_items: DataFrame
    chart_items: DataFrame
    organisms: DataFrame
    drugs: DataFrame
    diagnoses: DataFrame


def typed_edges(record: Record, concepts: Concepts) -> DataFrame:
    """Structural edges, the four kinds of day events, and diagnoses, all by concept where one is known."""
    def by_key(nodes: DataFrame, table: DataFrame, key: str) -> DataFrame:
        known = table.select(F.col(key).cast("string").alias("concept_key"), "concept_id", "term")
        return cd.map_items(nodes, known, "concept_key")

    plain = plain_stays(record.stays)
    drugs = prescription_nodes(record.prescriptions, record.stays, plain).withColumn("drug", F.col("name"))
    kinds = {
        "lab": by_key(lab_nodes(record.labs, record.lab_items, record.stays, plain), concepts.lab_items, "itemid"),
        "vital": by_key(vital_nodes(record.charts, record.chart_items, record.stays, plain), concepts.chart_items, "itemid"),
        "microbiology": by_key(culture_nodes(record.cultures, record.stays, plain), concepts.organisms, "org_name"),
        "drug": cd.map_drugs(drugs, concepts.drugs, record.prescriptions),
    }
    codes = cd.map_diagnoses(
        diagnosis_nodes(record.diagnoses, record.diagnosis_titles), concepts.diagnoses, record.diagnoses
    )
    parts = [
        structural_edges(record.encounters, record.stays),
        *[clinical_edges(concept_keys(rows, kind), record.encounters, kind) for kind, rows in kinds.items()],
        diagnosis_concept_edges(concept_keys(codes, "diagnosis", "icd_code")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, from one pass over the edges."""
    here = F.struct(*TYPED)
    back = F.struct(
        F.col("dst_type").alias("src_type"), F.concat(F.lit("rev_"), "rel").alias("rel"),
        F.col("src_type").alias("dst_type"), F.col("dst_id").alias("src_id"),
        F.col("src_id").alias("dst_id"), "delta_days",
    )
    return edges.select(F.inline(F.array(here, back)))


Hop = tuple[str, str, str]


def edges_of(edges: DataFrame, hop: Hop) -> DataFrame:
    src, rel, dst = hop
    return edges.where(
        (F.col("src_type") == src) & (F.col("rel") == rel) & (F.col("dst_type") == dst)
    )


def chain_edges(edges: DataFrame, chain: Sequence[Hop], rel: str) -> DataFrame:
    """Shortcut edges over a chain; the last hop's time is averaged.

    Each hop is an equality join, and pairs are reduced after every hop to one
    row with the number of paths, so repeated paths do not multiply rows.
    """
    first, *rest = chain
    paths = edges_of(edges, first).groupBy("src_id", "dst_id").agg(
        F.count(F.lit(1)).alias("_paths"), F.avg("delta_days").alias("delta_days")
    )
    for hop in rest:
        step = edges_of(edges, hop).select(
            F.col("src_id").alias("_at"), F.col("dst_id").alias("_to"), F.col("delta_days").alias("_d")
        )
        joined = paths.join(step, F.col("dst_id") == F.col("_at"))
        timed = F.when(F.col("_d").isNotNull(), F.col("_paths"))
        paths = joined.groupBy("src_id", F.col("_to").alias("dst_id")).agg(
            F.sum("_paths").alias("_paths"),
            (F.sum(F.col("_d") * F.col("_paths")) / F.sum(timed)).alias("delta_days"),
        )
    return paths.select(
        F.lit(first[0]).alias("src_type"), F.lit(rel).alias("rel"),
        F.lit(chain[-1][2]).alias("dst_type"), "src_id", "dst_id", "delta_days",
    )


@dataclass(frozen=True)
class View:
    """Which entities a task sees and what happens between it and them."""

    target: str = "admission"
    label: str = "readmitted_30d"
    entities: tuple[str, ...] = ("drug", "diagnosis")
    collapse: Mapping[str, str] = field(
        default_factory=lambda: {"icu_stay": "collapse", "icu_day": "collapse"}
    )
    temporal: bool = True


READMISSION = View()
READMISSION_EXTENDED = View(entities=("drug", "diagnosis", "lab", "vital", "microbiology"))
NEURO = View(
    label="wlst_label",
    entities=("drug", "diagnosis", "gcs", "vasopressor", "ventilation", "neurosurgery",
              "icp_medication", "map_event"),
)
ICU_MORTALITY = View(
    target="icu_stay", label="icu_mortality",
    entities=("drug", "diagnosis", "lab", "vital", "microbiology"),
    collapse={"icu_day": "traverse"}, temporal=False,
)

FULL_CHAIN = (
    ("admission", "contains_icu_stay", "icu_stay"), ("icu_stay", "has_icu_day", "icu_day"),
)


def view_edges(edges: DataFrame, view: View) -> DataFrame:
    """The view's edges with their reverses."""
    parts: list[DataFrame] = []
    seen: set[Hop] = set()

    def copy(hop: Hop) -> None:
        if hop not in seen:
            seen.add(hop)
            parts.append(edges_of(edges, hop))

    for entity in view.entities:
        if entity == "diagnosis":
            copy(("admission", "has_diagnosis", "diagnosis"))
            continue
        hops = [*FULL_CHAIN, ("icu_day", "has_event", entity)]
        while hops and hops[0][0] != view.target:
            hops = hops[1:]
        run: list[Hop] = []
        for hop in hops:
            run.append(hop)
            if view.collapse.get(hop[2]) == "collapse":
                continue
            if len(run) == 1:
                copy(run[0])
            else:
                name = rules.SHORTCUTS.get(entity, f"has_{entity}") if hop[2] == entity else hop[1]
                parts.append(chain_edges(edges, run, name))
            run = []
    if view.temporal:
        copy(("admission", "followed_by", "admission"))
    return with_reverse(reduce(lambda a, b: a.unionByName(b), parts))


#: Pairs of a seed and a node that one task forms where they share an entity, about, and most tasks.
PAIRS_PER_TASK, MOST_PAIR_TASKS = 4_000_000, 20_000
#: Most copies of the links of an entity that go over its tasks, about, on either side of the pairs.
MOST_COPIES = 2


def _dealt_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the seeds and of all nodes, to be paired by entity, share and block.

    Links of a popular entity lie in shares of the nodes times blocks of the seeds, so a seed is copied to
    every share and a node to every block.  Shares and blocks are such that copies are few on both sides, and their number is
    bounded by :data:`MOST_COPIES`, so what is shuffled grows with the links and not with the pairs.
    """
    counts = links.groupBy("entity").agg(F.count(F.lit(1)).alias("all"), F.count("asked").alias("some")).where("some > 0")
    pairs = F.col("all").cast("double") * F.col("some")
    total = counts.agg(F.coalesce(F.sum(pairs), F.lit(0.0))).first()[0]
    # Several parts to a task, so that tasks are about even.
    wanted = F.ceil(pairs * 4 / F.lit(max(PAIRS_PER_TASK, total / MOST_PAIR_TASKS)))
    ratio = F.col("all") / F.col("some")
    sizes = counts.select("entity", F.least(wanted, F.ceil(ratio * MOST_COPIES**2)).alias("parts"), ratio.alias("ratio"))
    sizes = sizes.withColumn("shares", F.least("parts", F.ceil(F.sqrt(F.col("parts") * F.col("ratio")))).cast("int"))
    sizes = sizes.select("entity", "shares", F.ceil(F.col("parts") / F.col("shares")).cast("int").alias("blocks"))
    parts = sizes.agg(F.coalesce(F.sum(F.col("shares") * F.col("blocks")), F.lit(0))).first()[0]
    tasks = int(min(MOST_PAIR_TASKS, max(1, -(-parts // 4))))

    def own(column: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(column)).cast("int")

    def every(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    dealt = links.join(sizes, "entity")
    mine = dealt.where("asked").select(
        F.col("node").alias("seed"), "entity", F.col("before").alias("seed_before"), own("blocks").alias("block"),
        every("shares").alias("share"),
    )
    others = dealt.select("node", "entity", "before", own("shares").alias("share"), every("blocks").alias("block"))
    return tuple(side.repartition(tasks, "entity", "share", "block") for side in (mine, others))


def shared_entity(
    seeds: DataFrame, edges: DataFrame, node: str = "src_id", entity: str = "dst_id"
) -> DataFrame:
    """Nodes that share an entity with a seed, without the seed itself.

    Asked for chosen seeds only: the pairs of all nodes of one popular entity grow
    with the square of its size and are never formed.  A pair is given at the first entity
    it shares, so pairs are neither shuffled nor compared with each other: a link carries
    its node's entities that come before.  Links of a popular entity go over several tasks (:func:`_dealt_links`).
    """
    named = edges.select(F.col(node).alias("node"), F.col(entity).alias("entity")).where(
        "node IS NOT NULL AND entity IS NOT NULL"
    )
    asked = seeds.select(F.col("id").alias("node")).distinct().withColumn("asked", F.lit(True))
    held = named.groupBy("node").agg(F.sort_array(F.collect_set("entity")).alias("held"))
    links = materialise(
        held.join(asked, "node", "left").select("node", "asked", "held", F.posexplode("held").alias("at", "entity"))
        .select("node", "asked", "entity", F.slice("held", F.lit(1), F.col("at")).alias("before"))
    )
    mine, others = _dealt_links(links)
    return others.join(mine, ["entity", "share", "block"]).where(
        (F.col("seed") != F.col("node")) & ~F.arrays_overlap("before", "seed_before")
    ).select("seed", "node")


def shared_entity_links(edges: DataFrame, node: str = "src_id", entity: str = "dst_id") -> DataFrame:
    """G12 in factored form: distinct (node, entity), linear in the edges.

    Two nodes co-occur exactly when they have an entity in common.
    """
    return edges.select(F.col(node).alias("node"), F.col(entity).alias("entity")).distinct()


def nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """Each source's k edges with the smallest time."""
    return top_per_group(edges, ["src_id"], [F.col("delta_days").asc_nulls_last(), "dst_id"], k)


def hop_neighbours(
    seeds: DataFrame, edges: DataFrame, path: Sequence[Hop], n: int
) -> DataFrame:
    """Up to n neighbours per seed and hop along a path of edge types.

    Neighbours are taken in id order; a hop starts from the kept ones.  A seed can
    only keep neighbours that are among the first n of the node they come from, so
    every node's edges are cut to n before the join and a hub costs n rows.
    """
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct()
    found = []
    for depth, hop in enumerate(path, start=1):
        links = edges_of(edges, hop).groupBy("src_id", "dst_id").agg(
            F.min("delta_days").alias("delta_days")
        )
        step = top_per_group(links, ["src_id"], ["dst_id"], n)
        reached = frontier.join(step, F.col("node") == F.col("src_id")).groupBy(
            "seed", F.col("dst_id").alias("_next")
        ).agg(F.min("delta_days").alias("delta_days"))
        kept = top_per_group(reached, ["seed"], ["_next"], n)
        found.append(kept.select(
            "seed", F.lit(depth).alias("hop"), F.lit(hop[2]).alias("node_type"),
            F.col("_next").alias("node"), "delta_days",
        ))
        frontier = kept.select("seed", F.col("_next").alias("node"))
    return reduce(lambda a, b: a.unionByName(b), found)


def labelled_encounters(encounters: DataFrame, seed: int = 42) -> DataFrame:
    """Encounters with both labels and their part of the split."""
    rows = encounters.select("hadm_id", "subject_id").join(readmission_flags(encounters), "hadm_id")
    return split_subjects(rows, "readmitted_30d", seed=seed).select(
        encounter_node().alias("id"), F.col("readmitted_30d").alias("y_30d"),
        F.col("readmitted_60d").alias("y_60d"), "split",
    )


def structural_features(
    subjects: DataFrame, stays: DataFrame, events: DataFrame
) -> DataFrame:
    """Two numbers per structural node: age and gender, hours and days, day and events.

    ``events`` has stay_id and day_number.
    """
    gender = F.when(F.col("gender") == "M", 1.0).otherwise(0.0)
    people = subjects.select(
        subject_node().alias("id"), F.lit("patient").alias("type"),
        F.col("anchor_age").cast("double").alias("x0"), gender.alias("x1"),
    )
    days = stay_days(stays)
    n_days = days.groupBy("stay_id").agg(F.count(F.lit(1)).alias("_n"))
    stay_rows = stays.join(n_days, "stay_id", "left").select(
        stay_node().alias("id"), F.lit("icu_stay").alias("type"), (F.col("los") * 24.0).alias("x0"),
        F.coalesce("_n", F.lit(0)).cast("double").alias("x1"),
    )
    n_events = events.where(F.col("day_number").isNotNull()).groupBy("stay_id", "day_number").agg(
        F.count(F.lit(1)).alias("_n")
    )
    day_rows = days.join(n_events, ["stay_id", "day_number"], "left").select(
        day_node().alias("id"), F.lit("icu_day").alias("type"),
        F.col("day_number").cast("double").alias("x0"),
        F.coalesce("_n", F.lit(0)).cast("double").alias("x1"),
    )
    return people.unionByName(stay_rows).unionByName(day_rows)
