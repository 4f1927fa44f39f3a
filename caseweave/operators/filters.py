"""Cohort filters: each takes encounters and returns the encounters that pass.

A filter on facts (events, codes, drugs) first reduces the facts to the distinct
encounter ids that match, which combines on the map side, and then keeps those
encounters with a semi join, so an encounter with many matching rows is kept
once and a list of filters is a plain fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.arithmetic import compare, index_column
from caseweave.functions.draws import uniform
from caseweave.functions.texts import (
    contains_any,
    label_match,
    plain_phrase,
    plain_prefix,
    starts_with_any,
)
from caseweave.functions.times import boundaries, plus_hours

Filter = Callable[[DataFrame], DataFrame]


def keep(encounters: DataFrame, matches: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Encounters whose key occurs in ``matches``."""
    return encounters.join(matches.select(key).distinct(), key, "left_semi")


# --- subject and encounter attributes -----------------------------------------


def by_age(encounters: DataFrame, subjects: DataFrame, operator: str, years: int) -> DataFrame:
    """subjects' anchor age compared with a number."""
    return keep(encounters, subjects.where(compare(F.col("anchor_age"), operator, int(years))),
                "subject_id")


def by_gender(encounters: DataFrame, subjects: DataFrame, gender: str) -> DataFrame:
    """subjects of one gender; the argument's case does not matter."""
    return keep(encounters, subjects.where(F.col("gender") == gender.upper()), "subject_id")


def by_admission_type(encounters: DataFrame, values: str | Sequence[str]) -> DataFrame:
    """one type, or any of a list; an empty list keeps nothing."""
    if isinstance(values, str):
        return encounters.where(F.col("admission_type") == values)
    if not values:
        return encounters.where(F.lit(False))
    return encounters.where(F.col("admission_type").isin(list(values)))


def by_subject(encounters: DataFrame, subject_id: int) -> DataFrame:
    """F8: encounters of one subject."""
    return encounters.where(F.col("subject_id") == int(subject_id))


def by_label(
    encounters: DataFrame, labels: DataFrame, field: str, operator: str, value: int
) -> DataFrame:
    """a 0/1 label (such as readmitted_30d) compared with a number."""
    return keep(encounters, labels.where(compare(F.col(field), operator, int(value))))


# --- coded attributes -----------------------------------------------------------


def codes_like(dictionary: DataFrame, text: str) -> DataFrame:
    """Dictionary codes whose title contains the text or whose code starts with it."""
    hit = contains_any(F.col("long_title"), [text]) | F.col("icd_code").startswith(text)
    return dictionary.where(hit).select("icd_code", "icd_version").distinct()


def diagnosed_with(diagnoses: DataFrame, dictionary: DataFrame, text: str) -> DataFrame:
    """Diagnosis rows whose dictionary entry matches the text."""
    return diagnoses.join(codes_like(dictionary, text), ["icd_code", "icd_version"], "left_semi")


def by_diagnosis(
    encounters: DataFrame, diagnoses: DataFrame, dictionary: DataFrame, text: str
) -> DataFrame:
    """a diagnosis whose title contains the text or whose code starts with it."""
    return keep(encounters, diagnosed_with(diagnoses, dictionary, text))


def prefix_condition(
    icd10: Sequence[str] = (), icd9: Sequence[str] = (), any_version: Sequence[str] = ()
) -> Column:
    """Codes starting with one of the prefixes of their version; dots are ignored."""
    code, version = F.col("icd_code"), F.col("icd_version")
    return (
        ((version == 10) & starts_with_any(code, [plain_prefix(p) for p in icd10]))
        | ((version == 9) & starts_with_any(code, [plain_prefix(p) for p in icd9]))
        | starts_with_any(code, [plain_prefix(p) for p in any_version])
    )


def by_code_prefixes(
    encounters: DataFrame,
    diagnoses: DataFrame,
    icd10: Sequence[str] = (),
    icd9: Sequence[str] = (),
    any_version: Sequence[str] = (),
) -> DataFrame:
    """any diagnosis code starting with one of the prefixes."""
    if not (icd10 or icd9 or any_version):
        raise ValueError("at least one prefix is needed")
    return keep(encounters, diagnoses.where(prefix_condition(icd10, icd9, any_version)))


def by_named_cohort(encounters: DataFrame, diagnoses: DataFrame, phrase: str) -> DataFrame:
    """the named cohort a phrase stands for; an unknown phrase is an error."""
    name = rules.cohort_named(phrase)
    if name is None:
        raise KeyError(f"no cohort is named by {phrase!r}")
    spec = rules.COHORTS[name]
    return by_code_prefixes(encounters, diagnoses, spec["icd10"], spec["icd9"])


def cohort_of_phrase(phrase: Column) -> Column:
    """F6 for a column: name of the cohort each phrase stands for, else NULL.

    The alias list is a constant array, so no join is needed: an exact name, an
    exact alias, or the longest alias contained in the phrase.
    """
    text = plain_phrase(phrase)
    pairs = [(a, n) for n, spec in rules.COHORTS.items() for a in spec["aliases"]]
    aliases = F.array(
        *[
            F.struct(
                F.lit(len(a)).alias("length"), F.lit(n).alias("name"), F.lit(a).alias("alias")
            )
            for a, n in pairs
        ]
    )
    exact = F.get(F.filter(aliases, lambda x: x["alias"] == text), 0)["name"]
    inside = F.array_max(F.filter(aliases, lambda x: F.contains(text, x["alias"])))["name"]
    named = F.when(text.isin(list(rules.COHORTS)), text)
    return F.when(text != "", F.coalesce(named, exact, inside))


# --- measurements ---------------------------------------------------------------


def measured(
    events: DataFrame,
    itemids: Sequence[int] | None = None,
    dictionary: DataFrame | None = None,
    label: str | None = None,
    how: str = "contains",
) -> DataFrame:
    """Events with a value, by item numbers or, without those, by dictionary label."""
    known = events.where(F.col("valuenum").isNotNull())
    if itemids:
        return known.where(F.col("itemid").isin(list(itemids)))
    items = dictionary.where(label_match(F.col("label"), [label], how)).select("itemid").distinct()
    return known.join(items, "itemid", "left_semi")


def by_measurement(
    encounters: DataFrame, readings: DataFrame, operator: str, threshold: float
) -> DataFrame:
    """some reading ever crossed the threshold.

    ``readings`` comes from :func:`measured`.  A value may cross both ways during
    an encounter, so "high" and "low" cohorts may share encounters.
    """
    return keep(
        encounters, readings.where(compare(F.col("valuenum"), operator, float(threshold)))
    )


def by_score_total(
    encounters: DataFrame, totals: DataFrame, stays: DataFrame, operator: str, threshold: float
) -> DataFrame:
    """some score total (one per stay and time) crossed the threshold."""
    hits = totals.where(compare(F.col("total"), operator, float(threshold)))
    return keep(encounters, keep(stays, hits, "stay_id"))


@dataclass(frozen=True)
class Operand:
    """One measured input of a derived index: its items and plausible bounds."""

    name: str
    itemids: tuple[int, ...]
    low: float
    high: float
    aggregate: str = "max"

    def value(self) -> Column:
        v = F.col("valuenum")
        return F.when(F.col("itemid").isin(list(self.itemids)) & v.between(self.low, self.high), v)


def names_in(node: Any) -> list[str]:
    if isinstance(node, str):
        return [node]
    if isinstance(node, Mapping):
        return [n for a in node["args"] for n in names_in(a)]
    return []


def index_per_instant(
    events: DataFrame, operands: Sequence[Operand], expression: Any, key: Sequence[str]
) -> DataFrame:
    """Smallest and largest value of a derived index at each instant.

    The operands must have been read at the same stay and time.  When an operand
    was read several times at one instant, every combination of readings counts.
    If each operand occurs once in the expression and no bounds span zero, the
    index is monotone in each operand and its extremes lie at combinations of
    the operands' extremes, so one aggregate per instant is enough.  Otherwise
    the distinct readings of the operands are joined on the instant.
    """
    used = names_in(expression)
    simple = len(used) == len(set(used)) and all(o.low > 0 for o in operands)
    wanted = sorted({i for o in operands for i in o.itemids})
    rows = events.where(F.col("itemid").isin(wanted) & F.col("valuenum").isNotNull())
    if simple:
        spread = rows.groupBy(*key).agg(
            *[F.min(o.value()).alias(f"{o.name}_low") for o in operands],
            *[F.max(o.value()).alias(f"{o.name}_high") for o in operands],
        )
        corners = [
            index_column(
                expression,
                {o.name: F.col(f"{o.name}_{end}") for o, end in zip(operands, ends)},
            )
            for ends in product(("low", "high"), repeat=len(operands))
        ]
        low, high = F.least(*corners), F.greatest(*corners)
        complete = reduce(
            lambda a, b: a & b, [F.col(f"{o.name}_low").isNotNull() for o in operands]
        )
        return spread.where(complete).select(
            *key, low.alias("index_low"), high.alias("index_high")
        )
    sides = [
        rows.select(*key, o.value().alias(o.name)).where(F.col(o.name).isNotNull()).distinct()
        for o in operands
    ]
    joined = reduce(lambda a, b: a.join(b, list(key)), sides)
    value = index_column(expression, {o.name: F.col(o.name) for o in operands})
    return joined.groupBy(*key).agg(
        F.min(value).alias("index_low"), F.max(value).alias("index_high")
    )


def by_index_per_instant(
    encounters: DataFrame,
    events: DataFrame,
    operands: Sequence[Operand],
    expression: Any,
    operator: str,
    threshold: float,
) -> DataFrame:
    """a derived index crossed its threshold at some instant."""
    if operator not in (">", ">=", "<", "<="):
        raise ValueError("a per-instant index is compared with <, <=, > or >=")
    spread = index_per_instant(events, operands, expression, ["hadm_id", "stay_id", "charttime"])
    side = "index_high" if operator.startswith(">") else "index_low"
    return keep(encounters, spread.where(compare(F.col(side), operator, float(threshold))))


AGGREGATES = {"max": F.max, "min": F.min, "avg": F.avg}


def index_per_encounter(
    events: DataFrame, operands: Sequence[Operand], expression: Any
) -> DataFrame:
    """A derived index of each encounter from one aggregate per operand."""
    wanted = sorted({i for o in operands for i in o.itemids})
    parts = (
        events.where(F.col("itemid").isin(wanted))
        .groupBy("hadm_id")
        .agg(*[AGGREGATES[o.aggregate](o.value()).alias(o.name) for o in operands])
    )
    return parts.select(
        "hadm_id", index_column(expression, {o.name: F.col(o.name) for o in operands}).alias("index")
    )


def by_index_per_encounter(
    encounters: DataFrame,
    events: DataFrame,
    operands: Sequence[Operand],
    expression: Any,
    operator: str,
    threshold: float,
) -> DataFrame:
    """a derived index of per-encounter aggregates crossed its threshold."""
    index = index_per_encounter(events, operands, expression)
    return keep(encounters, index.where(compare(F.col("index"), operator, float(threshold))))


# --- stays, drugs, combinations ---------------------------------------------------


def has_stay(encounters: DataFrame, stays: DataFrame) -> DataFrame:
    """encounters with an intensive-care stay."""
    return keep(encounters, stays)


def drug_terms(name: str) -> list[str]:
    """Name patterns a drug or drug group stands for; the name itself stays one."""
    plain = name.strip().lower()
    if not plain:
        return []
    members = [
        spec["patterns"]
        for group, spec in rules.DRUG_GROUPS.items()
        if plain in [group, *[a.lower() for a in spec["aliases"]]]
    ]
    return list(dict.fromkeys([*(members[0] if members else []), plain]))


def by_drug(encounters: DataFrame, prescriptions: DataFrame, name: str) -> DataFrame:
    """received a drug, or any drug of a named group."""
    terms = drug_terms(name)
    if not terms:
        return encounters.where(F.lit(False))
    return keep(encounters, prescriptions.where(contains_any(F.col("drug"), terms)))


def any_of(encounters: DataFrame, filters: Sequence[Filter], key: str = "hadm_id") -> DataFrame:
    """F16: encounters that pass at least one of the filters."""
    if not filters:
        return encounters.where(F.lit(False))
    keys = [f(encounters).select(key) for f in filters]
    return keep(encounters, reduce(lambda a, b: a.unionByName(b), keys), key)


def all_of(encounters: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Encounters that pass every filter."""
    return reduce(lambda df, f: f(df), filters, encounters)


def select_ids(
    encounters: DataFrame,
    filters: Sequence[Filter] = (),
    order: str = "recent",
    cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """ids of the encounters passing all filters, newest first or shuffled.

    The shuffled order is a hash of the id, so it repeats for the same seed; a
    cap becomes a distributed top-n instead of a full sort.
    """
    ids = all_of(encounters, filters).select("hadm_id", "admittime").distinct()
    if order == "recent":
        ids = ids.orderBy(F.col("admittime").desc(), "hadm_id")
    elif order == "random":
        ids = ids.orderBy(uniform(seed, F.col("hadm_id")), "hadm_id")
    else:
        raise ValueError(f"unknown order {order!r}")
    ids = ids.select("hadm_id")
    return ids if cap is None else ids.limit(cap)


# --- events and dictionaries ------------------------------------------------------


def in_window(
    events: DataFrame,
    anchors: DataFrame,
    relation: str,
    time: str = "charttime",
    start: str = "intime",
    end: str = "outtime",
    hours: float | None = None,
    key: str = "hadm_id",
) -> DataFrame:
    """events during, within the first hours of, before or after an anchor.

    An encounter may have several anchors and one is enough.  Before and after
    need only the latest start and earliest end, so those are aggregated first;
    the others are semi joins on the key with a range condition.
    """
    if relation in ("before", "after"):
        latest = anchors.groupBy(key).agg(
            F.max(start).alias("_start"), F.min(end).alias("_end")
        )
        bounds = latest.select(F.col(key).alias("_key"), "_start", "_end")
        late = (
            F.col(time) < F.col("_start") if relation == "before" else F.col(time) > F.col("_end")
        )
        return events.join(bounds, (F.col(key) == F.col("_key")) & late, "left_semi")
    bounds = anchors.select(
        F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end")
    )
    if relation == "during":
        until = F.col("_end")
    elif relation == "within" and hours is not None:
        until = plus_hours("_start", hours)
    elif relation == "within":
        return events
    else:
        raise ValueError(f"unknown relation {relation!r}")
    inside = (F.col(time) >= F.col("_start")) & (F.col(time) <= until)
    return events.join(bounds, (F.col(key) == F.col("_key")) & inside, "left_semi")


def with_fluid(labs: DataFrame, dictionary: DataFrame, fluids: Sequence[str]) -> DataFrame:
    """laboratory events of items measured in one of the fluids."""
    items = dictionary.where(contains_any(F.col("fluid"), fluids)).select("itemid").distinct()
    return labs.join(items, "itemid", "left_semi")


def with_culture_status(cultures: DataFrame, status: str | None) -> DataFrame:
    """positive cultures name an organism, negative ones do not."""
    if status == "positive":
        return cultures.where(F.col("org_name").isNotNull())
    if status == "negative":
        return cultures.where(F.col("org_name").isNull())
    return cultures


def screen(events: DataFrame, limits: DataFrame, units: bool = True) -> DataFrame:
    """add ``clean``, false for values outside the item's possible range.

    ``limits`` has itemid, low, high and unit.  A bound applies to a row whose
    unit is missing or equal to the bound's; rows in another unit are kept.
    """
    bounds = limits.select("itemid", "low", "high", F.lower(F.trim("unit")).alias("_unit"))
    inside = F.col("valuenum").between(F.col("low"), F.col("high"))
    if units:
        own = F.lower(F.trim(F.col("valueuom")))
        applies = F.col("_unit").isNull() | own.isNull() | (own == F.col("_unit"))
    else:
        applies = F.lit(True)
    clean = F.coalesce(inside | ~applies, F.lit(True))
    return events.join(bounds, "itemid", "left").withColumn("clean", clean).drop(
        "low", "high", "_unit"
    )


def removed_rows(screened: DataFrame, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """the removed values, largest first; a top-n, not a full sort."""
    return screened.where(~F.col("clean")).orderBy(F.col("valuenum").desc(), *tie).limit(n)


def eligible_stays(
    stays: DataFrame,
    ages: DataFrame,
    min_hours: int = 24,
    max_hours: int = 2400,
    age_from: int = 18,
    age_to: int = 89,
) -> DataFrame:
    """first stay of an encounter, within length and age bounds."""
    hours = boundaries("hour", "intime", "outtime")
    first = first_stays(stays).where((hours > min_hours) & (hours < max_hours))
    in_age = ages.where(F.col("age").between(age_from, age_to)).select("subject_id", "hadm_id")
    return first.join(in_age, ["subject_id", "hadm_id"], "left_semi")


def first_stays(stays: DataFrame) -> DataFrame:
    """The earliest stay of each encounter.

    A minimum of the whole row by (intime, stay_id) combines on the map side, so
    no encounter's stays are sorted in one task.
    """
    row = F.struct(*[F.col(c) for c in stays.columns if c != "hadm_id"])
    first = stays.groupBy("hadm_id").agg(
        F.min_by(row, F.struct("intime", "stay_id")).alias("_row")
    )
    return first.select(
        *[F.col("hadm_id") if c == "hadm_id" else F.col(f"_row.{c}").alias(c)
          for c in stays.columns]
    )


def search_items(labs: DataFrame, charts: DataFrame, text: str, n: int) -> DataFrame:
    """dictionary items by label: exact, then prefix, then anywhere."""
    both = labs.select(
        "itemid", "label", "fluid", "category", F.lit("labevents").alias("source_table")
    ).unionByName(
        charts.select(
            "itemid", "label", F.lit(None).cast("string").alias("fluid"), "category",
            F.lit("chartevents").alias("source_table"),
        )
    )
    label, wanted = F.lower("label"), text.lower()
    rank = F.when(label == wanted, 0).when(label.startswith(wanted), 1).otherwise(2)
    return (
        both.where(label.contains(wanted))
        .withColumn("match_rank", rank)
        .orderBy("match_rank", F.length("label"), "label", "itemid")
        .limit(n)
    )
