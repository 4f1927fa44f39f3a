"""Code mapping and concept hierarchies.

Mapping works on the distinct codes first and joins the result back, so a code
that occurs in a third of all rows is mapped once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions.texts import label_match, plain_code, plain_drug, valid_concept_id
from caseweave.operators.filters import measured
from caseweave.plans.fixpoint import transitive_closure

closure = transitive_closure  # H1: all (child, ancestor) pairs


def ancestors(pairs: DataFrame, concept_id: str) -> DataFrame:
    """H1: concepts above one concept, from the closure."""
    return pairs.where(F.col("child") == concept_id).select("ancestor")


def descendants(pairs: DataFrame, concept_id: str) -> DataFrame:
    """H1: concepts below one concept, from the closure."""
    return pairs.where(F.col("ancestor") == concept_id).select("child")


def is_a(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """H1: for rows with child and ancestor, whether the relation holds."""
    known = pairs.withColumn("_known", F.lit(True))
    return asked.join(known, ["child", "ancestor"], "left").select(
        *asked.columns, F.coalesce("_known", F.lit(False)).alias("is_a")
    )


def match_prefixes(codes: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """Distinct codes joined to every table row whose ``prefix`` starts the code.

    Each distinct code is unfolded into all its prefixes, which makes the join an
    equality for prefixes of any length.
    """
    unfolded = codes.select(code).distinct().where(F.length(code) > 0).select(
        code, F.explode(F.transform(
            F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(code, F.lit(1), n)
        )).alias("prefix")
    )
    return unfolded.join(table, "prefix")


def map_diagnoses(diagnoses: DataFrame, concepts: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """H2: add concept_id and term of version-10 codes, exact or by family.

    An exact entry decides even when its id is not valid; only without one does
    the three-character family count.  ``source`` has the codes, and perhaps more, where ``diagnoses``
    take work to make: their codes are then read from it.
    """
    codes = (
        (diagnoses if source is None else source).where(F.col("icd_version") == 10).select("icd_code").distinct()
        .withColumn("_plain", plain_code(F.col("icd_code")))
    )
    concepts = first_by(concepts, "code", ("concept_id", "term"))
    exact = concepts.select(
        F.col("code").alias("_plain"), F.struct("concept_id", "term").alias("_exact")
    )
    family = concepts.select(
        F.col("code").alias("_family"), F.struct("concept_id", "term").alias("_near")
    )
    found = (
        codes.join(exact, "_plain", "left")
        .withColumn("_family", F.when(F.length("_plain") > 3, F.substring("_plain", 1, 3)))
        .join(family, "_family", "left")
        .withColumn("_hit", F.coalesce("_exact", "_near"))
        .where(valid_concept_id(F.col("_hit.concept_id")))
        .select("icd_code", F.lit(10).alias("icd_version"), "_hit.concept_id", "_hit.term")
    )
    return diagnoses.join(found, ["icd_code", "icd_version"], "left")


def map_drugs(prescriptions: DataFrame, concepts: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """H3: add concept_id and term of drug names, exact or one a prefix of the other.

    Both directions of the prefix match are equality joins on unfolded prefixes
    of the distinct names; among several hits the first by name counts.  ``source`` has the names, and
    perhaps more, where ``prescriptions`` take work to make: their names are then read from it.
    """
    names = (prescriptions if source is None else source).select("drug").distinct().withColumn("_plain", plain_drug(F.col("drug")))
    table = concepts.where(valid_concept_id(F.col("concept_id"))).select(
        F.col("name").alias("_name"), F.struct("concept_id", "term").alias("_hit")
    )

    def starts(column: str) -> Column:
        return F.explode(
            F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substring(column, 1, n))
        )

    plain = names.select("_plain").distinct().where(F.length("_plain") > 0)
    longer = plain.select("_plain", starts("_plain").alias("_name")).join(table, "_name")
    shorter = table.select("_name", "_hit", starts("_name").alias("_plain")).join(plain, "_plain")
    best = (
        longer.select("_plain", "_name", "_hit")
        .unionByName(shorter.select("_plain", "_name", "_hit"))
        .groupBy("_plain")
        .agg(F.min_by("_hit", F.struct(F.col("_name") != F.col("_plain"), "_name")).alias("_hit"))
    )
    found = names.join(best, "_plain").select("drug", "_hit.concept_id", "_hit.term")
    return prescriptions.join(found, "drug", "left")


def first_by(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``columns`` in order, nulls last, so that runs agree."""
    order = F.struct(*[f(c) for c in columns for f in (F.isnull, F.col)])
    least = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return least.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def map_items(events: DataFrame, concepts: DataFrame, key: str = "itemid") -> DataFrame:
    """H4: add concept_id and term by an exact key (item, organism, name, LOINC)."""
    known = first_by(
        concepts.where(valid_concept_id(F.col("concept_id"))), key, ("concept_id", "term")
    )
    return events.join(known, key, "left")


def coverage(mapped: Mapping[str, DataFrame]) -> DataFrame:
    """H4: rows and rows with a concept, per mapped table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("concept_id").alias("n_mapped"))
        .select(F.lit(name).alias("source"), "n_rows", "n_mapped")
        for name, df in mapped.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def drug_categories(
    drug: Column, categories: Mapping[str, Sequence[str]] = rules.DRUG_CATEGORIES
) -> Column:
    """H5: categories of a drug name: a member as whole word or, with spaces, phrase."""
    plain = plain_drug(drug)
    words = F.split(plain, r"\s+")

    def hit(members: Sequence[str]) -> Column:
        single = [m for m in members if " " not in m]
        phrases = [plain.contains(m) for m in members if " " in m]
        return reduce(
            lambda a, b: a | b, phrases,
            F.arrays_overlap(words, F.array(*[F.lit(m) for m in single])),
        )

    return F.array_compact(
        F.array(*[F.when(hit(members), F.lit(name)) for name, members in categories.items()])
    )


def with_categories(
    prescriptions: DataFrame, categories: Mapping[str, Sequence[str]] = rules.DRUG_CATEGORIES
) -> DataFrame:
    """H5: one row per prescription and category of its drug."""
    names = prescriptions.select("drug").distinct().select(
        "drug", F.explode(drug_categories(F.col("drug"), categories)).alias("category")
    )
    return prescriptions.join(names, "drug")


def category_table(
    spark: SparkSession,
    categories: Mapping[str, Sequence[str]] = {**rules.DRUG_CATEGORIES, **rules.MEASURED_GROUPS},
) -> DataFrame:
    """H6: (category, member) of curated groups, by default all built-in ones."""
    rows = [(c, m) for c, members in categories.items() for m in members]
    return spark.createDataFrame(rows, "category string, member string")


def resolve_names(
    asked: DataFrame, curated: DataFrame, concepts: DataFrame, pairs: DataFrame
) -> DataFrame:
    """H6: names a concept stands for.

    ``asked`` has ``name``; a curated category gives its members, otherwise the
    names below its concept when there are at least two, otherwise itself.
    """
    base = asked.select("name").distinct().withColumn("_low", F.lower("name"))
    members = base.join(curated, F.col("_low") == F.lower("category")).select(
        "name", F.col("member"), F.lit("curated").alias("source")
    )
    own = concepts.select(F.lower("name").alias("_low"), F.col("concept_id").alias("_top"))
    below = (
        base.join(curated.select(F.lower("category").alias("_low")).distinct(), "_low", "left_anti")
        .join(own, "_low")
        .join(pairs.select("child", F.col("ancestor").alias("_top")), "_top")
        .join(concepts.select(F.col("concept_id").alias("child"), F.col("name").alias("member")),
              "child")
        .select("name", "member").distinct()
    )
    enough = below.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    expanded = below.join(enough.select("name"), "name", "left_semi").withColumn(
        "source", F.lit("hierarchy")
    )
    found = members.unionByName(expanded)
    itself = base.join(found.select("name").distinct(), "name", "left_anti").select(
        "name", F.col("name").alias("member"), F.lit("name").alias("source")
    )
    return found.unionByName(itself)


def word_runs(text: Column, longest: int) -> Column:
    """All runs of up to ``longest`` words of a text, lower-cased and joined by blanks."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w, i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)),
        lambda n: F.array_join(F.slice(words, i + 1, n), " "),
    )))


def rows_for_names(resolved: DataFrame, dictionary: DataFrame, label: str, longest: int = 6) -> DataFrame:
    """H6: (name, dictionary row) where the label holds a resolved member as whole word or phrase.

    Labels are unfolded into their runs of words, so the match is an equality join; a row that holds several
    members of a name is given once.  Members have up to ``longest`` words; a longer one finds nothing.
    """
    members = resolved.select("name", F.array_join(
        F.filter(F.split(F.lower("member"), "[^a-z0-9]+"), lambda w: w != ""), " "
    ).alias("_run")).where("_run <> ''").distinct()
    labels = dictionary.select(label).distinct().where(F.col(label).isNotNull())
    runs = labels.select(label, F.explode(F.array_distinct(word_runs(F.col(label), longest))).alias("_run"))
    hits = runs.join(members, "_run").select("name", label).distinct()
    return dictionary.join(hits, label)


def items_for_loinc(lab_concepts: DataFrame, loinc: str) -> DataFrame:
    """H7: items measured under exactly this LOINC code (the specimen counts)."""
    return lab_concepts.where(F.col("loinc") == loinc).select("itemid").distinct()


def measured_or_family(
    events: DataFrame, itemids: Sequence[int], dictionary: DataFrame, label: str
) -> DataFrame:
    """H8: readings of the items or, when there are none at all, of the label family.

    The choice is a scalar subquery inside one plan; ``broadened`` tells which.
    """
    exact = measured(events, itemids=itemids)
    family = measured(events, dictionary=dictionary, label=label)
    found = exact.limit(1).agg(F.count(F.lit(1))).scalar()
    return exact.withColumn("broadened", F.lit(False)).unionByName(
        family.where(found == 0).withColumn("broadened", F.lit(True))
    )


def first_source(codes: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """H9: concept of each code from the first source that has it."""
    joined = codes.select(key).distinct()
    for i, (name, table) in enumerate(sources):
        hit = first_by(table, key, ("concept_id",)).select(
            key, F.struct("concept_id", F.lit(name).alias("source")).alias(f"_hit{i}")
        )
        joined = joined.join(hit, key, "left")
    best = F.coalesce(*[F.col(f"_hit{i}") for i in range(len(sources))])
    return joined.select(key, best["concept_id"].alias("concept_id"), best["source"].alias("source"))


def concept_features(
    mapped: DataFrame, concept_ids: Sequence[str], prefix: str, count_name: str,
    distinct: bool = False,
) -> DataFrame:
    """Count of mapped rows (or concepts) and one flag per concept."""
    rows = mapped.where(F.col("concept_id").isNotNull())
    total = F.count_distinct("concept_id") if distinct else F.count(F.lit(1))
    flags = [
        F.max((F.col("concept_id") == c).cast("int")).alias(f"{prefix}_{c}") for c in concept_ids
    ]
    return rows.groupBy("hadm_id").agg(total.alias(count_name), *flags)


# Type numbers of a full name and of a synonym in a terminology release.
FULL_NAME, SYNONYM = "900000000000003001", "900000000000013009"


def read_release(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """The rows of a tab-separated release file that are active, at the date ``as_of`` (yyyyMMdd) if given.

    A full release has every version of a row under one id, and retires it by a later version: the latest
    version up to the date speaks, and only then is it asked whether it is active.  A file without ids has one
    version per row.
    """
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    if as_of is not None:
        rows = rows.where(F.col("effectiveTime") <= as_of)
    if "id" in rows.columns:
        others = [c for c in rows.columns if c not in ("id", "effectiveTime")]
        rows = rows.groupBy("id").agg(F.max(F.struct("effectiveTime", *others)).alias("_v")).select("id", "_v.*")
    return rows.where(F.col("active") == "1")


def release_terms(descriptions: DataFrame) -> DataFrame:
    """Preferred term of each concept: its full name without the tag, else a synonym."""
    order = F.struct("effectiveTime", "id")
    full = F.when(F.col("typeId") == FULL_NAME, F.regexp_replace("term", r"\s*\([^(]*$", ""))
    other = F.when(F.col("typeId") == SYNONYM, F.col("term"))

    def pick(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), order))

    return descriptions.groupBy("conceptId").agg(
        F.coalesce(pick(full), pick(other), F.lit("")).alias("term")
    )


def release_map(rows: DataFrame, code: str, concept: str) -> DataFrame:
    """Laboratory code to concept id, from the release's map columns."""
    return rows.where(
        F.col(code).contains("-") & F.col(concept).rlike(r"^\d+$")
    ).groupBy(F.col(code).alias("loinc")).agg(
        F.max_by(F.col(concept), F.col("effectiveTime")).alias("concept_id")
    )


def label_variants(events: DataFrame, dictionary: DataFrame, text: str, how: str = "contains") -> DataFrame:
    """Readings per label of an analyte: count, mean, low, high."""
    items = dictionary.where(label_match(F.col("label"), [text], how)).select("itemid", "label")
    return (
        events.where(F.col("valuenum").isNotNull()).join(items, "itemid").groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg("valuenum").alias("mean_value"),
            F.min("valuenum").alias("min_value"), F.max("valuenum").alias("max_value"),
        )
    )
