"""Removal of lines that are repeated across sites, by sketches of the sites of every line.

A HyperLogLog sketch of its sites is kept per line hash; partial sketches merge in aggregation, so a
line that is everywhere costs one sketch per task.  The estimate settles lines that are far from the
threshold; for the others the distinct sites are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import BLANK, whole_text
from caseweave.session import materialise


#: Parts into which the rows of a line are dealt.
SALTS = 32


def line_key(line: Column) -> Column:
    """A 64-bit hash of the line without outer white space."""
    return F.xxhash64(_trimmed(line))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def _words(line: Column) -> Column:
    return F.size(F.split(_trimmed(line), f"[{BLANK}]+"))


def boilerplate_lines(
    docs: DataFrame, min_sites: int, min_words: int, log2_registers: int = 12, band: float = 0.15
) -> DataFrame:
    """(line, keeper): lines found on ``min_sites`` sites or more, and the smallest id that has each.

    ``docs`` has id, site and text.  Estimates within ``band`` of the threshold, about nine standard errors at
    4,096 registers, are replaced by exact counts.
    """
    lines = docs.select("id", "site", F.explode(F.split("text", "\n")).alias("l")).where(_words(F.col("l")) >= min_words)
    lines = lines.select("id", "site", line_key(F.col("l")).alias("line"))
    # A line needs as many rows as sites; most lines stop here, as one count per line.
    repeated = lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("keeper")).where(
        F.col("rows") >= min_sites
    )
    repeated = materialise(repeated.select("line", "keeper"))
    # The lines are few by now; each meets its rows in SALTS places, so that the rows of one common line
    # are sketched apart and only sketches come together.
    places = repeated.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sites = (
        lines.select("line", "site", F.pmod(F.xxhash64("id", "site"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(places, ["line", "salt"], "left_semi")
    )
    spread = materialise(sites.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_registers))).alias("sites")
    ))
    near = spread.where(F.col("sites").between(min_sites * (1 - band) - 1, min_sites * (1 + band) + 1))
    # Rows of a line are met where they are, and equal sites become one before they come together.
    asked = materialise(near.select("line")).join(places, "line")
    exact = (
        sites.join(asked, ["line", "salt"], "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("exact"))
    )
    return (
        spread.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= min_sites)
        .join(repeated, "line").select("line", "keeper")
    )


def remove_boilerplate(
    docs: DataFrame, min_sites: int = 3, min_words: int = 4, site_col: str = "source", also: Sequence[str] = ()
) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, the text without cross-site boilerplate, columns ``also``.

    A line is boilerplate when it has ``min_words`` words or more and is found, without outer white space,
    in documents of at least ``min_sites`` distinct sites.  It stays once, at its first place in the
    document with the smallest id that has it, and goes everywhere else, also where one document repeats it.
    Lines that stay are unchanged and in order.  A null text stays null and has no lines; a null site
    counts as one site of its own; rows with a null id keep no first copy, and are told apart by a
    digest of the text.  Rows of one id with several texts each keep the lines that the id keeps.

    ``min_sites`` is low, so that lines repeated on a few sites of a small table, or mostly on one hot site,
    go, too; a corpus with many mirrored texts may want more.
    """
    own = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        whole_text().alias("text"), F.col("text").isNull().alias("missing"),
        F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.sha2(whole_text().cast("binary"), 256)).alias("key"),
        F.struct(F.lit(0).alias("_"), *also).alias("also"),
    )
    # Written, so that the next join has a plain shuffle on either side, whose large parts Spark splits.
    found = materialise(boilerplate_lines(own.select("id", "site", "text"), min_sites, min_words))
    # What each document must lose: the keys of its boilerplate lines, and of those that it keeps once.
    hits = (
        own.select("id", "key", F.explode(F.split("text", "\n")).alias("l")).where(_words(F.col("l")) >= min_words)
        .select("id", "key", line_key(F.col("l")).alias("line")).distinct().join(found, "line")
        .groupBy("key").agg(
            F.collect_list("line").alias("bad"),
            F.collect_list(F.when(F.col("keeper") == F.col("id"), F.col("line"))).alias("once"),
        )
    )
    lines = F.split("text", "\n")
    keys = F.transform("lines", lambda x: F.when(_words(x) >= min_words, line_key(x)))
    stays = lambda x, i: (
        F.get("keys", i).isNull() | ~F.array_contains("bad", F.get("keys", i))
        | (F.array_contains("once", F.get("keys", i)) & (F.array_position("keys", F.get("keys", i)) == i + 1))
    )
    cleaned = (
        own.join(hits, "key", "left")
        .withColumn("lines", lines)
        .withColumn("keys", F.when(F.col("bad").isNotNull(), keys))
        .withColumn("left", F.when(F.col("bad").isNotNull(), F.filter("lines", stays)).otherwise(F.col("lines")))
    )
    return cleaned.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("missing"), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("missing"), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        F.when(~F.col("missing"), F.array_join("left", "\n")).alias("text"),
        *[F.col(f"also.{c}").alias(c) for c in also],
    )


#: The same rows in DuckDB.
SQL = """
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(coalesce(text, ''), chr(10)) AS lines,
         row_number() OVER () AS r
  FROM documents
), unfolded AS (
  SELECT r, doc_id, site, unnest(lines) AS l, generate_subscripts(lines, 1) AS p FROM own
), worded AS (
  SELECT *, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
         len(regexp_split_to_array(trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')) AS w
  FROM unfolded
), spread AS (
  SELECT t, min(doc_id) AS keeper FROM worded WHERE w >= 4 GROUP BY t HAVING count(DISTINCT site) >= 3
), marked AS (
  SELECT x.*, s.t IS NOT NULL AND NOT (s.keeper IS NOT DISTINCT FROM x.doc_id
         AND x.p = min(x.p) OVER (PARTITION BY x.r, x.t)) AS gone
  FROM worded x LEFT JOIN spread s ON s.t = x.t AND x.w >= 4
), rebuilt AS (
  SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g,
         coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY r
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN 0 ELSE b.n END AS n_lines,
       CASE WHEN o.text IS NULL THEN 0 ELSE b.g END AS n_removed,
       CASE WHEN o.text IS NOT NULL THEN b.text END AS text
FROM own o JOIN rebuilt b USING (r)
"""
