"""Writing results, and reading run logs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.graph import dense_ids
from caseweave.operators.similarity import ranked_members
from caseweave.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def write_matrix(df: DataFrame, path: str) -> None:
    """IO10: a feature matrix as Parquet, one file per task."""
    df.write.mode("overwrite").parquet(path)


# Name spaces of the written graph.
RECORD_SPACE = "http://example.org/record#"
TYPE_PREDICATE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def resource(name: Column, space: str = RECORD_SPACE) -> Column:
    return F.concat(F.lit(f"<{space}"), F.regexp_replace(name, r"[^A-Za-z0-9_.~-]", "_"), F.lit(">"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """IO11: one text line per node type and per edge."""
    kinds = nodes.select(
        F.concat_ws(" ", resource(F.col("id")), F.lit(f"<{TYPE_PREDICATE}>"),
                    resource(F.col("type")), F.lit(".")).alias("line")
    )
    links = edges.select(
        F.concat_ws(" ", resource(F.col("src")), resource(F.col("predicate")),
                    resource(F.col("dst")), F.lit(".")).alias("line")
    )
    return kinds.unionByName(links)


def write_triples(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """IO11: the graph as N-Triples; every task writes its own file, packed by gzip, since lines repeat their name space."""
    triples(nodes, edges).write.mode("overwrite").option("compression", "gzip").text(path)


def indexed_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO12: nodes with consecutive numbers per type, edges between the numbers.

    One edge is kept per ordered pair of nodes.
    """
    kinds = nodes.groupBy("id").agg(F.min("type").alias("type"))
    numbers = dense_ids(kinds).join(kinds, ["type", "id"])
    src = numbers.select(
        F.col("id").alias("src"), F.col("type").alias("src_type"), F.col("index").alias("src_index")
    )
    dst = numbers.select(
        F.col("id").alias("dst"), F.col("type").alias("dst_type"), F.col("index").alias("dst_index")
    )
    plain = edges.groupBy("src", "dst").agg(F.min("predicate").alias("predicate"))
    return numbers, plain.join(src, "src").join(dst, "dst").select(
        "src_type", "src_index", "predicate", "dst_type", "dst_index"
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """IO12: numbered nodes and edges as Parquet, split by type."""
    numbers, links = indexed_graph(nodes, edges)
    numbers.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    links.write.mode("overwrite").partitionBy("predicate").parquet(f"{path}/edges")


def write_ranked(members: DataFrame, path: str) -> None:
    """IO13: a ranked cohort as CSV with a header."""
    ranked_members(members).write.mode("overwrite").option("header", True).csv(path)


# Fixed value: the versions of a log record that are understood.
KNOWN_VERSIONS = ("1",)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO15: all lines of a line-by-line JSON log, with ``known``.

    True: a decision record of a known version.  False: a malformed line or a decision of another
    version, which is skipped and counted.  Null: a blank line or a record of another kind.
    """
    schema = (
        "kind string, schema_version string, plan string, reason string, rule string, "
        "scope string, turn_id string, had_causal_fallthrough boolean, _bad string"
    )
    # The parser leaves a line that it can't read in _bad.
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json(
        "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    ).alias("r")).select("r.*")
    decision = F.col("kind") == "routing_decision"
    return lines.withColumn(
        "known",
        F.when(F.col("_bad").isNotNull(), False)
        .when(decision, F.coalesce(F.col("schema_version").isin(*KNOWN_VERSIONS), F.lit(False))),
    ).drop("_bad")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """IO15: the decision records of known versions."""
    return read_lines(spark, path).where("known").drop("known")


def skipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO15: one row with the number of lines that were read and that were skipped."""
    return read_lines(spark, path).agg(
        F.count_if("known").alias("n_read"), F.count_if(~F.col("known")).alias("n_skipped")
    )


def log_counts(records: DataFrame) -> DataFrame:
    """IO15: records per plan, reason, rule and scope, as (field, value, count)."""
    fields = ("plan", "reason", "rule", "scope")
    long = records.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def log_turns(records: DataFrame) -> DataFrame:
    """IO15: decisions, turns, turns with several decisions, and with several plans."""
    turns = records.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("plan").alias("_plans"),
        F.count_if("had_causal_fallthrough").alias("_fell"),
    )
    return turns.agg(
        F.sum("_n").alias("n_decisions"), F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("_n") > 1).alias("n_multi"),
        F.count_if((F.col("_n") > 1) & (F.col("_plans") > 1)).alias("n_mixed"),
        F.sum("_fell").alias("n_fallthrough"),
    )

