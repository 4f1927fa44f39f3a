"""Set-at-a-time iteration: repeat a join until nothing new appears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import materialise


def transitive_closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All (child, ancestor) pairs reachable over ``edges``.

    Each round extends only the pairs found in the last one: those are joined with all pairs known, on
    either side, so the path length covered doubles and a hierarchy of depth d needs about log2(d)
    rounds.  It ends when a round finds nothing new.  Every round is written to the checkpoint folder,
    which keeps the plan short and lets a lost executor be replaced without starting over.
    """
    known = materialise(
        edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"))
        .where(F.col("child") != F.col("ancestor"))
        .distinct()
    )
    fresh = known

    def composed(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.alias("a").join(
            second.alias("b"), F.col("a.ancestor") == F.col("b.child")
        ).select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"))

    while not fresh.isEmpty():
        older = known.join(fresh, ["child", "ancestor"], "left_anti")
        hop = composed(fresh, known).unionByName(composed(older, fresh))
        fresh = materialise(
            hop.where(F.col("child") != F.col("ancestor")).distinct()
            .join(known, ["child", "ancestor"], "left_anti")
        )
        known = materialise(known.unionByName(fresh))
    return known


def reachable(edges: DataFrame, starts: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(start, node): everything reached from the column ``start`` of ``starts`` by going from parent to child.

    The frontier moves one step a round, so only what lies below the starts is ever read.
    """
    steps = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).where("node <> next").distinct()
    known = materialise(starts.select("start", F.col("start").alias("node")).distinct())
    fresh = known
    while not fresh.isEmpty():
        fresh = materialise(
            fresh.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
            .join(known, ["start", "node"], "left_anti")
        )
        known = materialise(known.unionByName(fresh))
    return known


#: Edges that one task of a round works on.
EDGES_PER_TASK = 250_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Weakly connected components: (node, component), component = smallest node.

    Alternates two rewritings of the edge set.  In the first, every larger
    neighbour of a node is linked to the smallest of its neighbourhood; in the
    second, every smaller neighbour is.  Both use only a minimum per node and an
    equi join, so a hub costs a combine on the map side, and the number of
    rounds grows with the logarithm of the graph's size.  It ends when a round
    leaves every edge as it was.  The number of tasks follows the number of edges, so
    that the many rounds of a small graph don't leave thousands of tiny files.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    links = materialise(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    tasks = max(4, -(-links.count() // EDGES_PER_TASK))
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).coalesce(tasks).distinct()
    links = links.where("u > v").coalesce(tasks)
    while True:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            around.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") > F.col("v")).coalesce(tasks).distinct().coalesce(tasks)
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        )
        new = materialise(small.coalesce(tasks))
        changed = new.withColumn("_new", F.lit(1)).join(
            links.withColumn("_old", F.lit(1)), ["u", "v"], "full_outer"
        ).where("_new IS NULL OR _old IS NULL")
        links = new
        if changed.isEmpty():
            # Now a forest of stars: every node but the smallest of its component has one edge.
            return nodes.join(
                links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left"
            ).select("node", F.coalesce("component", "node").alias("component"))
