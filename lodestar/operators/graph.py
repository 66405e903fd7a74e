"""Relations between memories: decay, neighbours, bounded traversal, component and cluster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.blocks import touched
from lodestar.session import materialize


def both_ways(relations: DataFrame) -> DataFrame:
    """Each relation from either end: a, b, strength."""
    there = relations.select("a", "b", "strength")
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))


def decay(relations: DataFrame, ticks: int, rate: float = 0.9995, least: float = 0.05) -> DataFrame:
    """Strengths after some ticks; relations below the least strength are gone."""
    return relations.withColumn("strength", F.col("strength") * F.pow(F.lit(rate), F.lit(ticks))).where(F.col("strength") >= least)


def hops(relations: DataFrame, origins: DataFrame, most: int) -> DataFrame:
    """(node, hop): fewest steps from any origin (column node), up to most. One join a step against what is new."""
    edges = both_ways(relations).select("a", "b")
    seen = origins.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, most + 1):
        step = edges.join(front, edges.a == front.node).select(F.col("b").alias("node")).distinct()
        front = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hops_between(rows: DataFrame, origins: DataFrame, most: int, least: float) -> DataFrame:
    """hops over the relations of all rows (id, embedding) with a cosine above least, which are never written: a step
    multiplies the rows that are new with those that aren't reached yet."""
    seen = front = materialize(origins.select("node", F.lit(0).alias("hop")).distinct(), "hops")
    for hop in range(1, most + 1):
        new = rows.join(front, rows.id == front.node, "left_semi")
        rest = rows.join(seen, rows.id == seen.node, "left_anti")
        front = materialize(touched(new, rest, least).select(F.col("id").alias("node"), F.lit(hop).alias("hop")), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def multi_hop(relations: DataFrame, origins: DataFrame, most: int, least: float = 0.1) -> DataFrame:
    """(node, hop, score): best product of strengths at the first hop that reaches a node, not below least."""
    edges = both_ways(relations)
    seen = origins.select("node", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    front = seen
    for hop in range(1, most + 1):
        step = edges.join(front, edges.a == front.node).select(F.col("b").alias("node"), (F.col("score") * F.col("strength")).alias("score"))
        step = step.where(F.col("score") >= least).groupBy("node").agg(F.max("score").alias("score"))
        front = materialize(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "score"), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def statistics(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: nodes, relations, nodes without one, mean degree over all nodes, density."""
    degree = both_ways(relations).groupBy("a").agg(F.count("*").alias("degree"))
    found = nodes.join(degree, nodes.id == degree.a, "left").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("orphans"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends")
    )
    n = F.col("nodes")
    return found.select(
        "nodes",
        (F.col("ends") / 2).cast("long").alias("relations"),
        "orphans",
        F.round(F.when(n > 0, F.col("ends") / n).otherwise(0.0), 6).alias("mean_degree"),
        F.round(F.when(n > 1, F.col("ends") / (n * (n - 1))).otherwise(0.0), 6).alias("density"),
    )
