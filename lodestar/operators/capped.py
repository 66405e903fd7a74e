"""Relations that are added one after another, where a node takes only so many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.blocks import neighbours, usable
from lodestar.operators.retrieval import top_per_key
from lodestar.session import discard, materialize

#: Relations that a node takes at most.
MOST = 50


def add_relations(edges: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of edges (a, b, kind, seq, and others) that go in when they are added in the order of seq, which is
    distinct: none if its unordered pair has one of that kind already, or if either end has `most` already.

    Runs in rounds. Of the relations that aren't refused, one that is among the first `most` at both of its ends goes in
    whatever becomes of those before it; one behind `most` that went in at an end is refused. The first open one of all
    always goes in, and each round decides the first ones of every node at once. Of a node only its first `most` are
    looked at, found by slices, so a node with very many relations isn't sorted by one task. Null ends go nowhere."""
    rows = edges.where("a is not null and b is not null")
    pair = [F.least("a", "b"), F.greatest("a", "b"), F.col("kind")]
    first = rows.groupBy(*(c.alias(n) for n, c in zip("xyk", pair, strict=True))).agg(F.min("seq").alias("seq")).select("seq")
    rows = rows.join(first, "seq", "left_semi").select(edges.columns)
    state = materialize(rows.select("seq", "a", "b", F.lit(False).alias("in_")), "capped")
    open_ = state.count()
    while open_:
        ends = state.select("seq", "in_", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        early = top_per_key(ends, "node", most, F.col("seq"))
        safe = early.groupBy("seq").agg(F.count("*").alias("safe"))
        full = early.where("in_").groupBy("node").agg(F.max("seq").alias("last"), F.count("*").alias("n")).where(F.col("n") >= most)
        needed = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
        step = state.join(safe, "seq", "left").withColumn("in_", F.col("in_") | (F.coalesce("safe", F.lit(0)) == needed)).drop("safe")
        for end in ("a", "b"):
            step = step.join(full.select(F.col("node").alias(end), F.col("last").alias(f"last_{end}")), end, "left")
        behind = (F.col("seq") > F.col("last_a")) | (F.col("seq") > F.col("last_b"))
        now = materialize(step.where(F.col("in_") | ~F.coalesce(behind, F.lit(False))).select("seq", "a", "b", "in_"), "capped")
        discard(state)
        state, open_ = now, now.where("not in_").count()
    return rows.join(state.select("seq"), "seq", "left_semi").select(edges.columns)


def add_nearest(rows: DataFrame, least: float, most: int = MOST, decimals: int = 6) -> DataFrame:
    """(a, b, strength): what add_relations lets in of all pairs of rows (id, embedding) with a cosine above least, added
    from the strongest (rounded) on, then by a and b (a < b); without a table of the pairs.

    Runs in rounds. The relations of a row in the order in which they are added are its neighbours by strength and then
    id. Rows that have `most` take part no longer, so a relation is open if both its ends do; each round looks for the
    first of these at every row, and those that are among the first `most`, with the ones it has, at both ends go in. The
    first open one of all always does; rows without an open relation leave as well."""
    left = materialize(usable(rows), "capped-rows")
    in_ = materialize(rows.sparkSession.createDataFrame([], "a long, b long, strength double"), "capped-in")
    while not left.isEmpty():
        # a row has fewer than `most`, so that many more neighbours are enough to have `most` open ones
        near = neighbours(left, 2 * most - 1, least, decimals).withColumnRenamed("similarity", "strength")
        ends = in_.unionByName(in_.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
        near = materialize(near.join(ends.select("a", "b"), ["a", "b"], "left_anti"), "capped-near")
        both = top_per_key(near.withColumn("held", F.lit(False)).unionByName(ends.withColumn("held", F.lit(True))), "a", most, F.desc("strength"), F.col("b"))
        early = both.where("not held").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "strength")
        added = early.groupBy("x", "y").agg(F.count("*").alias("ends"), F.first("strength").alias("strength")).where("ends = 2")
        now = materialize(in_.unionByName(added.select(F.col("x").alias("a"), F.col("y").alias("b"), "strength")), "capped-in")
        taken = now.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        open_ = near.select(F.col("a").alias("id")).distinct()
        rest = left.join(open_, "id", "left_semi").join(taken, "id", "left").where(F.coalesce("n", F.lit(0)) < most)
        rest = materialize(rest.select(left.columns), "capped-rows")
        discard(left, in_, near)
        left, in_ = rest, now
    return in_


def remove_nodes(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """relations without those of the nodes in gone (id), at either end."""
    for end in ("a", "b"):
        relations = relations.join(gone.select(F.col("id").alias(end)), end, "left_anti").select(relations.columns)
    return relations
