"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id that each node can reach.

    Every round takes the least label over a node's neighbours (pre-aggregated before the shuffle) and then
    follows the label once more (pointer jumping), so long chains need about log(length) rounds. Each round is
    written to the shared folder, and the round before it deleted. Null ends are ignored; an empty edge list gives an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    # from one pass over the edges, which may be dear to make
    both = ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = materialize(both.select("e.a", "e.b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        spread = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(spread, "a").select("a", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        hop = labels.select(F.col("a").alias("next"), F.col("label").alias("beyond"))
        jumped = materialize(
            stepped.join(hop, "next", "left").select("a", F.least("next", "beyond").alias("label"), "old"), "labels"
        )
        moved = jumped.where("label <> old").limit(1).count()
        discard(labels)
        labels = jumped.select("a", "label")
        if not moved:
            discard(both)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
