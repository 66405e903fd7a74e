"""Recall: what is near to the rows that a search finds, over relations and clusters.

A step over a relation passes on the larger of what came in and the relation's strength; a step to the other members of
a cluster passes on half of what came in, and isn't the last step. Levels are joins: a query's reached rows of one level
meet the relations, and clusters meet the two highest of their reached members only, so a large cluster isn't paired with
itself. What an earlier level reached with as much is not followed again.

Where the clusters are the components of the relations, three steps reach all of a component, so `recall_connected` takes
what is the same for all queries from the relations once, and follows only scores that can change a query's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import both_ways
from lodestar.operators.retrieval import top_per_key
from lodestar.session import materialize

MOST, KEPT = 30, 40
PEERS = 0.5
#: Rows of a query with just the score of its MOST-th up to which steps start from these, and not from the rows that they
#: could lead to. It changes the order of the work, not the result.
FEW = 100


def _over_relations(front: DataFrame, edges: DataFrame) -> DataFrame:
    met = front.join(edges, front.id == edges.a)
    return met.select("query_id", F.col("b").alias("id"), F.greatest("score", "strength").alias("score"))


def _to_peers(front: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each member of a reached cluster gets half of the highest score of the other members."""
    own = front.join(clusters, "id").select(F.struct("query_id", "cluster").alias("key"), "id", "score")
    best = top_per_key(own, "key", 2, F.desc("score"), F.col("id")).groupBy("key").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("id", "score"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("other")
    )
    met = best.select("key.query_id", "key.cluster", "one", "other").join(clusters, "cluster")
    return met.select("query_id", "id", (PEERS * F.when(F.col("id") != F.col("one.id"), F.col("one.score")).otherwise(F.col("other"))).alias("score")).where(
        "score is not null"
    )


def expand(seeds: DataFrame, relations: DataFrame, depth: int, clusters: DataFrame | None = None) -> DataFrame:
    """(query_id, id, assoc): every row that depth steps reach from a query's seeds (query_id, id, score), with the highest
    score that comes in; seeds too where something comes back to them."""
    edges = both_ways(relations)
    front = materialize(seeds.groupBy("query_id", "id").agg(F.max("score").alias("score")), "recall-front")
    seen, reached = front, None
    for level in range(depth):
        step = _over_relations(front, edges)
        if clusters is not None and level + 1 < depth:
            step = step.unionByName(_to_peers(front, clusters))
        came = materialize(step.groupBy("query_id", "id").agg(F.max("score").alias("score")), "recall-front")
        reached = came if reached is None else reached.unionByName(came)
        before = seen.groupBy("query_id", "id").agg(F.max("score").alias("before"))
        front = came.join(before, ["query_id", "id"], "left").where("before is null or before < score").drop("before")
        seen = seen.unionByName(front)
    if reached is None:
        return front.limit(0).withColumnRenamed("score", "assoc")
    return reached.groupBy("query_id", "id").agg(F.max("score").alias("assoc"))


def reached_count(seeds: DataFrame, relations: DataFrame, depth: int, most: int) -> DataFrame:
    """(query_id, n): how many rows a query has with its seeds and all that depth steps over relations lead to, `most` at
    most. A query that has so many isn't followed any further, so a step starts from fewer than `most` rows a query."""
    edges = both_ways(relations).select("a", "b")
    front = seen = materialize(seeds.select("query_id", "id").distinct(), "recall-front")
    for _ in range(depth):
        counts = seen.groupBy("query_id").agg(F.count("*").alias("n"))
        front = front.join(counts.where(F.col("n") < most), "query_id", "left_semi")
        step = F.broadcast(front).join(edges, front.id == edges.a).select("query_id", F.col("b").alias("id")).distinct()
        front = materialize(step.join(seen, ["query_id", "id"], "left_anti"), "recall-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("query_id").agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def recall(seeds: DataFrame, relations: DataFrame, clusters: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, direct, assoc, rank): seeds, and of what they lead to the MOST strongest; the KEPT best of all."""
    return _best(seeds, expand(seeds, relations, depth, clusters))


def _best(seeds: DataFrame, reached: DataFrame) -> DataFrame:
    direct = seeds.select("query_id", "id", F.col("score").alias("direct"))
    own = direct.join(reached, ["query_id", "id"], "left").withColumn("assoc", F.coalesce("assoc", F.lit(0.0)))
    others = top_per_key(reached.join(direct, ["query_id", "id"], "left_anti"), "query_id", MOST, F.desc("assoc"), F.col("id")).drop("rank")
    both = own.unionByName(others.select("query_id", "id", F.lit(0.0).alias("direct"), "assoc"))
    return top_per_key(both, "query_id", KEPT, F.desc(F.greatest("direct", "assoc")), F.col("id"))


def _highest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def _met_by(pairs: DataFrame, edges: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, id, score): for each of pairs (query_id, id) the highest of scored among the neighbours of the row."""
    asked = pairs.join(edges, pairs.id == edges.a).select("query_id", "id", F.col("b").alias("by"))
    return _highest(asked.join(scored.select("query_id", F.col("id").alias("by"), "score"), ["query_id", "by"]))


def _bound(met: DataFrame, own: DataFrame, half: DataFrame) -> DataFrame:
    """(query_id, least, before): score and id of the MOST-th row of met that isn't a seed; -1 and null where there are fewer."""
    other = met.join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    last = top_per_key(other.select("query_id", "id", "score"), "query_id", MOST, F.desc("score"), F.col("id")).where(F.col("rank") == MOST)
    found = half.select("query_id").distinct().join(last.select("query_id", F.col("score").alias("least"), F.col("id").alias("before")), "query_id", "left")
    return found.withColumn("least", F.coalesce("least", F.lit(-1.0)))


def _tied(bound: DataFrame, scored: DataFrame, name: str) -> DataFrame:
    """bound with many: whether more than FEW of a query's scored rows have just the score of its MOST-th row."""
    ties = scored.join(F.broadcast(bound), "query_id").where("score = least").groupBy("query_id").agg(F.count("*").alias("ties"))
    counted = bound.join(ties, "query_id", "left").select("query_id", "least", "before", (F.coalesce("ties", F.lit(0)) > FEW).alias("many"))
    return materialize(counted, name)


def _followed(scored: DataFrame, bound: DataFrame) -> DataFrame:
    """The rows of scored from which a step can change the MOST first rows of a query; of many ties none, as these are
    looked for from the other end."""
    return scored.join(F.broadcast(bound), "query_id").where((F.col("score") > F.col("least")) | ((F.col("score") == F.col("least")) & ~F.col("many")))


def _low(rows: DataFrame, met: DataFrame, own: DataFrame, half: DataFrame, bound: DataFrame) -> DataFrame:
    """(query_id, id): the rows that would be among the MOST first of a query with the score of its MOST-th, but have less."""
    asks = half.join(bound, "query_id").where("least <= top and half < least")
    low = rows.join(F.broadcast(asks), "cluster").where("id < before and near < least").select("query_id", "id", "least")
    known = met.select("query_id", "id", "score").unionByName(own.select("query_id", "id", F.lit(2.0).alias("score")))
    there = _highest(known).join(F.broadcast(bound.select("query_id", F.col("least").alias("bar"))), "query_id").where("score >= bar")
    return low.join(there, ["query_id", "id"], "left_anti").select("query_id", "id")


def recall_connected(seeds: DataFrame, relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """recall with three steps where the clusters are the components of the relations; scores and strengths aren't negative.

    Then all of a component is reached, and what comes in at a row is the largest of: the strengths of its neighbours'
    relations (`near`; by a cluster and two relations, for every query), half of the best that one relation gives anywhere
    in the component (`half`; by a relation and a cluster), and what one, two or three relations lead in from a seed.
    Every other path gives no more than one of these. One relation is followed from all seeds. After that a score counts
    only at a seed and at a row that it takes into the MOST strongest others, and none is above `top`, the best that one
    relation gives. So from few rows, those above the MOST-th score so far and at it, steps go forward; the neighbours of a
    neighbour are asked for seeds that are below top, and for rows of low ids where very many scores tie with the MOST-th.
    The rows of the lowest ids and of the highest near of a component are asked first, as they make that score high."""
    edges = both_ways(relations)
    own = seeds.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(clusters, "id")
    own = materialize(own, "recall-seeds")
    most = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.max("strength").alias("most")), "recall-most")
    near = edges.join(most, edges.b == most.id).groupBy("a").agg(F.max("most").alias("near"))
    rows = near.withColumnRenamed("a", "id").join(most, "id").join(clusters, "id").select("id", "cluster", "near", "most")
    rows = materialize(rows, "recall-rows")
    one = materialize(_highest(_over_relations(own.select("query_id", "id", "score"), edges)).join(rows, "id"), "recall-one")
    half = one.groupBy("query_id", "cluster").agg((PEERS * F.max("score")).alias("half"), F.max("score").alias("top"))
    floor = rows.groupBy("cluster").agg(F.min("near").alias("floor"))
    half = materialize(half.join(floor, "cluster"), "recall-half")
    live = one.join(half, ["query_id", "cluster"]).where("score > half and score > floor").select("query_id", "id", "score")

    # the rows of a component that rank first by near and by id, as many as there can be seeds among them and MOST others
    room = MOST + (own.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    first = [top_per_key(rows, "cluster", room, *order).select("id", "cluster") for order in ((F.desc("near"), F.col("id")), (F.col("id"),))]
    first = first[0].unionByName(first[1]).distinct().join(half.select("query_id", "cluster"), "cluster").select("query_id", "id", F.lit(0.0).alias("score"))
    first = first.unionByName(own.select("query_id", "id", F.lit(0.0).alias("score")))

    def placed(scored: DataFrame) -> DataFrame:
        met = _highest(scored).join(rows, "id").join(half, ["query_id", "cluster"])
        return met.select("query_id", "id", "top", F.greatest("score", "near", "half").alias("score"))

    asked = placed(first.unionByName(one.select("query_id", "id", "score"))).join(first.select("query_id", "id").distinct(), ["query_id", "id"])
    asked = materialize(asked.where("score < top").select("query_id", "id"), "recall-asked")
    met = placed(first.unionByName(one.select("query_id", "id", "score")).unionByName(_met_by(asked, edges, live)))
    met = materialize(met, "recall-met")
    bound = _tied(_bound(met, own, half), one, "recall-bound")

    front = _followed(live, bound)
    step = front.join(edges, front.id == edges.a).select("query_id", F.col("b").alias("id"), "score")
    two = materialize(_highest(step.join(rows.select("id", "most"), "id").where("score > most")), "recall-two")
    turned = _met_by(_low(rows, met, own, half, bound.where("many")), edges, live)
    met = materialize(placed(met.select("query_id", "id", "score").unionByName(two).unionByName(turned)), "recall-met")
    early, bound = bound, _tied(_bound(met, own, half), two, "recall-bound")

    front = materialize(_followed(two, bound).select("query_id", "id", "score", "least", "before"), "recall-front")
    led = front.join(edges, front.id == edges.a).where("score > least or b < before").select("query_id", F.col("b").alias("id"), "score")
    # scores of just the MOST-th that two doesn't hold: they weren't followed
    unheld = bound.join(early.where("many").select("query_id", F.col("least").alias("was")), "query_id").where("least = was").drop("was")
    held = bound.where("many").join(unheld.select("query_id"), "query_id", "left_anti")
    back = _met_by(_low(rows, met, own, half, held), edges, two)
    open_ = met.where("score < top").join(own.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id")
    asked = materialize(open_.unionByName(_low(rows, met, own, half, unheld)), "recall-asked")
    by = asked.join(edges, asked.id == edges.a).select("query_id", F.col("b").alias("id")).distinct()
    far = _met_by(asked, edges, _met_by(by, edges, live))
    reached = _highest(met.select("query_id", "id", "score").unionByName(led).unionByName(back).unionByName(far))
    return _best(seeds, reached.withColumnRenamed("score", "assoc"))


def in_sections(found: DataFrame, sections: DataFrame) -> DataFrame:
    """found with section and section_rank: sections (id, section) by the best row in them, then by name."""
    named = found.join(sections, "id", "left").withColumn("section", F.coalesce("section", F.lit("general")))
    best = named.groupBy("query_id", "section").agg(F.max(F.greatest("direct", "assoc")).alias("best"))
    ranked = top_per_key(best, "query_id", KEPT, F.desc("best"), F.col("section")).withColumnRenamed("rank", "section_rank")
    return named.join(ranked.select("query_id", "section", "section_rank"), ["query_id", "section"])
