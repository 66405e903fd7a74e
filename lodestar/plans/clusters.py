"""Queries over clusters: the components of the similarity graph with the labels of their members.

Every vector has two labels: its own, and a group by its id. Members with the same labels count as one kind, so pairs
are of kinds within a cluster, weighted by their members, and never of all members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.retrieval import top_per_key
from lodestar.operators.splits import two_seed_split as split_in_two
from lodestar.plans.graphs import _CC, components, relations
from lodestar.session import materialize
from lodestar.sources.tables import vectors


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark, sf_dir)
    rows = vectors(spark, sf_dir).withColumn("labels", F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("g"), F.pmod("id", F.lit(5)))))
    return materialize(found.join(rows, found.node == rows.id).select("component", "id", "embedding", "labels"), "members")


_MEMBERS = f"{_CC}, mem AS (SELECT component, id, v, ['l' || label, 'g' || (id % 5)] AS labels FROM comp JOIN e ON id = node)"


def cluster_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent labels of every cluster."""
    counts = _members(spark, sf_dir).select("component", F.explode("labels").alias("label")).groupBy("component", "label").agg(F.count("*").alias("n"))
    return top_per_key(counts, "component", 3, F.desc("n"), F.col("label"))


CLUSTER_TOP_LABELS = f"""WITH RECURSIVE {_MEMBERS}, c AS (SELECT component, label, count(*) AS n FROM (SELECT component, unnest(labels) AS label FROM mem) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, label) AS rank FROM c) SELECT * FROM r WHERE rank <= 3"""


def cluster_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label distance (1 - Jaccard) over the pairs of a cluster's members, and whether it should be split."""
    kinds = _members(spark, sf_dir).groupBy("component", "labels").agg(F.count("*").alias("n"))
    total = kinds.groupBy("component").agg(F.sum("n").alias("members"))
    pair = kinds.alias("x").join(kinds.alias("y"), "component").where("x.labels < y.labels")
    apart = pair.withColumn("d", (1 - T.jaccard(F.col("x.labels"), F.col("y.labels"))) * F.col("x.n") * F.col("y.n"))
    sums = apart.groupBy("component").agg(F.sum("d").alias("d"))
    mean = F.coalesce(F.col("d"), F.lit(0.0)) / (F.col("members") * (F.col("members") - 1) / 2)
    rows = total.join(sums, "component", "left").select("component", "members", F.round(mean, 6).alias("dispersion"))
    return rows.withColumn("split", (F.col("members") >= 30) | ((F.col("dispersion") >= 0.4) & (F.col("members") >= 6)))


CLUSTER_DISPERSION = f"""WITH RECURSIVE {_MEMBERS}, t AS (SELECT component, count(*) AS members FROM mem GROUP BY 1),
d AS (SELECT x.component, avg(1 - len(list_intersect(x.labels, y.labels)) / len(list_distinct(list_concat(x.labels, y.labels)))) AS d
FROM mem x JOIN mem y ON x.component = y.component AND x.id < y.id GROUP BY 1),
r AS (SELECT component, members, round(coalesce(d, 0), 6) AS dispersion FROM t LEFT JOIN d USING (component))
SELECT *, members >= 30 OR dispersion >= 0.4 AND members >= 6 AS split FROM r"""


def fission_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of clusters of six or more: members by first label, and which of those groups would move out."""
    groups = _members(spark, sf_dir).groupBy("component", F.element_at("labels", 1).alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    whole = groups.groupBy("component").agg(F.sum("n").alias("members"), F.max(F.struct("n", (-F.col("first_id")).alias("i"))).alias("top"))
    rows = groups.join(whole.where("members >= 6"), "component")
    return rows.select("component", "label", "n", "first_id", (F.col("first_id") != -F.col("top.i")).alias("moves"))


FISSION_GROUPS = f"""WITH RECURSIVE {_MEMBERS}, g AS (SELECT component, labels[1] AS label, count(*) AS n, min(id) AS first_id FROM mem GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY component) AS members, row_number() OVER (PARTITION BY component ORDER BY n DESC, first_id) AS k FROM g)
SELECT component, label, n, first_id, k <> 1 AS moves FROM r WHERE members >= 6"""


def cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label similarity of the clusters that share a label: the join is on the labels, not of all clusters."""
    sets = _members(spark, sf_dir).select("component", F.explode("labels").alias("label")).distinct()
    sizes = sets.groupBy("component").agg(F.count("*").alias("size"))
    shared = sets.alias("x").join(sets.alias("y"), "label").where("x.component < y.component")
    both = shared.groupBy(F.col("x.component").alias("one"), F.col("y.component").alias("other")).agg(F.count("*").alias("shared"))
    one, other = (sizes.select(F.col("component").alias(k), F.col("size").alias("size_" + k)) for k in ("one", "other"))
    rows = both.join(one, "one").join(other, "other")
    return rows.select("one", "other", "shared", F.round(F.col("shared") / (F.col("size_one") + F.col("size_other") - F.col("shared")), 6).alias("similarity"))


CLUSTER_DISTANCES = f"""WITH RECURSIVE {_MEMBERS}, s AS (SELECT DISTINCT component, unnest(labels) AS label FROM mem),
n AS (SELECT component, count(*) AS size FROM s GROUP BY 1),
b AS (SELECT x.component AS one, y.component AS other, count(*) AS shared FROM s x JOIN s y ON x.label = y.label AND x.component < y.component GROUP BY ALL)
SELECT one, other, shared, round(shared / (p.size + q.size - shared), 6) AS similarity FROM b JOIN n p ON p.component = one JOIN n q ON q.component = other"""


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors close enough to merge: which stays (the heavier, then the smaller id) and its new mass."""
    mass = lambda c: 1 + F.pmod(F.col(c), F.lit(7)) * 0.25
    pairs = relations(spark, sf_dir).where("strength > 0.4")
    first = (mass("a") > mass("b")) | ((mass("a") == mass("b")) & (F.col("a") < F.col("b")))
    stays, goes = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    return pairs.select(stays.alias("stays"), goes.alias("goes"), (F.greatest(mass("a"), mass("b")) + 0.5).alias("mass"), F.round("strength", 6).alias("strength"))


MERGE_CANDIDATES = f"""WITH RECURSIVE {_MEMBERS}, m AS (SELECT a, b, 1 + (a % 7) * 0.25::DOUBLE AS ma, 1 + (b % 7) * 0.25::DOUBLE AS mb, strength FROM rel WHERE strength > 0.4)
SELECT CASE WHEN ma > mb OR ma = mb AND a < b THEN a ELSE b END AS stays, CASE WHEN ma > mb OR ma = mb AND a < b THEN b ELSE a END AS goes,
greatest(ma, mb) + 0.5 AS mass, round(strength, 6) AS strength FROM m"""

def two_seed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every cluster by the one of its two least similar members whose labels are more like theirs."""
    rows = _members(spark, sf_dir).select(F.col("component").alias("group"), "id", "labels")
    return split_in_two(rows).select(F.col("group").alias("component"), "id", "side")


_ALIKE = "len(list_intersect({0}.labels, {1}.labels)) / len(list_distinct(list_concat({0}.labels, {1}.labels)))"
TWO_SEED_SPLIT = f"""WITH RECURSIVE {_MEMBERS},
far AS (SELECT x.component, x.id AS a, y.id AS b, x.labels AS la, y.labels AS lb FROM mem x JOIN mem y ON x.component = y.component AND x.id < y.id
 QUALIFY row_number() OVER (PARTITION BY x.component ORDER BY {_ALIKE.format("x", "y")}, x.id, y.id) = 1),
s AS (SELECT m.component, m.id, m.labels, a, b, struct_pack(labels := la) AS p, struct_pack(labels := lb) AS q FROM mem m LEFT JOIN far USING (component))
SELECT component, id, CASE WHEN a IS NULL OR id = a OR id <> b AND {_ALIKE.format("s", "p")} >= {_ALIKE.format("s", "q")} THEN 'a' ELSE 'b' END AS side FROM s"""

NAMES = "two_seed_split cluster_top_labels cluster_dispersion fission_groups cluster_distances merge_candidates".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
