"""Queries that review the collection: labels that clusters share, members that overlap, the largest concepts, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.plans.clusters import _MEMBERS, _members
from lodestar.plans.graphs import CONCEPTS, concepts
from lodestar.plans.intake import _TOPIC_CASES
from lodestar.plans.rules import _TAGS
from lodestar.sources.tables import MEMORIES, memories

FIRST, SHOWN, AHEAD, ALIASES = 25, 15, 9, 10


def cross_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 25 members of clusters the first 15 pairs of different clusters that share labels, and these."""
    rows = _members(spark, sf_dir).select("id", "component", "labels").orderBy("id").limit(FIRST)
    one = rows.select("id", "component", F.explode(F.array_distinct("labels")).alias("label"))
    met = one.alias("x").join(one.alias("y"), "label").where("x.id < y.id and x.component <> y.component")
    pairs = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("shared"))
    return pairs.orderBy("a", "b").limit(SHOWN)


CROSS_CLUSTER_LABELS = f"""WITH RECURSIVE {_MEMBERS}, f AS (SELECT id, component, labels FROM mem ORDER BY id LIMIT {FIRST})
SELECT x.id AS a, y.id AS b, array_to_string(list_sort(list_intersect(x.labels, y.labels)), ',') AS shared FROM f x JOIN f y ON x.id < y.id AND x.component <> y.component
WHERE list_has_any(x.labels, y.labels) ORDER BY 1, 2 LIMIT {SHOWN}"""


def cluster_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cluster and the nine after them, by id, that share more than 0.6 of the fewer labels of the two."""
    place = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    rows = _members(spark, sf_dir).select("component", "id", F.array_distinct("labels").alias("labels"), place.alias("place"))
    ahead = rows.select("component", F.col("id").alias("a"), F.col("labels").alias("own"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + AHEAD)).alias("place"))
    met = ahead.join(rows, ["component", "place"])
    shared = F.size(F.array_intersect("own", "labels"))
    share = shared / F.greatest(F.least(F.size("own"), F.size("labels")), F.lit(1))
    return met.where(share > 0.6).select("component", "a", F.col("id").alias("b"), shared.cast("long").alias("shared"))


CLUSTER_LABEL_OVERLAP = f"""WITH RECURSIVE {_MEMBERS}, p AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) AS place FROM mem)
SELECT x.component, x.id AS a, y.id AS b, len(list_intersect(x.labels, y.labels))::BIGINT AS shared FROM p x JOIN p y ON x.component = y.component AND y.place BETWEEN x.place + 1 AND x.place + {AHEAD}
WHERE len(list_intersect(x.labels, y.labels)) / greatest(least(len(x.labels), len(y.labels)), 1) > 0.6"""


def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest concepts, with their label and number of members."""
    return concepts(spark, sf_dir).select("component", "label", "members").orderBy(F.desc("members"), "component").limit(10)


TOP_CONCEPTS = f"SELECT component, label, members FROM ({CONCEPTS}) ORDER BY members DESC, component LIMIT 10"


def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of every memory (its labels and tags) after its topics come in as new ones: each once, the last ten kept."""
    rows = memories(spark, sf_dir).select("id", F.array_distinct(F.concat("labels", T.tags(F.col("content")))).alias("old"), T.topics(F.col("content")).alias("new"))
    merged = F.array_union("old", "new")
    return rows.select("id", F.array_join(F.when(F.size(merged) > ALIASES, F.slice(merged, -ALIASES, ALIASES)).otherwise(merged), ",").alias("aliases"))


MERGED_ALIASES = f"""WITH {MEMORIES}, t AS (SELECT id, labels, coalesce(list_sort(list_distinct([{_TAGS.replace("text", "lower(content)")}])), []) AS tags,
 list_filter([{_TOPIC_CASES}], lambda x: x IS NOT NULL) AS topics FROM memories),
n AS (SELECT id, unnest(topics) AS label, unnest(range(len(topics))) AS pos FROM t),
k AS (SELECT id, list(label ORDER BY r) AS new FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS r FROM n GROUP BY id, label) WHERE r <= 3 GROUP BY id),
l AS (SELECT t.id, list_concat(labels, list_concat(list_filter(tags, lambda x: x IS NOT NULL), coalesce(new, ['general']))) AS l FROM t LEFT JOIN k ON k.id = t.id),
x AS (SELECT id, unnest(l) AS label, unnest(range(len(l))) AS pos FROM l), f AS (SELECT id, label, min(pos) AS pos FROM x WHERE label IS NOT NULL GROUP BY id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS back FROM f)
SELECT id, string_agg(label, ',' ORDER BY pos) AS aliases FROM r WHERE back <= {ALIASES} GROUP BY id"""

NAMES = "cross_cluster_labels cluster_label_overlap top_concepts merged_aliases".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
