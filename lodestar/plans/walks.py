"""Walks over the similarity graph, analogies between its pairs, skills for a query, and pages as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.blocks import neighbours
from lodestar.plans.graphs import _BOTH, relations
from lodestar.plans.search import DISTANT
from lodestar.session import materialize
from lodestar.sources.tables import read, vectors

STEPS = 3
ASKED = ["the", "ation", "un", "de"]


def pulse_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every vector: three steps, each to the strongest neighbour that wasn't visited; where the walk ends."""
    # two neighbours of a node at most were visited before it, so a step is among its three strongest
    edges = materialize(neighbours(vectors(spark, sf_dir), STEPS, DISTANT).withColumnRenamed("similarity", "strength"), "walk-edges")
    walk = edges.select(F.col("a").alias("origin")).distinct().select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"), F.lit(1.0).alias("score"))
    for _ in range(STEPS):
        steps = walk.join(edges, walk.node == edges.a).where(~F.array_contains("path", F.col("b")))
        best = steps.groupBy("origin").agg(F.max(F.struct("strength", (-F.col("b")).alias("b"), "path", "score")).alias("s"))
        moved = best.select("origin", (-F.col("s.b")).alias("node"), F.concat("s.path", F.array(-F.col("s.b"))).alias("path"), (F.col("s.score") * F.col("s.strength")).alias("score"))
        stuck = walk.join(best.select("origin"), "origin", "left_anti")
        walk = moved.unionByName(stuck)
    return walk.select("origin", "node", F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"))


_WALK = "".join(
    f""", s{i} AS (SELECT origin, b, list_append(path, b) AS path, score * strength AS score, row_number() OVER (PARTITION BY origin ORDER BY strength DESC, b) AS k
FROM w{i - 1} JOIN both_ways e ON e.a = node WHERE NOT list_contains(path, b)),
w{i} AS (SELECT origin, b AS node, path, score FROM s{i} WHERE k = 1 UNION ALL SELECT * FROM w{i - 1} WHERE origin NOT IN (SELECT origin FROM s{i}))"""
    for i in range(1, STEPS + 1)
)
PULSE_WALK = f"""WITH {_BOTH}, w0 AS (SELECT DISTINCT a AS origin, a AS node, [a] AS path, 1.0::DOUBLE AS score FROM both_ways){_WALK}
SELECT origin, node, array_to_string(path, '>') AS path, round(score, 6) AS score FROM w{STEPS}"""


def analogies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the 50 strongest pairs: disjoint pairs of nearly the same strength. The report is of 50 pairs only."""
    rounded = relations(spark, sf_dir).withColumn("strength", F.round("strength", 6))
    top = rounded.orderBy(F.desc("strength"), "a", "b").limit(50)
    x, y = (top.select(*(F.col(c).alias(c + k) for c in ("a", "b", "strength"))) for k in "12")
    confidence = F.round(1 - F.abs(F.col("strength1") - F.col("strength2")), 6)
    rows = x.join(y, (F.col("a1") < F.col("a2")) & (F.col("b1") != F.col("b2")) & (F.col("b1") != F.col("a2")) & (F.abs(F.col("strength1") - F.col("strength2")) < 0.01))
    return rows.select("a1", "b1", "a2", "b2", confidence.alias("confidence"))


ANALOGIES = f"""WITH {_BOTH}, t AS (SELECT a, b, round(strength, 6) AS s FROM rel ORDER BY s DESC, a, b LIMIT 50)
SELECT x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2, round(1 - abs(x.s - y.s), 6) AS confidence FROM t x JOIN t y
ON x.a < y.a AND x.b <> y.b AND x.b <> y.a AND abs(x.s - y.s) < 0.01"""


def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as skills: the ten that fit some words best by name, body, use and success."""
    rows = read(spark, sf_dir, "benchmark").select(
        "item_id", F.lower(F.substring("text", 1, 20)).alias("name"), F.lower("text").alias("body"), F.pmod("item_id", F.lit(10)).alias("used")
    )
    score = 2 * T.count_contained(F.col("name"), ASKED) + T.count_contained(F.col("body"), ASKED) + 0.1 * F.log1p("used") + 0.2 * (F.col("used") / 10)
    return rows.select("item_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(10)


_HITS = lambda t: "(" + " + ".join(f"contains({t}, '{w}')::INTEGER" for w in ASKED) + ")"
SKILL_MATCH = f"""WITH s AS (SELECT item_id, lower(substr(text, 1, 20)) AS name, lower(text) AS body, item_id % 10 AS used FROM benchmark)
SELECT item_id, round(2 * {_HITS("name")} + {_HITS("body")} + 0.1 * ln(1 + used) + 0.2 * (used / 10), 6) AS score FROM s ORDER BY score DESC, item_id LIMIT 10"""


def strip_html(page: Column) -> Column:
    """A page without scripts, styles, comments and tags; the common references decoded, white space in one piece."""
    text = F.regexp_replace(page, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of every page's plain text, with its title."""
    text = strip_html(F.col("html"))
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha")
    )


_STRIPPED = r"""regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_name}', '{_sign}')"
PAGE_TEXT = rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace({_STRIPPED}, '[ \t\n\r]+', ' ', 'g')) AS x FROM pages)
SELECT page_id, title, length(x) AS n_chars, sha256(x) AS sha FROM t"""

NAMES = "pulse_walk analogies skill_match page_text".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
