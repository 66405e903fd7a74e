"""Queries over memories that come in, duplicate texts and contradictions among those that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.ingest import ingest
from lodestar.plans.intake import _SET, _WORDS
from lodestar.plans.rules import _CLASS, _any
from lodestar.sources.tables import MEMORIES, TEXT_VECTORS, memories, text_vectors

#: Every so many ids one comes in anew, the others are stored.
EVERY = 5


def arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored memories and those that come in, with vectors of their words."""
    rows = text_vectors(memories(spark, sf_dir).select("id", "content", "labels"), T.word_set(F.col("content")))
    new = F.pmod("id", F.lit(EVERY)) == EVERY - 1
    return rows.where(~new), rows.where(new)


def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of all memories come in, in the order of ids: what becomes of each, what it repeats, what it corrects."""
    found = ingest(*arrivals(spark, sf_dir))
    return found.select("id", "outcome", "original", F.array_join(F.col("conflicts").cast("array<string>"), ",").alias("conflicts"), "class")


_SHARE = "CASE WHEN len(a.wl) = 0 THEN 0 ELSE len(list_filter(a.wl, lambda x: list_contains(b.words, x))) / len(a.wl) END"
_ALIKE = "CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0 ELSE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) END"
INGEST_DEDUP = f"""WITH RECURSIVE {MEMORIES},
w AS (SELECT id, {_SET.format("content")} AS words FROM memories), {TEXT_VECTORS},
m AS MATERIALIZED (SELECT m.id, content, strlen(content) AS size, {_CLASS} AS class, {_WORDS.format("content")} AS wl, words, v,
 trim(content) <> '' AND strlen(content) <= 10000 AND len(labels) <= 10 AS valid,
 {_any("lower(content)", T.INTAKE_DENIALS)} AS denies, m.id % {EVERY} = {EVERY - 1} AS new FROM memories m JOIN w USING (id) JOIN tv USING (id)),
b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM m WHERE new AND valid AND class <> 'noise'),
near AS (SELECT a.id AS x, o.id AS y, round(list_cosine_similarity(a.v, o.v), 9) AS sim, NOT o.new AS stored
 FROM b a JOIN m o ON (NOT o.new OR o.id < a.id AND o.valid AND o.class <> 'noise') AND round(list_cosine_similarity(a.v, o.v), 9) > 0.75),
p AS MATERIALIZED (SELECT near.*, a.pos, sim > 0.85 AND b.size > 20 AND {_ALIKE} > CASE WHEN a.size < 30 THEN 0.80 ELSE 0.55 END AS repeats,
 a.denies AND {_SHARE} > 0.4 AS corrects FROM near JOIN b a ON a.id = x JOIN m b ON b.id = y),
walk(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
 SELECT i + 1, CASE WHEN coalesce((SELECT list_bool_or(list(repeats ORDER BY sim DESC, y)[1:3]) FROM p WHERE p.pos = i + 1 AND (stored OR list_contains(taken, y))), false)
  THEN taken ELSE list_append(taken, (SELECT id FROM b WHERE pos = i + 1)) END FROM walk WHERE i < (SELECT count(*) FROM b)),
last AS (SELECT taken FROM walk ORDER BY i DESC LIMIT 1),
top AS (SELECT x, list({{'b': y, 'r': repeats, 'c': corrects}} ORDER BY sim DESC, y)[1:3] AS l FROM p, last WHERE stored OR list_contains(taken, y) GROUP BY x),
r AS (SELECT x, list_filter(l, lambda e: e.r)[1].b AS original, list_sort(list_transform(list_filter(l, lambda e: e.c), lambda e: e.b)) AS conflicts FROM top)
SELECT id, CASE WHEN NOT valid THEN 'invalid' WHEN class = 'noise' THEN 'noise' WHEN original IS NOT NULL THEN 'repeat' ELSE 'in' END AS outcome, original,
CASE WHEN valid AND class <> 'noise' AND original IS NULL THEN coalesce(array_to_string(conflicts, ','), '') END AS conflicts, class
FROM m LEFT JOIN r ON r.x = m.id WHERE new"""

NAMES = "ingest_dedup".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
