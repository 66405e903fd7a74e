"""Queries that ask the memories: every benchmark text is a query, behind one of the openings below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.blocks import links, similar_pairs
from lodestar.operators.components import connected_components
from lodestar.operators.intent_search import search as find
from lodestar.operators.intent_search import search_intent as _search
from lodestar.operators.intent_search import understood
from lodestar.operators.recall import in_sections, reached_count, recall_connected
from lodestar.plans.graphs import _CC, components
from lodestar.plans.intake import _SET, _boost_sql
from lodestar.plans.intents import _EXCLUDED, _FAVOURED, _WIDENED
from lodestar.plans.rules import _CLASS, _any, _lit
from lodestar.plans.search import DISTANT, TOKENS
from lodestar.session import materialize
from lodestar.sources.tables import AS_OF, MEMORIES, PHRASES, TEXT_VECTORS, memories, read, text_vectors, vectors

OPENINGS = [
    "how to fix the deploy error", "why redis not docker", "recent 部署 without nginx", "安全 convention for the python api",
    "compare rust vs python", "", "performance of search", "数据库 错误 last time",
]
LIMIT = 10
#: Of so many queries one has no vector.
BLIND = 4


def asked(spark: SparkSession, sf_dir: str, widened: bool = True) -> DataFrame:
    """query_id, text, what is understood of it, and a vector of its words (none for one in BLIND); widened: with the
    words that the intent adds."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.pmod("item_id", F.lit(len(OPENINGS))) + 1).cast("int"))
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.concat_ws(" ", opening, "text").alias("text"))
    rows = understood(rows.withColumnRenamed("id", "query_id"))
    if not widened:
        rows = rows.withColumns({"wide": F.col("text"), "terms": F.col("own")})
    placed = text_vectors(rows.select(F.col("query_id").alias("id"), "wide"), T.word_set(F.col("wide")))
    vector = F.when(F.pmod("id", F.lit(BLIND)) != BLIND - 1, F.col("embedding")).alias("embedding")
    return rows.join(placed.select(F.col("id").alias("query_id"), vector), "query_id")


def asked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that are searched; their vectors are made of their words where the search reads them."""
    rows, tasks = memories(spark, sf_dir).drop("enforced").where("id is not null"), spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if read(spark, sf_dir, "documents").rdd.getNumPartitions() < tasks else rows


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cluster: components of the relations."""
    return components(spark, sf_dir).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def search_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best memories of every query, by all stages of the search with intent."""
    found = _search(asked_rows(spark, sf_dir), asked(spark, sf_dir), clusters(spark, sf_dir), AS_OF, LIMIT)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _tokens(text: str) -> str:
    """SQL list of the terms of a fixed text: words, and runs of CJK characters as pairs (short ones as a whole too)."""
    out, run = [], ""
    cjk = lambda c: "\u4e00" <= c <= "\u9fff" or "\u3001" <= c <= "\u303f"
    for c in text.lower() + " ":
        same = run and cjk(c) == cjk(run[0])
        if run and not (same and (c.isalnum() or c in "-_./:" or cjk(c))):
            pairs = [run[i : i + 2] for i in range(len(run) - 1)]
            out += [run] if not cjk(run[0]) or len(run) == 1 else pairs + ([run] if len(run) <= 3 else [])
            run = ""
        if c.isalnum() or c in "-_./:" or cjk(c):
            run += c
    return "[" + ", ".join(map(_lit, out)) + "]::VARCHAR[]"


_OPENINGS = ", ".join(f"({i}, {_lit(x)}, {_tokens(x)})" for i, x in enumerate(OPENINGS))
_PHRASE_TOKENS = ", ".join(f"({i}, {_tokens(x)})" for i, x in enumerate(PHRASES))
_IN = lambda words, text: f"len(list_filter({words}, lambda x: contains({text}, x)))"
_PART = lambda text: f"CASE WHEN len(q.terms) = 0 THEN 0 ELSE {_IN('q.terms', text)} / len(q.terms) END"
_KINDS = sorted({k for _, _, given in T.INTENTS for k in given})


def _found(k: int, widened: bool = True) -> str:
    """SQL of the search up to scored, for the best k of every query."""
    wide = "full_text || CASE WHEN len(expanded) > 0 THEN ' ' || array_to_string(expanded, ' ') ELSE '' END" if widened else "full_text"
    terms = f"list_concat(own, {TOKENS.replace('text', 'more')})" if widened else "own"
    return f"""{_CC}, {MEMORIES}, openings(p, opening, otok) AS (VALUES {_OPENINGS}), ptok(p, toks) AS (VALUES {_PHRASE_TOKENS}),
q0 AS (SELECT item_id AS query_id, opening || ' ' || text AS full_text, lower(opening || ' ' || text) AS text, list_concat(otok, {TOKENS}) AS own
 FROM benchmark JOIN openings ON p = item_id % {len(OPENINGS)}),
q1 AS (SELECT *, coalesce(list_sort(list_distinct(flatten([{_WIDENED}]))), []) AS expanded, list_filter([{_FAVOURED}], lambda x: x IS NOT NULL) AS favoured,
 coalesce(list_distinct(list_filter([{_EXCLUDED}], lambda x: x IS NOT NULL)), []) AS excluded,
 CASE WHEN {_any("text", T.THIS_WEEK)} THEN 2.0 WHEN {_any("text", T.RECENT)} THEN 2.5 ELSE 1 END::DOUBLE AS temporal,
 {", ".join(_boost_sql(kind) for kind in _KINDS)} FROM q0),
q2 AS (SELECT *, {wide} AS wide, array_to_string(expanded, ' ') AS more FROM q1),
q AS MATERIALIZED (SELECT *, {terms} AS terms FROM q2),
w AS (SELECT id, {_SET.format("content")} AS words FROM memories UNION ALL SELECT -1 - query_id, {_SET.format("wide")} FROM q), {TEXT_VECTORS},
tok AS MATERIALIZED (SELECT m.id, list_concat(toks, list_concat({TOKENS.replace("text", "d.text")}, {TOKENS.replace("text", "array_to_string(labels, ' ')")})) AS terms
 FROM memories m JOIN documents d ON d.doc_id = m.id JOIN ptok ON p = m.id % {len(PHRASES)}),
st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS avg_dl FROM tok),
near AS (SELECT q.query_id, m.id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM q JOIN tv a ON a.id = -1 - q.query_id CROSS JOIN memories m JOIN tv b ON b.id = m.id
 WHERE q.query_id % {BLIND} <> {BLIND - 1}),
touched AS (SELECT q.query_id, m.id FROM q, memories m WHERE q.query_id % {BLIND} = {BLIND - 1} AND len(list_filter(labels, lambda l:
 len(list_filter(q.terms, lambda t: contains(lower(l), t))) > 0)) > 0),
cand AS (SELECT * FROM near UNION ALL SELECT query_id, id, NULL FROM touched UNION ALL
 SELECT query_id, id, NULL FROM q, (SELECT id FROM memories) WHERE query_id % {BLIND} = {BLIND - 1} AND query_id NOT IN (SELECT query_id FROM touched)),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS bm
 FROM cand JOIN post USING (id) JOIN asked USING (query_id, term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
part AS (SELECT p.query_id, p.id, coalesce(bm, 0) AS bm, CASE WHEN p.similarity IS NULL THEN {_PART("lower(content)")} ELSE greatest(p.similarity, 0) END AS vec,
 {_PART("lower(array_to_string(labels, ' '))")} AS label, {_PART("lower(content) || ' ' || lower(array_to_string(labels, ' '))")} > 0.5 AS exact,
 greatest(({AS_OF} - ts) / 86400.0::DOUBLE, 0) AS age, m.* EXCLUDE (id) FROM cand p JOIN memories m USING (id) JOIN q USING (query_id) LEFT JOIN bm USING (query_id, id)),
raw AS (SELECT *, (0.5 * vec + bm / (bm + 1) * (CASE WHEN exact THEN 0.35 ELSE 0.20 END) + 0.15 * label) * exp(-0.08 * age) * greatest(importance, 0.1)
 * (1 + access_count / (access_count + 5) * 0.3) AS r FROM part),
scored AS (SELECT query_id, id, round(least(r * (CASE WHEN list_contains(labels, 'junk') OR strlen(trim(content)) < 10 THEN 0.3 ELSE 1.0 END)
 * (CASE WHEN r > 0.3 THEN 1 + 0.1 * greatest(mass - 1, 0) ELSE 1.0 END), 1.0), 9) AS score FROM raw),
cut1 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


_SEARCH = f"""{_found(3 * LIMIT)},
bonus AS (SELECT c.query_id, c.id, round(score + CASE {_CLASS} {" ".join(f"WHEN '{k}' THEN CASE WHEN q.{k} > 1 THEN q.{k} ELSE 0 END" for k in _KINDS)} ELSE 0 END * 0.15
 + len(list_filter(labels, lambda x: list_contains(favoured, x))) * 1.5 * 0.08 + CASE WHEN temporal > 1 THEN exp(-0.1 * ({AS_OF} - ts) / 86400.0::DOUBLE) * temporal * 0.15 ELSE 0 END
 + CASE WHEN access_count > 0 THEN ln(access_count) * 0.03 ELSE 0 END + CASE WHEN importance > 2 THEN 0.05 ELSE 0 END
 + {_IN("expanded", "lower(content)")} * 0.04 - {_IN("excluded", "lower(content)")} * 0.5, 9) AS score, importance, access_count, content
 FROM cut1 c JOIN memories m USING (id) JOIN q USING (query_id)),
cut2 AS (SELECT * FROM bonus QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * LIMIT}),
fit AS (SELECT query_id, component, round(sum({_IN("own", "lower(content)")} * importance), 6) AS fit FROM q, comp JOIN memories m ON m.id = node GROUP BY ALL),
top AS (SELECT query_id, component FROM fit WHERE fit > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fit DESC, component) = 1),
last AS (SELECT c.query_id, c.id, round(score + CASE WHEN t.query_id IS NULL THEN 0 ELSE 0.08 END + CASE WHEN importance >= 2.5 THEN 0.06 ELSE 0 END
 + CASE WHEN access_count > 5 THEN 0.04 ELSE 0 END, 9) AS score FROM cut2 c LEFT JOIN comp ON node = c.id LEFT JOIN top t ON t.query_id = c.query_id AND t.component = comp.component
 WHERE NOT (importance < 0.1 AND strlen(content) < 15)),
found AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM last WHERE score >= 0)"""
SEARCH_INTENT = f"WITH RECURSIVE {_SEARCH} SELECT query_id, rank, id, round(score, 6) AS score FROM found WHERE rank <= {LIMIT}"

SEEDS, DEPTH = 20, 3
ASKED_ROWS, LINE = 30, 300


def _seeds(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The best 20 memories of every query, without what an intent adds."""
    return materialize(find(rows, materialize(asked(spark, sf_dir, False), "search-queries"), AS_OF, SEEDS), "seeds")


def _known_relations(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Relations between memories that are there."""
    known = similar_pairs(_known_vectors(spark, sf_dir, rows), DISTANT).withColumnRenamed("similarity", "strength")
    return materialize(known.withColumn("strength", F.round("strength", 9)), "known-relations")


def _known_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return vectors(spark, sf_dir).join(rows.select("id"), "id", "left_semi")


def recall_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every query the 40 best of its 20 seeds and the 30 strongest that three steps lead to, in sections."""
    rows = asked_rows(spark, sf_dir)
    rel = _known_relations(spark, sf_dir, rows)
    peers = connected_components(links(_known_vectors(spark, sf_dir, rows), DISTANT), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    found = recall_connected(_seeds(spark, sf_dir, rows), rel, peers)
    named = in_sections(found, rows.select("id", F.element_at("labels", 1).alias("section")))
    return named.select("query_id", "rank", "id", "section", "section_rank", F.round("direct", 6).alias("direct"), F.round("assoc", 6).alias("assoc"))


def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every query its answer, a line for each seed that is relevant, and the number of memories that it rests on."""
    rows = asked_rows(spark, sf_dir)
    seeds = _seeds(spark, sf_dir, rows)
    count = reached_count(seeds, _known_relations(spark, sf_dir, rows), DEPTH, ASKED_ROWS).withColumnRenamed("n", "memory_count")
    labels = F.array_join(F.slice("labels", 1, 2), ",")
    line = F.concat(F.lit("[#"), F.col("id").cast("string"), F.lit("] ["), labels, F.lit("] "), F.substring("content", 1, LINE))
    lines = seeds.where("score > 0.1").join(rows.select("id", "labels", "content"), "id").select("query_id", F.struct("rank", line.alias("line")).alias("l"))
    answers = lines.groupBy("query_id").agg(F.array_sort(F.collect_list("l")).alias("l"))  # 20 lines at most
    return count.join(answers, "query_id", "left").select("query_id", "memory_count", F.coalesce(F.array_join("l.line", "\n\n"), F.lit("")).alias("answer"))


_LEVEL = """l{1} AS (SELECT query_id, id, max(score) AS score FROM (
 SELECT query_id, k.b AS id, greatest(score, strength) AS score FROM l{0} JOIN known k ON k.a = l{0}.id{2}) GROUP BY ALL)"""
_PEERS = """ UNION ALL
 SELECT query_id, o.node, 0.5 * score FROM l{0} JOIN kcomp c ON c.node = id JOIN kcomp o ON o.root = c.root AND o.node <> id"""


def _levels(peers: bool) -> str:
    return ", ".join(_LEVEL.format(i, i + 1, _PEERS.format(i) if peers and i + 1 < DEPTH else "") for i in range(DEPTH))


_RECALL = f"""{_found(SEEDS, False)}, known AS (SELECT a, b, round(strength, 9) AS strength FROM both_ways
 WHERE a IN (SELECT id FROM memories) AND b IN (SELECT id FROM memories)),
near_by(node, root) AS (SELECT DISTINCT a, a FROM known UNION SELECT k.b, r.root FROM near_by r JOIN known k ON k.a = r.node),
kcomp AS (SELECT node, min(root) AS root FROM near_by GROUP BY node), l0 AS (SELECT * FROM cut1)"""
_REACHED = " UNION ALL ".join(f"SELECT * FROM l{i + 1}" for i in range(DEPTH))
RECALL_EXPANDED = f"""WITH RECURSIVE {_RECALL}, {_levels(True)},
r AS (SELECT query_id, id, max(score) AS assoc FROM ({_REACHED}) GROUP BY ALL),
o AS (SELECT r.* FROM r LEFT JOIN cut1 USING (query_id, id) WHERE cut1.id IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY assoc DESC, id) <= 30),
x AS (SELECT query_id, id, score AS direct, coalesce(assoc, 0) AS assoc FROM cut1 LEFT JOIN r USING (query_id, id) UNION ALL SELECT query_id, id, 0, assoc FROM o),
k AS (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY greatest(direct, assoc) DESC, id) AS rank, labels[1] AS section FROM x JOIN memories USING (id)),
t AS (SELECT * FROM k WHERE rank <= 40), s AS (SELECT query_id, section, row_number() OVER (PARTITION BY query_id ORDER BY max(greatest(direct, assoc)) DESC, section) AS section_rank
 FROM t GROUP BY query_id, section)
SELECT query_id, rank, id, section, section_rank, round(direct, 6) AS direct, round(assoc, 6) AS assoc FROM t JOIN s USING (query_id, section)"""
ASK_ANSWERS = f"""WITH RECURSIVE {_RECALL}, {_levels(False)},
n AS (SELECT query_id, least(count(*), {ASKED_ROWS}) AS memory_count FROM (SELECT query_id, id FROM cut1 UNION SELECT query_id, id FROM ({_REACHED})) GROUP BY query_id),
a AS (SELECT query_id, string_agg('[#' || id || '] [' || array_to_string(labels[1:2], ',') || '] ' || substr(content, 1, {LINE}), chr(10) || chr(10) ORDER BY score DESC, id) AS answer
 FROM cut1 JOIN memories USING (id) WHERE score > 0.1 GROUP BY query_id)
SELECT query_id, memory_count, coalesce(answer, '') AS answer FROM n LEFT JOIN a USING (query_id)"""

NAMES = "search_intent recall_expanded ask_answers".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
