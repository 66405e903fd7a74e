"""Queries over documents, benchmark and embeddings that rank or compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import retrieval as R
from lodestar.sources.tables import AS_OF, MEMORIES, PLAIN_MEMORIES, memories, read, spread, vectors

QUERY = ["the", "ation", "un", "de", "the"]
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\-_./:]+')"
DISTANT = 0.35


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("terms"))


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that fit one query best."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    scored = R.bm25(docs, _one_query(spark), F.col("text")).select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(20)


_BM25 = f"""tok AS (SELECT doc_id AS id, {TOKENS} AS terms FROM documents),
st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1.0) AS avg_dl FROM tok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM tok)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2
                                / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
       FROM asked JOIN df USING (term) JOIN post USING (term) CROSS JOIN st GROUP BY ALL)"""
_ASKED = f"asked AS (SELECT 0 AS query_id, term, count(*) AS times FROM (SELECT unnest({QUERY}) AS term) GROUP BY ALL)"
SEARCH_BM25 = f"WITH {_ASKED}, {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 20"


def multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark text, all its words as a query: the five best documents."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("terms"))
    scored = R.bm25(docs, asked, F.col("text")).withColumn("score", F.round("score", 6))
    return R.top_per_key(scored, "query_id", 5, F.desc("score"), F.col("id"))


MULTI_QUERY_TOPK = f"""WITH q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
asked AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL), {_BM25},
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm)
SELECT * FROM r WHERE rank <= 5"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that share a term with the query, with the parts of their score."""
    rows = memories(spark, sf_dir, plain=True)
    bm = R.bm25(rows, _one_query(spark), F.col("content")).select("id", F.col("score").alias("bm"))
    words = F.lit(sorted(set(QUERY)))
    text, labels = F.lower("content"), F.lower(F.array_join("labels", " "))
    both = F.concat_ws(" ", text, labels)
    age = F.greatest((F.lit(AS_OF) - F.col("ts")) / 86400.0, F.lit(0.0))
    scored = rows.join(bm, "id").withColumns(
        {"keyword": T.share_contained(words, text), "label": T.share_contained(words, labels), "exact": T.share_contained(words, both) > 0.5}
    )
    return scored.withColumn("score", R.hybrid_score(F.col("keyword"), F.col("bm"), F.col("exact"), F.col("label"), F.lit(0.0), age))


_WORDS = sorted(set(QUERY))
_SHARE = lambda t: "(" + " + ".join(f"contains({t}, '{w}')::INTEGER" for w in _WORDS) + f") / {len(_WORDS)}.0"
_SCORED = f"""{PLAIN_MEMORIES}, {_ASKED}, {_BM25},
part AS (SELECT m.*, bm.score AS bm, {_SHARE("lower(content)")} AS keyword, {_SHARE("lower(array_to_string(labels, ' '))")} AS label,
         {_SHARE("lower(content) || ' ' || lower(array_to_string(labels, ' '))")} > 0.5 AS exact,
         greatest(({AS_OF} - ts) / 86400.0, 0.0) AS age FROM memories m JOIN bm USING (id)),
raw AS (SELECT *, (0.5 * keyword + bm / (bm + 1) * (CASE WHEN exact THEN 0.35 ELSE 0.20 END) + 0.15 * label) * exp(-0.08 * age)
        * greatest(importance, 0.1) * (1 + access_count / (access_count + 5) * 0.3) AS r FROM part),
scored AS (SELECT *, least(r * (CASE WHEN list_contains(labels, 'junk') OR strlen(trim(content)) < 10 THEN 0.3 ELSE 1.0 END)
           * (CASE WHEN r > 0.3 THEN 1 + 0.1 * greatest(mass - 1, 0) ELSE 1.0 END), 1.0) AS score FROM raw)"""


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 memories with the highest hybrid score."""
    return _scored(spark, sf_dir).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


SEARCH_HYBRID = f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 20"


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search among curated or French memories of some importance since a day."""
    keep = R.passes(labels=["curated", "fr"], least=0.5, most=2.5, since=1704200000)
    return _scored(spark, sf_dir).where(keep).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


SEARCH_FILTERED = f"""WITH {_SCORED} SELECT id, round(score, 6) AS score FROM scored
WHERE (list_contains(labels, 'curated') OR list_contains(labels, 'fr')) AND importance BETWEEN 0.5 AND 2.5 AND ts >= 1704200000
ORDER BY score DESC, id LIMIT 20"""


def search_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search, then label, recency, access and importance adjustments of the rerank step."""
    age = F.greatest((F.lit(AS_OF) - F.col("ts")) / 86400.0, F.lit(0.0))
    boost = (
        F.when(F.array_contains("labels", "curated"), 0.08 * 1.5).otherwise(0.0)
        + F.exp(-0.1 * age) * 2.5 * 0.15
        + 0.03 * F.coalesce(F.greatest(F.log(F.nullif("access_count", F.lit(0))), F.lit(0.0)), F.lit(0.0))
        + F.when(F.col("importance") > 2, 0.05).otherwise(0.0)
        + F.when(F.col("importance") >= 2.5, 0.06).otherwise(0.0)
        + F.when(F.col("access_count") > 5, 0.04).otherwise(0.0)
    )
    return (
        _scored(spark, sf_dir).select("id", F.round(F.col("score") + boost, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
    )


SEARCH_RERANK = f"""WITH {_SCORED} SELECT id, round(score + (CASE WHEN list_contains(labels, 'curated') THEN 0.08 * 1.5 ELSE 0 END)
 + exp(-0.1 * age) * 2.5 * 0.15 + 0.03 * (CASE WHEN access_count > 0 THEN ln(access_count) ELSE 0 END)
 + (CASE WHEN importance > 2 THEN 0.05 ELSE 0 END) + (CASE WHEN importance >= 2.5 THEN 0.06 ELSE 0 END)
 + (CASE WHEN access_count > 5 THEN 0.04 ELSE 0 END), 6) AS score FROM scored ORDER BY score DESC, id LIMIT 20"""


def keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the query's words that each document contains, and the label boost of the same words."""
    words = F.lit(_WORDS)
    rows = memories(spark, sf_dir, plain=True)
    return rows.select(
        "id",
        F.round(T.share_contained(words, F.lower("content")), 6).alias("keyword"),
        F.round(T.share_contained(words, F.lower(F.array_join("labels", " "))), 6).alias("label"),
    )


KEYWORD_SHARE = f"""WITH {PLAIN_MEMORIES} SELECT id, round({_SHARE("lower(content)")}, 6) AS keyword,
round({_SHARE("lower(array_to_string(labels, ' '))")}, 6) AS label FROM memories"""


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents of every term, and of its occurrences."""
    terms = spread(read(spark, sf_dir, "documents")).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    per = terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


DOC_FREQUENCY = f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term"""


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to vector 0 by cosine, with their Euclidean similarity."""
    rows = vectors(spark, sf_dir)
    origin = F.broadcast(rows.where("id = 0").select(F.col("embedding").alias("q")))
    near = rows.where("id <> 0").join(origin, F.lit(True))
    return (
        near.select(
            "id",
            F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"),
            F.round(1 / (1 + V.distance(F.col("embedding"), F.col("q"))), 6).alias("closeness"),
        )
        .orderBy(F.desc("similarity"), "id")
        .limit(20)
    )


_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
KNN_EXACT = f"""WITH {_E} SELECT a.id, round(greatest(list_cosine_similarity(a.v, q.v), 0), 6) AS similarity,
round(1 / (1 + list_distance(a.v, q.v)), 6) AS closeness FROM e a, e q WHERE q.id = 0 AND a.id <> 0 ORDER BY similarity DESC, a.id LIMIT 20"""


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors with a cosine above the threshold."""
    return R.similar_pairs(vectors(spark, sf_dir), DISTANT).withColumn("similarity", F.round("similarity", 6))


PAIRS = f"""{_E}, pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS similarity
FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {DISTANT})"""
SIMILARITY_PAIRS = f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"


def vector_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of each vector, and norm and sum of its unit vector."""
    rows = vectors(spark, sf_dir).withColumn("u", V.unit(F.col("embedding")))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(F.col("u")), 6).alias("unit_norm"), F.round(total, 6).alias("unit_sum"))


VECTOR_UNIT = f"""WITH {_E}, n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS s FROM e)
SELECT id, round(s, 6) AS norm, 1.0::DOUBLE AS unit_norm, round(list_sum(v) / s, 6) AS unit_sum FROM n"""


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, one row a dimension."""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("members"))


LABEL_CENTROIDS = f"""WITH {_E}, x AS (SELECT label, unnest(range(len(v)))::INTEGER AS dim, unnest(v) AS x FROM e)
SELECT label, dim, round(avg(x), 6) AS mean, count(*) AS members FROM x GROUP BY label, dim"""


def list_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with any of some labels, newest first, a page of 20 after 10."""
    rows = memories(spark, sf_dir).where(F.arrays_overlap("labels", F.lit(["curated", "es", "src3"])))
    return rows.select("id", "ts", F.substring("content", 1, 50).alias("preview")).orderBy(F.desc("ts"), "id").offset(10).limit(20)


LIST_BY_LABELS = f"""WITH {MEMORIES} SELECT id, ts, substr(content, 1, 50) AS preview FROM memories
WHERE list_has_any(labels, ['curated', 'es', 'src3']) ORDER BY ts DESC, id LIMIT 20 OFFSET 10"""


def search_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the benchmark queries: hits, misses and totals by their best score."""
    best = multi_query_topk(spark, sf_dir).where("rank = 1").select("query_id", (F.col("score") / (F.col("score") + 1)).alias("s"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    all_ = asked.join(best, "query_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return all_.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("s") > 0.25).alias("hits"),
        F.count_if(F.col("s") < 0.15).alias("misses"),
        F.round(F.avg("s"), 6).alias("mean_score"),
    )


SEARCH_TELEMETRY = f"""WITH best AS (SELECT query_id, score / (score + 1) AS s FROM ({MULTI_QUERY_TOPK}) WHERE rank = 1),
a AS (SELECT coalesce(s, 0) AS s FROM benchmark LEFT JOIN best ON query_id = item_id)
SELECT count(*) AS total, count(*) FILTER (s > 0.25) AS hits, count(*) FILTER (s < 0.15) AS misses, round(avg(s), 6) AS mean_score FROM a"""

NAMES = (
    "search_bm25 multi_query_topk search_hybrid search_filtered search_rerank keyword_share doc_frequency knn_exact similarity_pairs "
    "vector_unit label_centroids list_by_labels search_telemetry"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
