"""The given tables as the engine's tables: memories, vectors, relations, event log, tenants.

`memories` puts a fixed phrase (by id) before each document's text, so that the keyword rules have something to find.
Each adapter has the same rule as a SQL common table expression, for the oracle queries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Evaluation time of every time rule: 2024-02-01 UTC, in epoch seconds.
AS_OF = 1706745600
START = 1704067200

PHRASES = [
    "[decision] we decided to use the columnar store because scans dominate",
    "[bug] root_cause: the pool was never closed; fix: close it in a finally block",
    "ok",
    "convention: always use typed schemas, never use inference in production",
    "turns out the index was stale, an important finding for search",
    "session summary: accomplished: new deploy pipeline with docker and nginx",
    "cve-2024-1 vulnerability in the parser, critical security alert",
    "survey of the arxiv papers on vector search",
    "hello world test tmp scratch",
    "identity: i am the keeper of the archive",
    "[decision] 决策 改用 redis 因为 性能 更好",
    "修复了 部署 错误, 数据库 连接 恢复",
    "deploy key rotated on the production database, do not use the old secret",
    "architecture design of the core module in rust with tokio",
    "experiment with the embedding model was a success and the results are great",
    "error: build is broken, a test fail in the python api",
]

NOT_NOISE = ("test", "testing", "junk", "scratch", "tmp", "temp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as the cluster runs at once, if they come in fewer (a small file is one task); else
    unchanged, so that large tables never move."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def memories(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """id, content, labels, ts, mass, access_count, importance, enforced. plain: the text alone, without a phrase."""
    docs, flags = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod("doc_id", F.lit(len(PHRASES))) + 1).cast("int"))
    extra = F.array_compact(
        F.array(F.when(F.col("toxic") == 1, F.lit("junk")), F.when(F.col("quality") == 1, F.lit("curated")))
    )
    return docs.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("text") if plain else F.concat_ws(" ", phrase, "text")).alias("content"),
        F.concat(F.array("lang", "source"), extra).alias("labels"),
        (F.lit(START) + F.col("doc_id") * 3600).alias("ts"),
        (1 + F.pmod("doc_id", F.lit(7)) * 0.25).alias("mass"),
        F.pmod("doc_id", F.lit(9)).cast("int").alias("access_count"),
        (0.2 + F.pmod("doc_id", F.lit(25)) * 0.1).alias("importance"),
        (F.pmod("doc_id", F.lit(50)) == 0).alias("enforced"),
    )


_VALUES = ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES))
MEMORIES = f"""phrases(p, phrase) AS (VALUES {_VALUES}),
memories AS (
  SELECT d.doc_id AS id, phrase || ' ' || d.text AS content,
         list_concat([d.lang, d.source], list_concat(CASE WHEN toxic = 1 THEN ['junk'] ELSE [] END,
                     CASE WHEN quality = 1 THEN ['curated'] ELSE [] END)) AS labels,
         {START} + d.doc_id * 3600 AS ts, 1 + (d.doc_id % 7) * 0.25::DOUBLE AS mass,
         (d.doc_id % 9)::INTEGER AS access_count, 0.2::DOUBLE + (d.doc_id % 25) * 0.1::DOUBLE AS importance,
         d.doc_id % 50 = 0 AS enforced
  FROM documents d JOIN phrases ON p = d.doc_id % {len(PHRASES)} LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

PLAIN_MEMORIES = MEMORIES.replace("phrase || ' ' || d.text", "d.text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding (array of double), label."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


#: Dimensions of the vectors that are made of words.
DIMENSIONS = 64


def word_place(word: str) -> int:
    """Where a word adds to a vector; behind DIMENSIONS where it subtracts."""
    d = hashlib.md5(word.encode()).digest()
    return d[0] % DIMENSIONS + (0 if d[1] < 128 else DIMENSIONS)


@F.arrow_udf(ArrayType(DoubleType()))
def _word_sums(words: pa.Array) -> pa.Array:
    """The vector of each list of words. A word is digested once a batch, and no row leaves its place."""
    rows = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    there = coded.is_valid().to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)[there].astype("i8")
    digests = [hashlib.md5(word.encode()).digest() for word in coded.dictionary.to_pylist()]
    place = np.array([d[0] % DIMENSIONS for d in digests], "i8")
    sign = np.array([1.0 if d[1] < 128 else -1.0 for d in digests])
    known = max(len(digests), 1)
    rows, codes = np.divmod(np.unique(rows[there] * known + codes), known)
    sums = np.bincount(rows * DIMENSIONS + place[codes], sign[codes], len(words) * DIMENSIONS)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * DIMENSIONS, pa.int32()), pa.array(sums, pa.float64()))


def text_vectors(rows: DataFrame, words: Column) -> DataFrame:
    """rows with embedding: each distinct word adds 1 or -1 to one of DIMENSIONS places, both by its MD5."""
    return rows.where("id is not null").withColumn("embedding", _word_sums(words))


_PLACE = f"('0x' || substr(md5(word), 1, 2))::INTEGER % {DIMENSIONS}"
_SIGN = "CASE WHEN substr(md5(word), 3, 1) < '8' THEN 1.0::DOUBLE ELSE -1 END"
#: For a relation w(id, words) the vectors tv(id, v).
TEXT_VECTORS = f"""tw AS (SELECT id, {_PLACE} AS place, {_SIGN} AS sign FROM (SELECT id, unnest(list_distinct(words)) AS word FROM w)),
tv AS (SELECT w.id, [{", ".join(f"coalesce(sum(sign) FILTER (place = {d}), 0)" for d in range(DIMENSIONS))}] AS v FROM w LEFT JOIN tw USING (id) GROUP BY w.id)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, epoch, user_id, event_type, value, props, k."""
    return read(spark, sf_dir, "events").withColumns(
        {"epoch": F.unix_timestamp("ts"), "k": F.get_json_object("props", "$.k").cast("int")}
    )


EVENT_LOG = """event_log AS (
  SELECT *, floor(epoch(ts))::BIGINT AS epoch, (props->>'$.k')::INTEGER AS k FROM events)"""
