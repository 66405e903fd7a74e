"""Queries that cut texts and keep versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.chunks import chunks
from lodestar.sources.files import upsert
from lodestar.sources.tables import MEMORIES, memories, read


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 1000 bytes of every document: number, bytes and hash of each."""
    rows = chunks(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "at", F.octet_length("chunk").alias("bytes"), F.sha2("chunk", 256).alias("sha"))


def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories after new importances for the curated ones came in, by label set: number and mean importance."""
    old = memories(spark, sf_dir).select("id", F.array_join("labels", ",").alias("labels"), "importance")
    new = old.where(F.contains("labels", F.lit("curated"))).withColumn("importance", F.col("importance") + 1)
    return upsert(old, new).groupBy("labels").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


MEMORY_UPSERT = f"""WITH {MEMORIES}, m AS (SELECT array_to_string(labels, ',') AS labels, importance + list_contains(labels, 'curated')::INTEGER AS i FROM memories)
SELECT labels, count(*) AS n, round(avg(i), 6) AS importance FROM m GROUP BY labels"""

QUERIES = {"document_chunks": document_chunks, "memory_upsert": memory_upsert}
SQL = {"memory_upsert": MEMORY_UPSERT}
