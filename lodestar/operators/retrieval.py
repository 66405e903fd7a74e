"""Ranked retrieval: BM25, hybrid scores, the first rows of each key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.blocks import similar_pairs  # noqa: F401
from lodestar.session import materialize
from lodestar.sources.tables import spread

K1, B = 1.2, 0.75
#: Distinct query terms up to which they are looked for as a fixed set in every row.
MOST_TERMS = 20_000


def top_per_key(df: DataFrame, key: str, k: int, *order: Column, salts: int = 32) -> DataFrame:
    """The first k rows of each key. Each of a key's slices is cut to k first, so a key with very many rows is
    sorted by many tasks and at most salts * k of its rows meet."""
    slices = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    cut = slices.withColumn("_rank", part).where(F.col("_rank") <= k).drop("_rank", "_salt")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, body: Column, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of documents that share a term with a query.

    queries: query_id, terms (with repeats, which count each time). Only postings of query terms are shuffled; their
    document frequencies and the mean length come from all documents. pairs: the (query_id, id) to score, if not all."""
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = materialize(asked, "asked")
    wanted = asked.select("term").distinct()
    tokens = spread(docs).select("id", T.tokenize(body).alias("terms")).withColumn("dl", F.size("terms"))
    terms = [r.term for r in wanted.limit(MOST_TERMS + 1).collect()]
    if len(terms) <= MOST_TERMS:  # few: kept within the row, the only pass over the texts
        found = tokens.select("id", "dl", F.filter("terms", lambda w: w.isin(terms)).alias("terms"))
        found = materialize(found, "found-terms")
        hits = found.select("id", "dl", F.explode("terms").alias("term"))
    else:
        found = materialize(tokens, "found-terms")
        hits = found.select("id", "dl", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    stats = found.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))
    postings = materialize(hits.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("weight", F.col("times") * idf)
    weighed = weighed.select("query_id", "term", "weight", "avg_dl")
    met = postings.join(weighed, "term") if pairs is None else postings.join(pairs, "id").join(weighed, ["query_id", "term"])
    return (
        met.groupBy("query_id", "id")
        .agg(F.sum(F.col("weight") * part).alias("score"))
    )


def row_factors(age_days: Column) -> dict[str, Column]:
    """What a row itself gives to its score: recency, importance, access, two malus and mass."""
    return {
        "recency": F.exp(-0.08 * age_days),
        "weight": F.greatest("importance", F.lit(0.1)),
        "access": 1 + F.col("access_count") / (F.col("access_count") + 5) * 0.3,
        "meta": F.when(F.exists("labels", lambda x: x.startswith("meta-")), 0.5).otherwise(1.0),
        "noise": F.when(noise_label(F.col("labels")) | (F.octet_length(F.trim("content")) < 10), 0.3).otherwise(1.0),
        "heavy": 1 + 0.1 * F.greatest(F.col("mass") - 1, F.lit(0.0)),
    }


def hybrid_score(vec: Column, bm: Column, exact: Column, label: Column, entity: Column, age_days: Column) -> Column:
    """The row score of a memory: vector and text similarity, boosts, recency, importance, access and mass."""
    own = row_factors(age_days)
    text = bm / (bm + 1) * F.when(exact, 0.35).otherwise(0.20)
    raw = (0.5 * vec + text + 0.15 * label + 0.20 * entity) * own["recency"] * own["weight"] * own["access"]
    mass = F.when(raw > 0.3, own["heavy"]).otherwise(1.0)
    return F.least(raw * own["meta"] * own["noise"] * mass, F.lit(1.0))


def hybrid_scores(vec: np.ndarray, bm: np.ndarray, exact: np.ndarray, label: np.ndarray, entity: np.ndarray, own: dict[str, np.ndarray]) -> np.ndarray:
    """hybrid_score for arrays (row, query); own: the rows' row_factors, nan where they are null."""
    own = {name: x[:, None] for name, x in own.items()}
    raw = (0.5 * vec + bm / (bm + 1) * np.where(exact, 0.35, 0.20) + 0.15 * label + 0.20 * entity) * own["recency"] * own["weight"] * own["access"]
    return np.fmin(raw * own["meta"] * own["noise"] * np.where(raw > 0.3, own["heavy"], 1.0), 1.0)


def noise_label(labels: Column) -> Column:
    # Labels of noise.
    words = F.array(*map(F.lit, ("test", "testing", "junk", "scratch", "tmp", "temp")))
    return F.arrays_overlap(F.transform(labels, lambda x: F.lower(x)), words)


def passes(
    labels: list[str] | None = None,
    least: float | None = None,
    most: float | None = None,
    since: int | None = None,
    until: int | None = None,
    project: str | None = None,
) -> Column:
    """Filter of a search: any of the labels, importance and time ranges (inclusive), project."""
    out = F.lit(True)
    if labels:
        out &= F.arrays_overlap("labels", F.array(*map(F.lit, labels)))
    if least is not None:
        out &= F.col("importance") >= least
    if most is not None:
        out &= F.col("importance") <= most
    if since is not None:
        out &= F.col("ts") >= since
    if until is not None:
        out &= F.col("ts") <= until
    if project is not None:
        out &= F.exists("labels", lambda x: (x == project) | x.startswith("project:" + project))
    return out
