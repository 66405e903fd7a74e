"""Groups that are split in two around their least similar members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.session import materialize

BLOCK = 512


def farthest_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group, a, b): of every group of two rows or more the pair with the least Jaccard similarity of labels, of equal ones
    that of the lowest ids (a, then b; a < b). rows: group, id, labels.

    Rows with the same labels are one set, of which only the two lowest ids can be in the pair. Sets meet in blocks, and a
    pair of blocks returns one pair, so a group of any number of sets is many tasks of small results. Two empty sets have
    similarity 1."""
    held = rows.select("group", "id", F.array_sort(F.array_distinct("labels")).alias("labels"))
    sets = held.groupBy("group", "labels").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    second = held.join(sets.select("group", "labels", F.col("id").alias("least")), ["group", "labels"]).where("id > least")
    second = second.groupBy("group", "labels").agg(F.min("id").alias("second"))
    sets = materialize(sets.join(second, ["group", "labels"], "left").select("group", "labels", "id", "second"), "label-sets")
    blocks = sets.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = sets.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", "labels", "id", "second", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        code = {x: k for k, x in enumerate({x for labels in pdf["labels"] for x in labels})}
        bits = np.zeros((len(pdf), max(len(code), 1)), np.float32)
        for row, labels in enumerate(pdf["labels"]):
            bits[row, [code[x] for x in labels]] = 1
        ids, size = pdf["id"].to_numpy(), bits.sum(1)
        both = (bits @ bits.T).astype(np.float64)
        union = size[:, None] + size[None, :] - both
        alike = np.divide(both, union, out=np.ones_like(both), where=union > 0)
        a, b = np.minimum(ids[:, None], ids[None, :]), np.maximum(ids[:, None], ids[None, :])
        own = ~np.isnan(pdf["second"].to_numpy(dtype=float))
        at = np.flatnonzero(own)
        b[at, at] = pdf["second"].to_numpy()[at]
        alike[np.diag_indices(len(ids))] = np.where(own, 1.0, np.inf)
        flat = np.lexsort((b.ravel(), a.ravel(), alike.ravel()))[0]
        found = alike.ravel()[flat]
        if np.isinf(found):
            return pd.DataFrame({"group": pdf["group"].iloc[:0], "a": ids[:0], "b": ids[:0], "alike": np.zeros(0)})
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "a": [a.ravel()[flat]], "b": [b.ravel()[flat]], "alike": [found]})

    kind = rows.schema["group"].dataType.simpleString()
    found = dealt.groupBy("group", "i", "j").applyInPandas(best, f"group {kind}, a long, b long, alike double")
    least = found.groupBy("group").agg(F.min(F.struct("alike", "a", "b")).alias("l"))
    return least.select("group", "l.a", "l.b")


def two_seed_split(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group, id, side): the members of every group by the seed, of its farthest pair, whose labels are more like theirs;
    a where both are; a group of one row is all a."""
    pairs = farthest_pairs(rows, block)
    labels = rows.select("group", "id", "labels")
    for seed in ("a", "b"):
        pairs = pairs.join(labels.select("group", F.col("id").alias(seed), F.col("labels").alias(f"of_{seed}")), ["group", seed], "left")
    met = labels.join(pairs, "group", "left")
    like = lambda seed: T.jaccard(F.array_distinct("labels"), F.array_distinct(f"of_{seed}"), 1.0)
    nearer = F.col("a").isNull() | (F.col("id") == F.col("a")) | ((F.col("id") != F.col("b")) & (like("a") >= like("b")))
    return met.select("group", "id", F.when(nearer, "a").otherwise("b").alias("side"))
