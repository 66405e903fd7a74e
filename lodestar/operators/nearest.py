"""The nearest vectors of a few rows among many, exactly, by products of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.blocks import PIECE, first_ones
from lodestar.operators.blocks import sides as sides_of
from lodestar.operators.retrieval import top_per_key

#: Decimals of a similarity: products of the same two vectors may differ behind them from block to block.
DECIMALS = 9
#: Pairs whose exact similarity is worked out at a time.
PAIRS = 1 << 16


def nearest(left: DataFrame, right: DataFrame, k: int, least: float, earlier: bool = False, apart: bool = False, block: int = 1024) -> DataFrame:
    """(a, b, similarity): for every row of left the k rows of right with the highest cosine above least, by similarity
    and then the lower id; never the row itself, unless the sides are tables of different
    things (apart); with earlier only rows of a lower id.

    Both sides have id and embedding. Each pair of blocks is one task's matrix product, piece by piece, and returns k rows
    at most for a row of left, so neither a task nor the result grows with a dense group; there are blocks.GRID blocks on
    a side at most, so that no row is sent more often. Products in single precision rule out pairs that can't be above the
    least or a row's k-th so far; the others are worked out exactly. Rows without a vector have no neighbours."""
    usable = "id is not null and size(embedding) > 0"
    sides = []
    counts = [sides_of(side.where(usable).count(), block) for side in (left, right)]
    for side, own, other in ((left, *counts), (right, *counts[::-1])):
        placed = side.where(usable).select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(own)).alias("own"))
        sides.append(placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))))
    dealt = sides[0].select("id", "embedding", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"))
    dealt = dealt.unionByName(
        sides[1].select("id", "embedding", F.col("other").cast("bigint").alias("i"), F.col("own").cast("int").alias("j"), F.lit(False).alias("asks"))
    )

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["embedding"])
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 1e-10, size, 1)[:, None]
        ids, asks = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        a, b, xa, xb = ids[asks], ids[~asks], x[asks], x[~asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": a[:0], "b": b[:0], "similarity": np.zeros(0)})
        held, rough = [], x.astype("f4")
        ra, rb = rough[asks], rough[~asks]
        slack = (x.shape[1] + 4) * 2.0**-22 + 10.0**-DECIMALS  # more than single precision and rounding can be off by
        for p in range(0, len(a), PIECE):
            one, best = a[p : p + PIECE], None
            bar = np.full(len(one), max(least, -3.0))  # what a row's k-th has so far; an equal one of a lower id counts
            for q in range(0, len(b), PIECE):
                other = b[q : q + PIECE]
                if earlier and other[0] >= one[-1]:
                    break
                close = ra[p : p + PIECE] @ rb[q : q + PIECE].T
                over = close > (bar - slack)[:, None].astype("f4")
                if k < len(other) and np.count_nonzero(over) > 2 * k * len(one):  # below the k-th of its row none counts
                    if not apart:
                        close[(other[None, :] >= one[:, None]) if earlier else (other[None, :] == one[:, None])] = -2.0
                    over &= close >= -np.partition(-close, k - 1, axis=1)[:, k - 1, None] - np.float32(2 * slack)
                row, place = np.nonzero(over)
                exact = np.concatenate([np.einsum("ij,ij->i", xa[p + row[t : t + PAIRS]], xb[q + place[t : t + PAIRS]]) for t in range(0, len(row) or 1, PAIRS)])
                exact = np.minimum(np.round(exact, DECIMALS), 1.0)
                counts = exact > max(least, -3.0)
                if not apart:
                    counts &= (other[place] < one[row]) if earlier else (other[place] != one[row])
                found = (one[row[counts]], other[place[counts]], exact[counts])
                if len(found[0]):
                    best = first_ones([found] if best is None else [best, found], k)
                    full = best[0][k - 1 :] == best[0][: max(len(best[0]) - k + 1, 0)]  # rows that have k by now, at their k-th
                    bar[np.searchsorted(one, best[0][k - 1 :][full])] = best[2][k - 1 :][full]
            if best is not None:
                held.append(best)
        if not held:
            return pd.DataFrame({"a": a[:0], "b": b[:0], "similarity": np.zeros(0)})
        return pd.DataFrame({name: np.concatenate(v) for name, v in zip(("a", "b", "similarity"), zip(*held), strict=True)})

    found = dealt.groupBy("i", "j").applyInPandas(multiply, "a long, b long, similarity double")
    return top_per_key(found, "a", k, F.desc("similarity"), F.col("b")).drop("rank")
