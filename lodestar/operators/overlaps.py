"""Pairs of word sets that overlap, by products of incidence blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_overlaps(rows: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(group, a, b, overlap): the pairs of one row with side true and one with side false of the same group whose word
    sets have a Jaccard similarity of least or more, a < b. rows: group, id, words (distinct), side.

    A low threshold leaves no prefix to filter by, so sets meet in blocks: each pair of blocks of a group is one task's
    product of two incidence matrices, over the words of the smaller block. A group of any size is many tasks of
    2 * block rows. Empty and null sets overlap with none."""
    usable = rows.where("id is not null and size(words) > 0").select("group", "id", "words", "side")
    sizes = usable.groupBy("group", "side").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    per = sizes.groupBy("group").agg(
        F.max(F.when(F.col("side"), blocks)).alias("rows_of"), F.max(F.when(~F.col("side"), blocks)).alias("columns_of")
    )
    placed = usable.join(per.where("rows_of is not null and columns_of is not null"), "group")
    own = F.when(F.col("side"), F.col("rows_of")).otherwise(F.col("columns_of"))
    other = F.when(F.col("side"), F.col("columns_of")).otherwise(F.col("rows_of"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    dealt = placed.select(
        "group", "id", "words", "side",
        F.when(F.col("side"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("side"), F.col("other")).otherwise(F.col("own")).alias("j"),
    )

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"]], pdf[~pdf["side"]]
        small = left if len(left) <= len(right) else right
        code = {w: k for k, w in enumerate({w for words in small["words"] for w in words})}

        def incidence(part: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(part), len(code)), np.float32)
            for row, words in enumerate(part["words"]):
                out[row, [code[w] for w in words if w in code]] = 1
            return out

        if not len(left) or not len(right):
            return pd.DataFrame({"group": pdf["group"].iloc[:0], "a": pdf["id"].iloc[:0], "b": pdf["id"].iloc[:0], "overlap": np.zeros(0)})
        both = (incidence(left) @ incidence(right).T).astype(np.float64)
        size = [part["words"].map(len).to_numpy() for part in (left, right)]
        overlap = both / (size[0][:, None] + size[1][None, :] - both)
        row, column = np.nonzero(overlap >= least)
        a, b = left["id"].to_numpy()[row], right["id"].to_numpy()[column]
        return pd.DataFrame({"group": pdf["group"].iloc[0], "a": np.minimum(a, b), "b": np.maximum(a, b), "overlap": overlap[row, column]})

    return dealt.groupBy("group", "i", "j").applyInPandas(multiply, f"group {rows.schema['group'].dataType.simpleString()}, a long, b long, overlap double")
