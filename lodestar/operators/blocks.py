"""Pairs of rows by products of blocks: rows are dealt so that any two of them meet in one task.

A side has GRID blocks at most, so a row is sent GRID times however long the table is; blocks grow with it up to MOST
rows, and only behind that are there more. A task holds two blocks and multiplies them PIECE by PIECE, so what it
returns goes out in pieces as well, and a dense group of rows never lies in memory as pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, MOST, PIECE = 16, 65_536, 1024
#: Rows that wait for the next cut of neighbours.
WAITING = 200_000


def sides(n: int, block: int) -> int:
    """Blocks on a side for n rows, of `block` rows while these are GRID or fewer."""
    return max(1, min(-(-n // block), GRID), -(-n // MOST))


def usable(rows: DataFrame, *carry: str) -> DataFrame:
    return rows.where("id is not null and size(embedding) > 0").select("id", "embedding", *carry)


def meet(rows: DataFrame, block: int, *carry: str) -> DataFrame:
    """rows with own, i and j, dealt to tasks by pairs of blocks (i <= j) and sorted by these."""
    placed = usable(rows, *carry)
    blocks = sides(placed.count(), block)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    return dealt.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "id")


def runs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair after pair of blocks from frames that come sorted by these."""
    held, key = [], None
    for frame in frames:
        for own, part in frame.groupby(["i", "j"], sort=False):
            if held and own != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            key = own
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def units(pdf: pd.DataFrame) -> np.ndarray:
    """Unit vectors; a zero vector stays."""
    x = np.stack(pdf["embedding"])
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 1e-10, size, 1)[:, None]


def close(pdf: pd.DataFrame, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of the pairs above least of a pair of blocks, each pair of rows once, piece by piece."""
    x, ids, own = units(pdf), pdf["id"].to_numpy(), pdf["own"].to_numpy()
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for p in range(0, len(left), PIECE):
        for q in range(p if i == j else 0, len(right), PIECE):
            one, other = left[p : p + PIECE], right[q : q + PIECE]
            cosine = x[one] @ x[other].T
            a, b = np.nonzero(cosine > least)
            kept = ids[one[a]] < ids[other[b]] if i == j and p == q else ids[one[a]] != ids[other[b]]
            a, b = a[kept], b[kept]
            yield one[a], other[b], np.minimum(cosine[a, b], 1.0)


def similar_pairs(rows: DataFrame, least: float, block: int = PIECE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, similarity) with a < b of all pairs with a cosine above least, exactly; of each column in carry the values
    of both rows, with _a and _b behind the name. Rows without a vector or with a zero one have no pairs."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames):
            ids = pdf["id"].to_numpy()
            for a, b, cosine in close(pdf, least):
                swap = ids[a] > ids[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                held = {"a": ids[a], "b": ids[b], "similarity": cosine}
                yield pd.DataFrame(held | {f"{c}_{end}": pdf[c].to_numpy()[at] for c in carry for end, at in (("a", a), ("b", b))})

    kinds = "".join(f", {c}_{end} {rows.schema[c].dataType.simpleString()}" for c in carry for end in "ab")
    return meet(rows, block, *carry).mapInPandas(work, f"a long, b long, similarity double{kinds}")


def links(rows: DataFrame, least: float, block: int = PIECE) -> DataFrame:
    """(a, b): fewer pairs than similar_pairs that hold the same rows together. A task returns each row that it links to
    lower ones with the lowest of those it reaches, so at most two blocks of pairs however dense the rows are."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames):
            pdf = pdf.sort_values("id", ignore_index=True)
            ids, low = pdf["id"].to_numpy(), np.arange(len(pdf))
            for a, b, _ in close(pdf, least):
                while True:
                    apart = low[a] != low[b]
                    a, b = a[apart], b[apart]
                    if not len(a):
                        break
                    np.minimum.at(low, np.maximum(low[a], low[b]), np.minimum(low[a], low[b]))
                    while (low[low] != low).any():
                        low = low[low]
            tied = np.flatnonzero(low != np.arange(len(low)))
            yield pd.DataFrame({"a": ids[low[tied]], "b": ids[tied]})

    return meet(rows, block).mapInPandas(work, "a long, b long")


def first_ones(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[np.ndarray]:
    """Of (a, b, similarity) the k with the highest similarity of each a, of equal ones those of the lowest b."""
    a, b, s = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return [x[place < k] for x in (a, b, s)]


def neighbours(rows: DataFrame, k: int, least: float, decimals: int | None = None, block: int = PIECE) -> DataFrame:
    """(a, b, similarity): of every row a the k most similar rows with a cosine above least, by similarity (rounded, if
    decimals is given) and then the lower id; at most k rows of a leave a task. One window makes the final cut."""
    from lodestar.operators.retrieval import top_per_key

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames):
            ids, held, size, kept = pdf["id"].to_numpy(), [], 0, 0
            for a, b, cosine in close(pdf, least):
                cosine = cosine if decimals is None else np.round(cosine, decimals)
                if len(a):
                    held.append(first_ones([(np.r_[ids[a], ids[b]], np.r_[ids[b], ids[a]], np.r_[cosine, cosine])], k))
                    size += len(held[-1][0])
                if size > 2 * kept + WAITING:
                    held = [first_ones(held, k)]
                    size = kept = len(held[0][0])
            if held:
                yield pd.DataFrame(dict(zip(("a", "b", "similarity"), first_ones(held, k), strict=True)))

    found = meet(rows, block).mapInPandas(work, "a long, b long, similarity double")
    return top_per_key(found, "a", k, F.desc("similarity"), F.col("b")).drop("rank")


def touched(front: DataFrame, rows: DataFrame, least: float, block: int = PIECE) -> DataFrame:
    """(id): the rows that have a cosine above least with a row of front, other than themselves. No pair leaves a task."""
    one, other = (usable(side) for side in (front, rows))
    many = [sides(side.count(), block) for side in (one, other)]
    deal = lambda side, name, own, across, n: side.withColumns(
        {name: F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), across: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))}
    )
    asks = deal(one, "i", many[0], "j", many[1]).withColumn("own", F.lit(0))
    gives = deal(other, "j", many[1], "i", many[0]).withColumn("own", F.lit(1))
    dealt = asks.unionByName(gives).repartition(many[0] * many[1], "i", "j").sortWithinPartitions("i", "j", "own", "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(frames):
            x, ids, own = units(pdf), pdf["id"].to_numpy(), pdf["own"].to_numpy()
            from_, to = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
            for q in range(0, len(to), PIECE):
                open_ = to[q : q + PIECE]
                for p in range(0, len(from_), PIECE):
                    at = from_[p : p + PIECE]
                    hit = ((x[at] @ x[open_].T > least) & (ids[at][:, None] != ids[open_][None, :])).any(0)
                    if hit.any():
                        yield pd.DataFrame({"id": ids[open_[hit]]})
                        open_ = open_[~hit]

    return dealt.mapInPandas(work, "id long").distinct()
