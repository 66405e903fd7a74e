"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is looked up under 2**(radius+1) - 1 bit masks. Bit i has a vector a(i) of radius+1 bits, and
mask v keeps the bits with <a(i), v> odd. Whatever at most `radius` bits two fingerprints differ in, some v that
isn't zero is orthogonal to all their vectors, so the mask keeps none of them: no pair within the radius is missed. Buckets hold
distinct fingerprints only (copies are collapsed first); one bucket's links leave it as a spanning forest, never as
all pairs, and a bucket beyond BUCKET_ROWS is compared block against block in separate tasks.

`near_groups` goes on from fingerprints to texts: every row is compared with the first row of its fingerprint, of the
least fingerprint near by and of the tokens it meets, then, in large groups that still aren't joined, with a few drawn
rows, by the exact Jaccard similarity of word shingles. That is linear in the rows and joins nearly all there is to
join. A prefix filter then adds every candidate that is left: all texts
order their shingles alike, rare ones first, and of n shingles the first n - ceil(share * n) + 1 are posted. Two texts
whose similarity is at least share have a posted shingle in common, whatever the order; that the order comes from a
sample matters for speed only. Pairs within a group that is joined already aren't looked at again. Of all these pairs only those are compared whose parity sketches, of a bit or two
a shingle, don't rule the similarity out.

Cases: a null text is empty; a text without words has the fingerprint zero and links like any other; null ids
get a component only through others' ids, and come last where the smallest id stays; repeated rows share a
fingerprint, and for `drop_near_copies` rows of one id and text are one document, which stays or goes as a whole
(exact dedup comes before); rows of one id with different texts are judged apart;
very long texts are read whole, their shingles hashed one text at a time; of equally small ids the row read first
stays; extra columns are ignored by `simhash_components` and kept by `drop_near_copies`, whatever their names; empty
tables give empty results.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestar.llm.common import fresh, give_back, split_by_ids, table, text_of
from lodestar.operators.components import connected_components
from lodestar.session import discard, free_shuffles, materialize

#: Fingerprints of one bucket, or rows of one token, that a task compares at a time.
BUCKET_ROWS = 1024
#: Pairs that a task gathers before it passes them on.
PAIRS_AT_ONCE = 200_000
#: Where the pairs that the first meetings leave take more than WORK comparisons a posting, rows are first compared with
#: HEADS drawn rows, in at most HEAD_ROUNDS rounds. It changes the order of the work, not the result.
WORK = 8
HEADS = 8
HEAD_ROUNDS = 2
#: Share of the documents that the order of shingles is learned from, and how many shingles at most count as common.
ORDER_SHARE = 0.15
ORDER_SHINGLES = 1_000_000
#: Bits of the small sketch that every row takes along where candidates are sought.
FOLD_BITS = 256
#: Bits of the largest sketch; beyond, the filter by sketches lets more pairs through to the exact check.
SKETCH_BITS = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included; fewer words than size: all of them as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    size = min(size, len(words))
    last = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], "<u8")


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if set in over half of the hashes (by weight)."""
    total = len(hashes) if weights is None else int(weights.sum())
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype="i8") if weights is None else (weights[at : at + (1 << 16)] @ bits.astype("i4"))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash3(texts: pd.Series) -> pd.Series:
    """Fingerprint over 3-word shingles."""
    return pd.Series([majority(shingle_hashes(t, 3)) for t in texts], dtype="int64")


@F.pandas_udf(LongType())
def simhash_words(texts: pd.Series) -> pd.Series:
    """Fingerprint over words, each weighing twice the square root of its count, rounded: common words weigh little
    and an edited word moves few bits."""

    def one(text: str | None) -> int:
        hashes, counts = np.unique(shingle_hashes(text, 1), return_counts=True)
        return majority(hashes, np.rint(2 * np.sqrt(counts)).astype("i8"))

    return pd.Series([one(t) for t in texts], dtype="int64")


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(texts: pd.Series) -> pd.Series:
    """Distinct 5-word shingles of each text, as signed hashes."""
    found = pd.Series([np.unique(shingle_hashes(t, 5)).view("<i8") for t in texts])
    give_back()
    return found


@cache
def covering_masks(radius: int) -> tuple[int, ...]:
    """The masks as signed numbers. Of 64 assignments of vectors the one whose smallest mask keeps most bits."""
    tables = (1 << radius + 1) - 1

    def masks(seed: int) -> list[int]:
        vectors = [i % tables + 1 for i in range(64)] if tables <= 64 else random.Random(seed).sample(range(1, tables + 1), 64)
        return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, tables + 1)]

    best = max((masks(seed) for seed in range(64)), key=lambda found: min(m.bit_count() for m in found))
    return tuple(m - (1 << 64) if m >> 63 else m for m in best)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a symmetric boolean matrix: (root, member) by breadth-first search."""
    seen, links = np.zeros(len(near), bool), []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & ~seen)
            seen[front] = True
            links += [(root, int(x)) for x in front]
    return links


def _bucket_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket, each from the least fingerprint of its tree: the buckets of one large group under different
    masks then give mostly the same links."""
    prints = np.sort(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    links = np.array(forest(near), "i8").reshape(-1, 2)
    return prints[links[:, 0]], prints[links[:, 1]]


def _bucket_rows(key: tuple[int, int], prints: np.ndarray, radius: int, passed: int) -> pd.DataFrame:
    """Links of a bucket; or, of a large one, its rows with the number of their block (passed: rows gone before)."""
    if passed or len(prints) > BUCKET_ROWS:
        a = b = prints
        block = (passed + np.arange(len(prints))) // BUCKET_ROWS
    else:
        a, b = _bucket_links(prints, radius)
        block = np.full(len(a), -1)
    return pd.DataFrame({"a": a, "b": b, "mask": key[0], "bucket": key[1], "block": block})


def _scan_buckets(radius: int):
    """Over rows sorted by bucket: links of buckets up to BUCKET_ROWS; rows of larger ones with their block. At most
    one batch and BUCKET_ROWS rows are held."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, passed = None, np.empty(0, "i8"), 0  # the bucket that is still open
        for pdf in batches:
            if pdf.empty:
                continue
            mask, bucket, prints = (pdf[c].to_numpy() for c in ("mask", "bucket", "fp"))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(mask)]))
            if key != (mask[0], bucket[0]):
                if len(held):
                    yield _bucket_rows(key, held, radius, passed)
                key, held, passed = (mask[0], bucket[0]), np.empty(0, "i8"), 0
            held = np.concatenate((held, prints[: ends[0]]))
            if len(starts) > 1:
                yield _bucket_rows(key, held, radius, passed)
                s, e = starts[1:-1], ends[1:-1]
                two = s[e - s == 2]
                two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
                yield pd.DataFrame({"a": prints[two], "b": prints[two + 1], "mask": mask[two], "bucket": bucket[two], "block": -1})
                for x, y in zip(s[e - s > 2].tolist(), e[e - s > 2].tolist()):
                    yield _bucket_rows((mask[x], bucket[x]), prints[x:y], radius, 0)
                key, held, passed = (mask[-1], bucket[-1]), prints[starts[-1] :], 0
            if passed + len(held) > BUCKET_ROWS:
                yield _bucket_rows(key, held, radius, passed)
                held, passed = held[:0], passed + len(held)
        if len(held):
            yield _bucket_rows(key, held, radius, passed)

    return scan


_LINKS = "a long, b long, mask int, bucket long, block long"


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within the radius, directly or in steps."""
    masks = F.array(*map(F.lit, covering_masks(radius)))
    keyed = prints.select("fp", F.posexplode(masks).alias("mask", "kept")).select(
        "mask", F.col("kept").bitwiseAND(F.col("fp")).alias("bucket"), "fp"
    )
    found = materialize(
        keyed.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp").mapInPandas(_scan_buckets(radius), _LINKS),
        "simhash-links",
    )
    links = found.where("block < 0").select("a", "b").distinct()
    large = found.where("block >= 0").select("mask", "bucket", F.col("a").alias("fp"), "block")
    if large.isEmpty():
        return links
    last = large.groupBy("mask", "bucket").agg(F.max("block").alias("last"))
    pairs = large.join(last, ["mask", "bucket"]).select(
        "mask", "bucket", "fp", "block", F.explode(F.sequence(F.lit(0), "last")).alias("other")
    )
    pairs = pairs.select("mask", "bucket", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _bucket_links(pdf["fp"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    more = pairs.groupBy("mask", "bucket", "i", "j").applyInPandas(compare, "a long, b long")
    return links.unionByName(more).distinct()


def simhash_components(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), simhash3(text_of(text_col)).alias("fp")), "simhash")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    group = connected_components(fingerprint_links(prints, radius), "a", "b")
    named = prints.join(group, prints.fp == group.node).select("fp", "first", "component")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    labels = prints.join(named.join(least, "component").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id")
    )
    return rows.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that several texts of a sample have, and their numbers of texts there."""
    drawn = texts.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < int(ORDER_SHARE * (1 << 40)))
    counts = drawn.select(F.explode(shingle_set("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).toPandas()
    found = found.sort_values("token")
    return found["token"].to_numpy("i8"), found["n"].to_numpy("i8")


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """The first shingles in the common order, as many as a text must post."""
    n = len(shingles)
    known, counts = common
    rank = np.zeros(n, "i8")
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, counts[at], 0)
    keep = max(n - max(int(np.ceil(share * n - 1e-6)), 1) + 1, 0)
    return shingles[np.lexsort((shingles, rank))[:keep]] if n else shingles


def parity_sketch(shingles: np.ndarray, size: int = 0) -> np.ndarray:
    """Words of 64 bits: a bit tells whether an odd number of the (unsigned) hashes falls on it. If no size is given, there
    are at least as many bits as hashes, a power of two, up to SKETCH_BITS. Two sketches differ in at most as many bits as
    their sets in members, and xor of its halves makes a sketch into that of half the size."""
    if not size:
        size = 64
        while size < len(shingles) and size < SKETCH_BITS:
            size *= 2
    odd = np.bincount((shingles & np.uint64(size - 1)).astype("i8"), minlength=size) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def postings(texts: DataFrame, share: float) -> DataFrame:
    """A row number for every text, its id and digest, fp (the word fingerprint), n (distinct shingles), sketch (see
    parity_sketch), fold (one of FOLD_BITS) and tokens, the prefix of the text in the common order. Texts have id, digest and text; they are
    read, not copied."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))
    free_shuffles(texts.sparkSession)  # the shingles of the sample

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (pdf.iloc[at : at + 1000] for pdf in batches for at in range(0, len(pdf), 1000)):
            sizes, sketches, folds, tokens = [], [], [], []
            for text in part["text"].tolist():
                own = np.unique(shingle_hashes(text, 5))
                sizes.append(len(own))
                sketches.append(parity_sketch(own))
                folds.append(parity_sketch(own, FOLD_BITS).tobytes())
                tokens.append(prefix(np.sort(own.view("<i8")), shared.value, share))
            yield pd.DataFrame(
                {
                    "id": part["id"].to_numpy(),
                    "digest": part["digest"].to_numpy(),
                    "fp": simhash_words.func(part["text"]).to_numpy(),
                    "n": np.array(sizes, "i4"),
                    "sketch": sketches,
                    "fold": folds,
                    "tokens": tokens,
                }
            )
        give_back()

    named = texts.select(F.col("id").cast("string").alias("id"), "digest", "text")
    posted = named.mapInPandas(post, "id string, digest binary, fp long, n int, sketch array<long>, fold binary, tokens array<long>")
    return materialize(posted.withColumn("row", F.monotonically_increasing_id()), "near-postings")


def _fits(n: str, pos: str, m: str, at: str, share: float) -> str:
    """Whether two texts of n and m shingles that meet at these places of their prefixes can be similar."""
    return (
        f"least({n} - {pos}, {m} - {at}) >= {share / (1 + share)} * ({n} + {m}) - 1e-6"
        f" and least({n}, {m}) >= {share} * greatest({n}, {m}) - 1e-6"
    )


def fingerprint_roots(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root): for each distinct fingerprint that shares a bucket with a lesser one within the radius, the least
    of the buckets' least ones. A bucket's rows meet its least one only, so the work is linear in them.

    The table of fingerprints is small, but gives a row for each mask, nearly all with buckets of their own: it is dealt
    to all tasks first, so that no task aggregates more than its share of them."""
    masks = F.array(*map(F.lit, covering_masks(radius)))
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = prints.select("fp", F.posexplode(masks).alias("mask", "kept"))
    keyed = keyed.select(F.xxhash64("mask", F.col("kept").bitwiseAND(F.col("fp"))).alias("bucket"), "fp")
    shared = keyed.groupBy("bucket").agg(F.min("fp").alias("root"), F.count("*").alias("n")).where("n > 1")
    # written first, so that the join knows its size: few buckets are broadcast, and the fingerprints needn't move again
    shared = materialize(shared.select("bucket", "root"), "near-buckets")
    met = keyed.join(shared, "bucket").where(f"root < fp and bit_count(root ^ fp) <= {radius}")
    return met.groupBy("fp").agg(F.min("root").alias("root"))


def shared_tokens(posted: DataFrame) -> DataFrame:
    """Postings (token, row, n, pos) of the tokens that several rows have, with the place of the token's first row
    (head_row, head_n, head_pos). All postings move once, most of them to find that theirs is the only one."""
    tokens = posted.select(F.posexplode("tokens").alias("pos", "token"), "row", "n").select("token", "pos", "row", "n")
    own = Window.partitionBy("token")
    heads = [F.min("row").over(own).alias("head_row"), *(F.min_by(c, "row").over(own).alias(f"head_{c}") for c in ("n", "pos"))]
    seen = tokens.select("token", "pos", "row", "n", F.count("*").over(own).alias("df"), *heads)
    return materialize(seen.where("df > 1").drop("df"), "near-met")


def star_pairs(posted: DataFrame, met: DataFrame, radius: int, share: float) -> DataFrame:
    """(a, b): for each row b at most three rows before it that it is likely to be similar to: the first one with its
    fingerprint, the first one with the least fingerprint near by, and of the first rows of its tokens the one that it
    meets most often. However large a group is, its pairs are linear in its rows."""
    first = materialize(posted.groupBy("fp").agg(F.min("row").alias("first")), "near-prints")
    same = posted.join(first, "fp").where("first < row").select(F.col("first").alias("a"), F.col("row").alias("b"))
    roots = fingerprint_roots(first, radius)
    near = (
        roots.join(first, "fp")
        .withColumnRenamed("first", "b")
        .join(first.select(F.col("fp").alias("root"), F.col("first").alias("a")), "root")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    meets = met.where("head_row < row").where(_fits("n", "pos", "head_n", "head_pos", share))
    often = meets.groupBy("row", F.col("head_row").alias("a")).agg(F.count("*").alias("times"))
    best = often.groupBy("row").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", F.col("row").alias("b"))
    near = materialize(near, "near-roots")  # its buckets are done with before the tokens meet
    stars = materialize(same.unionByName(near).unionByName(best).distinct(), "near-stars")
    discard(first, near)
    return stars


def may_be_similar(pairs: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) without those that their sketches rule out: sets of n_a and n_b members with that similarity
    differ in at most (1 - share) / (1 + share) of n_a + n_b members, and their sketches in no more bits. No similar pair
    is lost, and a sketch is a fraction of its shingles, so few shingles move for the exact check."""
    side = lambda x: rows.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = f"least(n_a, n_b) >= {share} * greatest(n_a, n_b) - 1e-6"  # sketches then differ in size by one halving at most
    half = "int(size({0}) / 2)"
    halved = f"zip_with(slice({{0}}, 1, {half}), slice({{0}}, {half} + 1, {half}), (x, y) -> x ^ y)"
    fit = f"if(size({{0}}) > size({{1}}), {halved}, {{0}})"
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(sized)
    met = met.select("a", "b", "n_a", "n_b", F.expr(fit.format("s_a", "s_b")).alias("p"), F.expr(fit.format("s_b", "s_a")).alias("q"))
    bits = "aggregate(zip_with(p, q, (x, y) -> bit_count(x ^ y)), 0, (total, x) -> total + x)"
    kept = met.where(f"size(p) <> size(q) or {bits} <= {(1 - share) / (1 + share)} * (n_a + n_b) + 1e-6")
    return materialize(kept.select("a", "b"), "near-likely")


def similar(pairs: DataFrame, texts: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have that Jaccard similarity; two texts without words have. rows has the id,
    digest, n and sketch of each row number; only the texts of pairs that the sketches leave are read on."""
    likely = may_be_similar(pairs, rows, share)
    discard(pairs)
    pairs = likely
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    wanted = materialize(rows.join(wanted, "row").select("row", F.col("id").alias("own_id"), F.col("digest").alias("own_digest")), "near-wanted")
    asked = split_by_ids(texts.withColumn("id", F.col("id").cast("string")), "id", wanted, "own_id")[0]
    met = asked.join(wanted, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    # rows of one id and text meet each other's text, which is the same
    sets = materialize(met.select("row", shingle_set("text").alias("shingles")).dropDuplicates(["row"]), "near-sets")
    discard(wanted)  # with it go the shuffled texts, before the shingles are shuffled
    side = lambda name: sets.select(F.col("row").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    close = both >= share * (F.size("of_a") + F.size("of_b") - both) - 1e-9
    links = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b"), "near-links")
    discard(pairs, sets)
    return links


def mixed_tokens(met: DataFrame, groups: DataFrame) -> tuple[DataFrame, bool]:
    """Postings of the tokens that several groups have, with their group (grp), whether that is another than the
    token's largest (odd), and the token's rows and blocks; and whether comparing the odd rows of every token with all
    its rows would take more than a comparison a posting."""
    placed = met.join(groups.select(F.col("node").alias("row"), F.col("component").alias("grp")), "row", "left")
    placed = placed.withColumn("grp", F.coalesce("grp", "row"))
    held = placed.groupBy("token", "grp").agg(F.count("*").alias("n_rows"))
    spread = held.groupBy("token").agg(
        F.count("*").alias("groups"), F.sum("n_rows").alias("n_rows"), F.max(F.struct("n_rows", "grp")).alias("top")
    )
    odd = F.col("n_rows") - F.col("top.n_rows")
    spread = spread.where("groups > 1").select(
        "token",
        "n_rows",
        F.col("top.grp").alias("top"),
        (odd * F.col("n_rows")).alias("work"),
        F.ceil(odd / BUCKET_ROWS).alias("odd_blocks"),
        F.ceil(F.col("n_rows") / BUCKET_ROWS).alias("blocks"),
    )
    mixed = materialize(placed.join(spread, "token").withColumn("odd", F.col("grp") != F.col("top")), "near-mixed")
    work = mixed.agg(F.sum(F.col("work") / F.col("n_rows")).alias("work"), F.count("*").alias("n")).first()
    return mixed, (work.work or 0) > WORK * work.n


def head_pairs(mixed: DataFrame, share: float, seed: int) -> DataFrame:
    """(a, b): each row of the mixed tokens, at the most frequent of its tokens, with HEADS rows of other groups there
    that a seeded draw makes the same for all; so every row has at most HEADS pairs."""
    chosen = mixed.groupBy("row").agg(F.max_by(F.struct("token", "grp", "n", "pos"), F.struct("n_rows", "token")).alias("at"))
    chosen = materialize(chosen.select("row", "at.*"), "near-chosen")
    draws = [F.struct(F.xxhash64("row", F.lit(seed), F.lit(k)).alias("draw"), "row", "grp", "n", "pos") for k in range(HEADS)]
    heads = chosen.groupBy("token").agg(F.array(*map(F.min, draws)).alias("heads"))
    fits = _fits("n", "pos", "h.n", "h.pos", share)
    found = f"array_distinct(transform(filter(heads, h -> h.grp <> grp and {fits}), h -> h.row))"
    pairs = chosen.join(heads, "token").select("row", F.explode(F.expr(found)).alias("head"))
    pairs = materialize(pairs.select(F.least("row", "head").alias("a"), F.greatest("row", "head").alias("b")).distinct(), "near-heads")
    discard(chosen, mixed)
    return pairs


def remaining_pairs(mixed: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """(a, b): all pairs of rows of different groups that meet at a token and can be similar, also by their small sketches.

    Rows of a token's largest group aren't compared with each other, so a group that is joined costs nothing; the
    blocks of the odd rows meet all blocks of the token."""
    slot = lambda blocks: F.pmod(F.xxhash64("row"), F.col(blocks))
    folded = mixed.join(rows.select("row", "fold"), "row")
    # as one to be paired, at its own block of the odd rows, with every block of the others; as one of all, at its block
    sides = F.when(F.col("odd"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asks = folded.where("odd").select("token", "row", "grp", "n", "pos", "fold", slot("odd_blocks").alias("i"), F.explode(sides).alias("j"), F.lit(True).alias("asks"))
    gives = folded.select(
        "token", "row", "grp", "n", "pos", "fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("odd_blocks") - 1)).alias("i"), slot("blocks").alias("j"), F.lit(False).alias("asks")
    )
    both = asks.unionByName(gives.select(*asks.columns))
    dealt = both.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "asks")
    pairs = materialize(dealt.mapInPandas(_pair_scan(share), "a long, b long").distinct(), "near-candidates")
    discard(mixed)
    return pairs


def _pair_scan(share: float):
    """Over rows sorted by token, i, j: the pairs that can be similar, of rows that ask with rows that give."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            if pdf.empty:
                continue
            key = pdf[["token", "i", "j"]].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1))
            held = pdf.iloc[starts[-1] :]
            if len(starts) > 1:
                yield from found(pdf.iloc[: starts[-1]], starts)
        if held is not None:
            yield from found(held, np.array([0, len(held)]))
        give_back()

    def found(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, group, n, at, asks = (pdf[c].to_numpy() for c in ("row", "grp", "n", "pos", "asks"))
        fold = np.frombuffer(b"".join(pdf["fold"]), "<u8").reshape(len(pdf), -1)
        out, held = [], 0
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            middle = start + int(np.searchsorted(asks[start:end], True))  # those that give come first
            give = slice(start, middle)
            for i in range(middle, end, 256):
                ask = slice(i, min(i + 256, end))
                fits = group[ask, None] != group[None, give]
                fits &= np.minimum(n[ask, None] - at[ask, None], n[None, give] - at[None, give]) >= share / (1 + share) * (n[ask, None] + n[None, give]) - 1e-6
                fits &= np.minimum(n[ask, None], n[None, give]) >= share * np.maximum(n[ask, None], n[None, give]) - 1e-6
                x, y = np.nonzero(fits)
                x, y = x + i, y + start
                near = np.bitwise_count(fold[x] ^ fold[y]).sum(1) <= (1 - share) / (1 + share) * (n[x].astype("i8") + n[y]) + 1e-6
                x, y = ids[x[near]], ids[y[near]]
                out.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
                held += len(x)
                if held > PAIRS_AT_ONCE:
                    yield distinct(out)
                    out, held = [], 0
        if held:
            yield distinct(out)

    def distinct(out: list[np.ndarray]) -> pd.DataFrame:
        pairs = np.unique(np.concatenate(out, 1), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return scan


def linked_rows(texts: DataFrame, radius: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the row numbers that have a partner, directly or in steps; and the id and digest of each
    row. texts has id, digest and text."""
    posted = postings(texts, share)
    rows = materialize(posted.drop("tokens"), "near-named")
    met = shared_tokens(posted)
    discard(posted)
    stars = star_pairs(rows, met, radius, share)
    met = met.select("token", "row", "n", "pos")
    links = similar(stars, texts, rows, share)
    groups = connected_components(links, "a", "b")
    mixed, many = mixed_tokens(met, groups)
    for seed in range(HEAD_ROUNDS):
        if not many:
            break
        links = links.unionByName(similar(head_pairs(mixed, share, seed), texts, rows, share))
        groups = connected_components(links, "a", "b")
        mixed, many = mixed_tokens(met, groups)
    more = similar(remaining_pairs(mixed, rows, share), texts, rows, share)
    discard(met)
    if more.isEmpty():
        return groups, rows
    return connected_components(links.unionByName(more), "a", "b"), rows


def _digest(text_col: str):
    return F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))


def _groups(docs: DataFrame, radius: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """node, component, id, digest and least (null ids last) of each row number that has a partner."""
    texts = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), text_of(text_col).alias("text"))
    groups, rows = linked_rows(texts, radius, share)
    rows = rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    named = groups.join(rows, groups.node == rows.row).drop("row")
    least = named.groupBy("component").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "node", "digest")).alias("least"))
    return materialize(named.join(least, "component"), "near-groups")


def near_groups(docs: DataFrame, radius: int = 3, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component): the ids of the rows that have a partner, with the least id of their group. Partners have a
    Jaccard similarity of 5-word shingles of at least share, followed over any number of steps. Every pair is found:
    the fingerprints and first meetings join most rows at a cost linear in their number, the prefix filter the rest."""
    found = _groups(docs, radius, share, id_col, text_col)
    return found.select(F.col("id").alias("node"), F.col("least.id").alias("component"))


def drop_near_copies(docs: DataFrame, radius: int = 3, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest id (then the first read); all columns
    stay. A document is named by its id and the digest of its text, so rows of one id with other texts are judged apart."""
    found = _groups(docs, radius, share, id_col, text_col)
    key = [fresh(docs, name) for name in ("gone_id", "gone_digest")]
    gone = found.where("not (id <=> least.id and digest = least.digest)")
    gone = gone.select(F.col("id").alias(key[0]), F.col("digest").alias(key[1])).distinct()
    gone = materialize(gone, "near-gone")
    doubtful, clear = split_by_ids(docs, id_col, gone, key[0])  # only the texts of doubtful rows move
    same = F.col(id_col).eqNullSafe(F.col(key[0])) & (_digest(text_col) == F.col(key[1]))
    return clear.unionByName(doubtful.join(gone, same, "left_anti"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
