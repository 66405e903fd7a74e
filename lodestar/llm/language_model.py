"""Language-model scores by deleted interpolation of a bigram model, learned from the documents themselves.

The probability of a token mixes its maximum-likelihood estimate after the token before it, its unigram estimate and
an add-half base, with weights that depend on how often the context occurs (buckets by powers of two). The weights
come from expectation-maximisation on held-out counts: every training occurrence is left out of the counts in turn.

Nothing but the documents' own pieces meets in one place. A scan turns about BATCH_CHARS characters of whole texts
into one row (token codes and the hashes of its distinct words), with no shuffle of texts. Each such batch sends its
distinct words and bigrams, once each, as differences of sorted hashes to the part of the hash range that counts them,
and gets the corpus counts back in the same order. Held-out statistics are summed in a grid of rounded counts whose
size doesn't depend on the input; expectation-maximisation runs on that grid on the driver.

Cases: a null or empty text is the one end token; very long texts are taken in blocks; repeated rows count each
time; a null id trains; with no training rows all counts are 0 and the base is certain (score 0); an empty table
gives an empty result; extra columns are ignored. Words and bigrams meet by hashes, of which KEY_BITS and the
part's number are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_before, as_text, fold, table, text_of
from lodestar.session import materialize

BATCH_CHARS = 10_000_000
BLOCK_BYTES = 4_000_000
#: Bits of a word's and of a bigram's hash that are compared within a part of the hash range.
KEY_BITS = (48, 40)
END = b"\n"  # no word holds white space
BUCKETS = 34
#: Tokens that are looked at together.
SLICE = 1 << 19


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=6).compress(values.view("u1").reshape(len(values), -1).T.tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(width, -1).T.copy().view(kind).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codes:
    """Token codes of the texts of one batch."""

    def __init__(self):
        self.code_of: dict[bytes, int] = {END: 0}
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.sizes: list[int] = []
        self.chars = 0

    def add(self, doc_id, held_out: bool, text: str | None) -> None:
        data = (text or "").encode("utf-8", "replace").lower()
        self.chars += len(data)
        size, at = 1, 0
        while at < len(data):
            to = at + BLOCK_BYTES
            while to < len(data) and not data[to : to + 1].isspace():
                to += 1
            words = data[at:to].split()
            at = to
            if words:
                own, distinct = pd.factorize(np.array(words, object))
                codes = self.code_of
                named = np.array([codes.setdefault(w, len(codes)) for w in distinct], "u4")
                self.parts.append(named[own])
                size += len(words)
        self.parts.append(np.zeros(1, "u4"))
        self.docs.append((doc_id, held_out))
        self.sizes.append(size)

    def row(self, batch: int) -> dict:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.code_of], "u8")
        codes = np.concatenate(self.parts)
        often = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")  # frequent words get small codes
        place = np.empty(len(often), "u4")
        place[often] = np.arange(len(often), dtype="u4")
        return {
            "batch": batch,
            "ids": [d for d, _ in self.docs],
            "held_out": [bool(h) for _, h in self.docs],
            "sizes": self.sizes,
            "words": hashes[often].tobytes(),
            "codes": squeeze(place[codes]),
        }


class Batch:
    """Tokens of a batch by their ranks among its sorted distinct words and bigrams."""

    def __init__(self, words: bytes, codes: bytes, sizes, held_out):
        self.word_keys, rank = np.unique(mix(np.frombuffer(words, "u8")), return_inverse=True)
        self.tokens = rank.astype("u4")[unsqueeze(codes, "u4")]
        self.sizes = np.asarray(sizes, "i8")
        self.train = np.repeat(~np.asarray(held_out, bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        end = np.searchsorted(self.word_keys, mix(np.array([xxhash.xxh64_intdigest(END)], "u8"))).astype("u4")
        self.context = np.concatenate((end, self.tokens[:-1]))  # before a text stands the end of another
        key = self.word_keys[self.context] * np.uint64(0x9E3779B97F4A7C15)
        key += self.word_keys[self.tokens]
        self.pair_keys, pairs = np.unique(mix(key), return_inverse=True)
        self.pairs = pairs.astype("u4")

    def counted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted keys, how often each occurs in this batch's training texts)."""
        for kind, keys, ranks in ((0, self.word_keys, self.tokens), (1, self.pair_keys, self.pairs)):
            yield kind, keys, np.bincount(ranks[self.train], minlength=len(keys)).astype("u4")


def tokenize(docs: DataFrame) -> DataFrame:
    """One row per batch: ids, folds and sizes of its documents, hashes of its words, codes of its tokens."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, codes = TaskContext.get().partitionId() << 32, 0, Codes()
        for pdf in frames:
            for doc_id, held_out, text in zip(pdf["doc_id"], pdf["held_out"], pdf["text"]):
                codes.add(doc_id, held_out, text)
                if codes.chars >= BATCH_CHARS:
                    yield pd.DataFrame([codes.row(base + made)])
                    made, codes = made + 1, Codes()
        if codes.docs:
            yield pd.DataFrame([codes.row(base + made)])

    schema = "batch long, ids array<string>, held_out array<boolean>, sizes array<long>, words binary, codes binary"
    rows = docs.select(as_text().alias("doc_id"), (fold("doc_id", 5) == 1).alias("held_out"), text_of().alias("text"))
    return materialize(rows.mapInPandas(work, schema), "lm-batches")


def _send(bits: int):
    """Distinct keys of each batch, dealt to 2**bits parts of the hash range."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                out = []
                for kind, keys, counts in Batch(r.words, r.codes, r.sizes, r.held_out).counted():
                    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(keys)]
                    low = (keys << np.uint64(bits)) >> np.uint64(64 - KEY_BITS[kind])
                    for part in range(1 << bits):
                        own = slice(cuts[part], cuts[part + 1])
                        if own.stop > own.start:
                            steps = np.diff(low[own], prepend=np.uint64(0))
                            out.append((kind, part, r.batch, squeeze(steps), squeeze(counts[own])))
                yield pd.DataFrame(out, columns=["kind", "part", "batch", "keys", "counts"])

    return work


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one part, for every batch in its own order; under batch -1 the sum and number of counts."""
    keys = [np.cumsum(unsqueeze(k, "u8")) for k in pdf["keys"]]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([unsqueeze(c, "u4") for c in pdf["counts"]])
    total = np.bincount(where, weights=own, minlength=len(distinct)).astype("u4")
    ends = np.cumsum([len(k) for k in keys])
    found = np.split(total[where], ends[:-1])
    kind, part = pdf["kind"].iloc[0], pdf["part"].iloc[0]
    out = pd.DataFrame({"kind": kind, "part": part, "batch": pdf["batch"], "counts": [squeeze(f) for f in found], "n": 0, "v": 0})
    whole = pd.DataFrame([{"kind": kind, "part": part, "batch": -1, "counts": b"", "n": int(total.sum()), "v": int((total > 0).sum())}])
    return pd.concat([out, whole])


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts in steps: exact up to 8, then four to each doubling."""
    c = counts.astype("f8")
    steps = np.where(c <= 8, c, 8 + np.rint(4 * np.log2(np.maximum(c, 1) / 8)))
    return steps.astype("i8")


def unrounded(steps: np.ndarray) -> np.ndarray:
    return np.where(steps <= 8, steps, 8 * 2.0 ** ((steps - 8) / 4))


def bucket(counts: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for none, else by powers of two."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype("i8").clip(0, BUCKETS - 1)


def _counts(batch: Batch, words: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of the tokens: corpus counts of every token's context, itself, and both together."""
    for at in range(0, len(batch.tokens), SLICE):
        own = slice(at, at + SLICE)
        yield own, words[batch.context[own]], words[batch.tokens[own]], pairs[batch.pairs[own]]


def _join(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A batch with its corpus counts, and its part of the grid of held-out statistics."""
    answers = answers.sort_values(["kind", "part"])
    names = ["ids", "held_out", "sizes", "words", "codes"]
    if pdf.empty:  # batch -1: the sums
        words = answers[answers["kind"] == 0]
        row = {"batch": -1, "n": int(words["n"].sum()), "v": int(words["v"].sum())}
        return pd.DataFrame([row | dict.fromkeys([*names, "uni", "bi", "cells", "times"])])
    r = pdf.iloc[0]
    uni, bi = (np.concatenate([unsqueeze(c, "u4") for c in answers["counts"][answers["kind"] == k]]) for k in (0, 1))
    batch = Batch(r["words"], r["codes"], r["sizes"], r["held_out"])
    grid: dict[int, int] = {}
    for part, before, own, both in _counts(batch, uni, bi):
        keep = batch.train[part]
        cell = (rounded(before[keep]) << 40) + (rounded(own[keep]) << 20) + rounded(both[keep])
        for c, n in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
            grid[c] = grid.get(c, 0) + n
    cells, times = np.array(list(grid), "i8"), np.array(list(grid.values()), "i8")
    row = {name: r[name] for name in ["batch", *names]}
    row |= {"uni": squeeze(uni), "bi": squeeze(bi), "cells": cells, "times": times, "n": 0, "v": 0}
    return pd.DataFrame([row])


def mixture(before, own, both, times, n: int, v: int, rounds: int = 40) -> np.ndarray:
    """Weights (buckets x bigram, unigram, base) by expectation-maximisation, each occurrence left out of the counts."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.5, 0.5]
    if n > 1 and len(times):
        p = np.stack(
            [
                np.where(before > 1, (both - 1) / np.maximum(before - 1, 1), 0),
                (own - 1) / (n - 1),
                (own - 0.5) / (n - 0.5 + 0.5 * v),
            ],
            1,
        ).clip(0)
        where = bucket(np.maximum(before - 1, 0))
        for _ in range(rounds):
            share = weights[where] * p
            share *= (times / np.maximum(share.sum(1), 1e-300))[:, None]
            mass = np.zeros((BUCKETS, 3))
            np.add.at(mass, where, share)
            weights = (mass + [0, 0.01, 0.01]) / (mass.sum(1, keepdims=True) + 0.02)
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    batches = tokenize(docs)
    size = batches.count()
    bits = max(0, math.ceil(math.log2(max(size, 1) / 2)))
    sent = batches.mapInPandas(_send(bits), "kind int, part int, batch long, keys binary, counts binary")
    answers = sent.groupBy("kind", "part").applyInPandas(_sum, "kind int, part int, batch long, counts binary, n long, v long")
    schema = batches._jdf.schema().toDDL() + ", uni binary, bi binary, cells array<long>, times array<long>, n long, v long"
    whole = materialize(batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_join, schema), "lm-counted")
    sums = whole.where("batch = -1").select("n", "v").first()
    n, v = (sums.n, sums.v) if sums else (0, 0)
    grid = (
        whole.where("batch >= 0")
        .select(F.explode(F.arrays_zip("cells", "times")).alias("c"))
        .groupBy("c.cells")
        .agg(F.sum("c.times").alias("times"))
        .collect()
    )
    cells = np.array([r.cells for r in grid], "i8")
    before, own, both = (unrounded(cells >> s & 0xFFFFF) for s in (40, 20, 0))
    weights = mixture(before, own, both, np.array([r.times for r in grid], "f8"), n, v)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                batch = Batch(r.words, r.codes, r.sizes, r.held_out)
                base, score = np.empty(len(batch.tokens)), np.empty(len(batch.tokens))
                known = np.empty(len(batch.tokens), bool)
                for part, before, own, both in _counts(batch, unsqueeze(r.uni, "u4"), unsqueeze(r.bi, "u4")):
                    at = bucket(before)
                    plain = (own + 0.5) / (n + 0.5 * (v + 1))
                    p = weights[at, 0] * both / np.maximum(before, 1) + weights[at, 1] * own / max(n, 1) + weights[at, 2] * plain
                    base[part], score[part], known[part] = np.log10(plain), np.log10(p if n else plain), own > 0
                yield pd.DataFrame(
                    {
                        "doc_id": r.ids,
                        "held_out": r.held_out,
                        "n_tokens": batch.sizes,
                        "n_known": np.add.reduceat(known, batch.starts, dtype="i8"),
                        "train_tokens": n,
                        "base_score": np.add.reduceat(base, batch.starts),
                        "score": np.add.reduceat(score, batch.starts),
                    }
                )

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counted = whole.where("batch >= 0").select("ids", "held_out", "sizes", "words", "codes", "uni", "bi")
    return as_before(counted.mapInPandas(work, schema), docs)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
