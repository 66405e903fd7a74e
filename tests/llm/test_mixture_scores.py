"""Scores of the interpolated model against counts, weights and sums worked out one by one."""

import collections
import math
import re
import zlib

import pytest

from lodestar.llm import language_model as L

SPACE = re.compile(r"[\x20\x09-\x0D]+")
END = object()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(low) if w] + [END]


def step(count):
    """The step that a count is rounded to: itself up to 8, then four to a doubling."""
    return count if count <= 8 else 8 * 2 ** (round(4 * math.log2(count / 8)) / 4)


def bucket(count):
    return min(1 + math.floor(math.log2(count)), L.BUCKETS - 1) if count >= 1 else 0


def by_hand(rows):
    """doc_id -> (held out, tokens, known, N, base score, score)."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    parsed = {i: tokens(t) for i, t in rows}
    own, both, cells = collections.Counter(), collections.Counter(), collections.Counter()
    for i, words in parsed.items():
        if not held[i]:
            own.update(words)
            both.update(zip([END, *words[:-1]], words, strict=True))
    n, v = sum(own.values()), len(own)
    for (before, word), times in both.items():
        cells[step(own[before]), step(own[word]), step(both[before, word])] += times
    weights = collections.defaultdict(lambda: [0.4, 0.4, 0.2])
    weights[0] = [0.0, 0.5, 0.5]
    for _ in range(40):
        mass = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
        for (b, w, p), times in cells.items():
            at = bucket(b - 1)
            parts = [(p - 1) / (b - 1) if b > 1 else 0.0, (w - 1) / (n - 1), (w - 0.5) / (n - 0.5 + 0.5 * v)]
            parts = [max(x, 0.0) * y for x, y in zip(parts, weights[at], strict=True)]
            for k, x in enumerate(parts):
                mass[at][k] += times * x / sum(parts)
        for at in range(L.BUCKETS):
            m = mass[at]
            weights[at] = [m[0] / (sum(m) + 0.02), (m[1] + 0.01) / (sum(m) + 0.02), (m[2] + 0.01) / (sum(m) + 0.02)]
    out = {}
    for i, words in parsed.items():
        base = score = 0.0
        for before, word in zip([END, *words[:-1]], words, strict=True):
            plain = (own[word] + 0.5) / (n + 0.5 * (v + 1))
            w = weights[bucket(own[before])]
            base += math.log10(plain)
            score += math.log10(w[0] * both[before, word] / max(own[before], 1) + w[1] * own[word] / n + w[2] * plain)
        out[i] = (held[i], len(words), sum(own[w] > 0 for w in words), n, base, score)
    return out


@pytest.mark.parametrize("tasks", [1, 9])
def test_scores(spark, sf_dir, tasks):
    """Over one batch, and over several whose counts are summed in parts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    found = L.score_texts(docs.repartition(tasks)).collect()
    assert {r.doc_id for r in found} == set(want)
    for r in found:
        held, size, known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
