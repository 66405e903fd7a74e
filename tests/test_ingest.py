"""Taking in new memories against the sequential rule, in one batch and as a stream."""

import random

import numpy as np
import pytest

from lodestar.operators.ingest import ingest
from lodestar.operators.nearest import nearest
from lodestar.streaming import ingest_stream as S

SCHEMA = "id long, content string, labels array<string>, embedding array<double>"
DENIALS = ["fix", "wrong", "instead of"]


def words(text):
    return [w for w in "".join(c if c.isalnum() or c == "-" else " " for c in text.lower()).split() if len(w.encode()) >= 2]


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9) if a is not None and b is not None else 0.0


def sequential(stored, batch, history=False):
    """Outcome, original and conflicts of every row, one after another."""
    there, out = list(stored), {}
    for row in sorted(batch):
        i, text, _, vector = row
        if text is None or not text.strip():
            out[i] = ("invalid", None, None)
            continue
        if len(text.strip().encode()) < 5:
            out[i] = ("noise", None, None)
            continue
        near = sorted((-cosine(vector, v), j, t) for j, t, _, v in there if cosine(vector, v) > 0.75)[:3]
        own, original, conflicts = words(text), None, []
        for far, j, t in near:
            a, b = set(own), set(words(t))
            alike = len(a & b) / len(a | b) if a and b else 0
            if -far > 0.85 and len(t.encode()) > 20 and alike > (0.8 if len(text.encode()) < 30 and not history else 0.55):
                original = j
                break
            if not history and own and any(w in text.lower() for w in DENIALS) and sum(w in b for w in own) / len(own) > 0.4:
                conflicts.append(j)
        out[i] = ("repeat", original, None) if original is not None else ("in", None, sorted(conflicts))
        if original is None:
            there.append(row)
    return out


def draw_rows(seed, ids, dense):
    """Rows whose vectors lie in a few bundles; dense: most in one, with texts that seldom repeat each other."""
    draw = random.Random(seed)
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(4, 12))
    subjects = [f"the {a} of the {b} server number {k}" for k, (a, b) in enumerate([("cache", "old"), ("index", "new"), ("queue", "third"), ("pool", "last")])]
    out = []
    for i in ids:
        c = 0 if dense and draw.random() < 0.8 else draw.randrange(4)
        text = subjects[c] + " " + " ".join(draw.choices(["runs", "stops", "wrong", "fix", "slowly", "today", "twice", "hot"], k=draw.randrange(1 if dense else 4)))
        if dense:
            text += " " + " ".join(draw.choices([f"w{k}" for k in range(30)], k=draw.choice([0, 0, 6, 9])))
        text = draw.choice([text] * 9 + ["", " x ", None, "short text one"])
        vector = None if draw.random() < 0.04 else [float(x) for x in centres[c] + gen.normal(size=12) * draw.choice([0.0, 0.2, 0.5])]
        out.append((i, text, ["a"], vector))
    return out


def found(frame):
    return {r.id: (r.outcome, r.original, r.conflicts) for r in frame.collect()}


@pytest.mark.parametrize("dense, history", [(False, False), (True, False), (True, True)])
def test_one_batch(spark, dense, history):
    rows = draw_rows(11, range(260), dense)
    stored, batch = [r for r in rows if r[0] % 4 == 1 and r[1]], [r for r in rows if r[0] % 4 != 1]
    got = found(ingest(spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(batch, SCHEMA).repartition(3), history))
    want = sequential(stored, batch, history)
    assert got == want
    assert {o for o, *_ in want.values()} == {"in", "repeat", "noise", "invalid"}
    assert dense or any(c for _, _, c in want.values())


def test_hot_text(spark):
    """A batch of which most is one text: one row goes in, in few rounds, and no list is longer than the limit."""
    vector = [1.0, 2.0, 3.0]
    batch = spark.createDataFrame([(i, "one and the same sentence about the cache", [], vector) for i in range(3000)], SCHEMA)
    got = found(ingest(batch.limit(0), batch))
    assert got.pop(0) == ("in", None, [])
    assert set(got.values()) == {("repeat", 0, None)}


def test_form_of_what_goes_in(spark):
    texts = [
        ("Use PostgreSQL instead of SQLite because we need concurrent writes", ["decision"], "decision"),
        ("Fixed memory leak in WebSocket handler. root_cause: connection pool never closed", ["bug"], "bugfix"),
        ("This is a general note about the project status and timeline for next quarter", [], "general"),
        ("Deploy new nginx config with HTTPS and SSL certbot on the server", [], "general"),
        ("ok", ["test"], "noise"),
        ("嗯", [], "noise"),
    ]
    batch = spark.createDataFrame([(i, t, x, None) for i, (t, x, _) in enumerate(texts)], SCHEMA)
    rows = {r.id: r for r in ingest(batch.limit(0), batch).collect()}
    assert [rows[i]["class"] for i in range(6)] == [k for _, _, k in texts]
    assert [rows[i].outcome for i in range(6)] == ["in"] * 4 + ["noise"] * 2
    assert rows[0].importance >= 2.5 and "because we need" in rows[0].rationale
    assert rows[1].labels == ["bug", "bugfix"] and {"nginx", "ssl", "deployment"} <= set(rows[3].labels)
    assert ingest(batch, batch.limit(0)).count() == 0


def test_conflict(spark):
    near = lambda x: [1.0, x]
    stored = [(1, "Use firewalld for port blocking on the server", [], near(0.1))]
    batch = [(2, "Fix: removed firewalld, use nft instead of iptables for port blocking", [], near(0.2))]
    got = found(ingest(spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(batch, SCHEMA)))
    assert got == {2: ("in", None, [1])}


def test_nearest(spark):
    gen = np.random.default_rng(2)
    vectors = gen.normal(size=(300, 6))
    vectors[40:60] = vectors[40]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(400, None), (401, [0.0] * 6)], "id long, embedding array<double>")
    for earlier in (False, True):
        got = {}
        for r in nearest(frame, frame, 4, 0.6, earlier, block=64).collect():
            got.setdefault(r.a, set()).add((r.b, r.similarity))
        for i in range(300):
            want = sorted((-cosine(vectors[i], vectors[j]), j) for j in range(300) if j != i and (j < i or not earlier) and cosine(vectors[i], vectors[j]) > 0.6)[:4]
            assert got.get(i, set()) == {(j, min(-s, 1.0)) for s, j in want}


@pytest.mark.parametrize("least", [0.75, -2.0])
def test_nearest_in_pieces(spark, monkeypatch, least):
    """Equal vectors in all pieces, close ones that single precision can't tell apart, and many more rows than k."""
    from lodestar.operators import nearest as N

    monkeypatch.setattr(N, "PIECE", 16)
    monkeypatch.setattr(N, "PAIRS", 5)
    gen = np.random.default_rng(6)
    vectors = gen.normal(size=(200, 5))
    vectors[::7] = vectors[0] + 1e-8 * gen.normal(size=(29, 5))
    vectors[3::10] = vectors[3]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    for earlier in (False, True):
        got = {}
        for r in nearest(frame.where("id % 3 > 0"), frame, 3, least, earlier, block=90).collect():
            got.setdefault(r.a, []).append((-r.similarity, r.b))
        for i in range(200):
            there = [j for j in range(200) if i % 3 and (j < i if earlier else j != i)]
            want = sorted((-min(cosine(vectors[i], vectors[j]), 1.0), j) for j in there if cosine(vectors[i], vectors[j]) > least)[:3]
            assert sorted(got.get(i, [])) == want


def test_word_vectors_move_no_row(spark):
    """The vectors of words as by hand, for words that repeat, null words, lists and texts; without a shuffle."""
    import hashlib

    from lodestar.sources import tables

    lists = [["a", "b", "a", "決策"], [], None, [None, "zz"], [f"w{i}" for i in range(300)], ["", "b"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>")
    made = tables.text_vectors(rows, rows.words)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        want = [0.0] * tables.DIMENSIONS
        for word in {w for w in lists[r.id] or [] if w is not None}:
            digest = hashlib.md5(word.encode()).hexdigest()
            want[int(digest[:2], 16) % tables.DIMENSIONS] += 1.0 if digest[2] < "8" else -1.0
        assert r.embedding == want


def test_stream(spark, tmp_path):
    """Batch after batch is as row after row; a batch that comes again changes nothing."""
    rows = draw_rows(5, range(120), True)
    stored, folder = [r for r in rows if r[0] < 30 and r[1]], str(tmp_path / "table")
    S.create(spark.createDataFrame(stored, SCHEMA), folder)
    batches = [[r for r in rows if low <= r[0] < low + 30] for low in (30, 60, 90)]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = S.ingest_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), folder, str(tmp_path / "checkpoint"))
        query.awaitTermination(240)
        assert query.exception() is None and S.last_version(spark, folder) == n
    want = sequential(stored, [r for b in batches for r in b])
    state = lambda: (
        sorted((r.id, r.outcome, r.original) for r in S.read(spark, folder, "decisions").collect()),
        sorted(r.id for r in S.read(spark, folder, "memories").collect()),
        sorted((r.a, r.b, r.strength) for r in S.read(spark, folder, "links").collect()),
    )
    first = state()
    assert first[0] == sorted((i, o, x) for i, (o, x, _) in want.items())
    assert first[1] == sorted([r[0] for r in stored] + [i for i, (o, *_) in want.items() if o == "in"])
    assert first[2] == sorted((i, b, 0.8) for i, (_, _, c) in want.items() for b in c or [])
    S.ingest_batch(spark.createDataFrame(batches[2] + batches[0][:3], SCHEMA), 2, folder)
    assert state() == first
    assert {r.id for r in S.read(spark, folder, "decisions", 0).collect()} == {r[0] for r in batches[0]}
