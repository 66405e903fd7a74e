"""Fill-in-the-middle, filter audit and secret scan against brute force and against their SQL, with awkward rows."""

import collections
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

from lodestar.llm import fill_in_middle, filter_audit, queries, secret_scan

from .test_operators import ODD, odd

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_filter_audit"])
def test_same_as_sql(spark, sf_dir, name):
    same_as_sql(spark, sf_dir, name)


def test_fill_in_middle_column_names(spark, sf_dir):
    names = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()
    assert queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).columns == names


# fill in the middle


def units(text):
    return UNIT.findall(text)


def check_fim(rows, expected):
    """rows: of fill_in_middle with restored; expected: (doc_id, text) of every row."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for doc_id, text in expected:
        text = text or ""
        own = units(text)
        n, h = len(own), sha(f"1:{'' if doc_id is None else doc_id}")
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want[doc_id, n, "plain", None, None, text, text] += 1
        elif h4 % 100 < 20:
            want[doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text] += 1
        else:
            want[doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text] += 1
    assert collections.Counter(map(tuple, rows)) == want


def fim(frame):
    from pyspark.sql import functions as F

    made = fill_in_middle.fill_in_middle(frame)
    return made.withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()


def test_fill_in_middle_odd(spark):
    check_fim(fim(odd(spark)), ODD)
    assert fim(odd(spark, empty=True)) == []


def test_fill_in_middle_random(spark):
    draw = random.Random(5)
    pieces = ["a", "Bc", " ", "\n", "é", "𝔘", "<", "P>", "<S", "<P>", ">", "M", "1", "中文", "zz zz", "S>"]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randrange(40)))) for i in range(600)]
    rows += [(1000, "word. " * 300_000), (1001, "x" * 400_000 + "1" * 400_000), (1002, "é" * 2_000_000 + " end")]
    found = fim(spark.createDataFrame(rows, "doc_id long, text string"))
    check_fim(found, rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_rank_index(monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    draw = random.Random(block)
    for size in (0, 1, 2, 50, 4000):
        words = ["a" * int(draw.expovariate(0.05) + 1) if draw.random() < 0.5 else draw.choice(" 1é𝔘\n") for _ in range(size)]
        text = "".join(words)
        index = fill_in_middle.fit(text)
        offsets = np.cumsum([0, *map(len, units(text))])
        assert index["n"] == len(offsets) - 1 and len(index["residuals"]) == len(offsets)
        for rank, offset in enumerate(offsets.tolist()):
            at = sum(s <= rank for s in index["starts"]) - 1
            predicted = index["bases"][at] + ((rank - index["starts"][at]) * index["slopes"][at] >> fill_in_middle.SCALE)
            assert predicted + index["residuals"][rank] - 128 == offset
    if block > 4000:
        assert len(fill_in_middle.fit("word. " * 50_000)["starts"]) < 10


# filter audit


def brute_audit(rows, labels):
    """rows: (doc_id, lang, text)."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for doc_id, _, text in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    parts = collections.defaultdict(list)
    for doc_id, lang, text in rows:
        text = text or ""
        words = [w for w in SPACE.split(text) if w]
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (doc_id is not None and least[text] < doc_id)
        parts[lang or ""].append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                alone = sum(d[0] == f for d in docs)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit_odd(spark):
    draw = random.Random(3)
    rows = [(i, t, draw.choice(["en", None, "", "fr"])) for i, t in ODD]
    rows += [(i, "Many COPIES of one text " * 60, "en") for i in range(30, 60)] + [(35, "Many COPIES of one text " * 60, "fr")]
    rows += [(100 + i, " ".join(f"{draw.choice('abcW#')}{draw.randrange(10 ** draw.randrange(1, 5))}" for _ in range(draw.randrange(400))), "de") for i in range(80)]
    rows += [(None, "without", None), (None, "without", None)]
    labels = [(i, draw.randrange(2), draw.randrange(2)) for i in range(10, 180, 2)] + [(30, 1, None), (30, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(i, t, x, 1, 2, "m") for i, t, x in rows], "doc_id long, text string, lang string, mask int, part int, digest string")
    flags = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, part int")
    found = [tuple(r) for r in filter_audit.filter_audit(frame, flags).collect()]
    want = brute_audit([(i, x, t) for i, t, x in rows], [x for x in labels if x[0] is not None])
    assert len(found) == len(set(found)) == 600 * 4
    assert set(found) == want
    assert filter_audit.filter_audit(frame.limit(0), flags).count() == 0
    assert filter_audit.filter_audit(frame, flags.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# secret scan

KEY = "q7Rz2LmX9vTb4KpWc8YdHs3Nf6Gj"
TEXTS = [
    ("plain words with a token of thanks and nothing else", 0),
    (f"Authorization: Bearer {KEY}", 1),
    (f"the private key is {KEY} they said", 1),
    (f"{KEY} in a place that says nothing of its kind", 0),
    (f"key schedule: {KEY} is repeated; the private session uses {KEY}", 0),
    ("a private internationalizationframework of words", 0),
    (f"password: {KEY}", 0),
    (f"login {KEY} and cookie {KEY[::-1]} and secret: abc", 2),
]


def test_secret_kinds(spark):
    """Keys in a sensitive place are found; known, common or base strings aren't reported as novel."""
    frame = spark.createDataFrame(list(enumerate(t for t, _ in TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(frame).collect()}
    for i, (text, n) in enumerate(TEXTS):
        novel = [s for s in found[i] if s.kind == "novel"]
        assert len(novel) == n, text
        assert all(text[s.start : s.end] in (KEY, KEY[::-1]) for s in novel)
    assert [s.kind for s in found[6]] == ["assign"]


def brute_base(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (kind, rule, least) in enumerate((("assign", pattern, 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        at = 0
        compiled = re.compile(rule, (re.A | re.I) if k == 0 else 0)
        while m := compiled.search(text, at):
            at = m.end()
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


BASES = [
    "token=abcdef", "token=abcde", "TOKEN = 'abc.def-1=='", "ſecret: abcdefgh", "toKen: abcdefgh", "secret=token=abcdefgh", "api_key\" :  \"0123456789abcdef0123456789abcdef\"",
    "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15, "𝔘𝔘 passwd:" + "a1" * 20, "f" * 23 + "g" + "f" * 24, "password\n: abcdefgh", "api__key=abcdefgh apikey=abcdefg", "token=ab token=abcdefg", "AKIA" * 9,
]


def test_secret_base(spark):
    draw = random.Random(9)
    texts = BASES + ["".join(draw.choices([*BASES, " ", "=", "x", "𝔘", "\n", '"'], k=9)) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans int, kind string")
    for r in secret_scan.scan_secrets(frame).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "novel")
        assert base == brute_base(texts[r.doc_id]), texts[r.doc_id]
        starts = [(s.start, secret_scan.KINDS.index(s.kind)) for s in r.spans]
        assert starts == sorted(starts)


def test_secret_query(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")  # the smallest tables hold no secret
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_secret_scan"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = collections.Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [s for s in base.split(",") if s]
    assert sum(r.n_assign for r in rows) > 0


def test_secret_odd(spark):
    rows = secret_scan.scan_secrets(odd(spark)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in ODD)
    assert all(r.spans == [] for r in rows if r.doc_id in (10, 11, 12))
    assert secret_scan.scan_secrets(odd(spark, empty=True)).collect() == []


def test_secret_dictionary(spark):
    rows = [(i, f"common_name other{i % 2} {'x' * 30} rareword{i} common_name") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert secret_scan.identifiers(frame) == ["rareword", "other", "common_name"]
    assert secret_scan.identifiers(frame.limit(2)) == []
