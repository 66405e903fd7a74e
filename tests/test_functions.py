"""Functions against hand-made facts and plain Python."""

import random

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import graph as G
from lodestar.operators import intent_search as I
from lodestar.operators.chunks import chunk
from lodestar.operators.components import connected_components
from lodestar.operators.retrieval import similar_pairs
from lodestar.sources import files
from lodestar.sources.tables import text_vectors


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first().x


def test_tokenize(spark):
    tok = T.tokenize(F.col("t"))
    assert one(spark, tok, t="Use redis:6379, not C++ v1.2") == ["use", "redis:6379", "not", "c", "v1.2"]
    assert one(spark, tok, t="性") == ["性"]
    assert one(spark, tok, t="性能") == ["性能", "性能"]
    assert one(spark, tok, t="数据库") == ["数据", "据库", "数据库"]
    assert one(spark, tok, t="改用redis缓存系统") == ["改用", "改用", "redis", "缓存", "存系", "系统"]
    assert one(spark, tok, t="") == []


def test_fnv(spark):
    def fnv(text):
        h = 14695981039346656037
        for b in text.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    for text in ("", "a", "hello world", "缓存 x", "é" * 20):
        assert int(one(spark, T.fnv1a(F.col("t")), t=text)) == fnv(text)


def test_vectors(spark):
    def cos(a, b):
        return one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b)

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1
    assert cos([1.0, 0.0], [0.0, 1.0]) == 0
    assert cos([1.0, 0.0], [-1.0, 0.0]) == 0
    assert cos([1.0], [1.0, 2.0]) == 0
    assert cos([0.0, 0.0], [1.0, 2.0]) == 0
    assert one(spark, V.distance(F.col("a"), F.col("b")), a=[0.0, 0.0, 9.0], b=[3.0, 4.0]) == 5


def test_classes(spark):
    def kind(text, labels=("x",)):
        return one(spark, T.memory_class(F.col("t"), F.col("l")), t=text, l=list(labels))

    assert kind("ok") == kind("嗯") == kind("a") == "noise"
    assert kind("Use PostgreSQL instead of SQLite because we need writes", ["decision"]) == "decision"
    assert kind("the root_cause: connection pool never closed") == "bugfix"
    assert kind("just some words about nothing at all") == "general"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_pairs_over_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    few, many = (sorted((r.a, r.b) for r in similar_pairs(rows, 0.9, block).collect()) for block in (1000, 7))
    assert few == many and len(few) == len(set(few)) > 100 and all(a < b < 99 for a, b in few)


def test_traversal(spark):
    rel = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (0, 3, 0.05), (5, 6, 1.0)], "a long, b long, strength double")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.hop for r in G.hops(rel, start, 5).collect()} == {0: 0, 1: 1, 3: 1, 2: 2}
    assert {r.node: round(r.score, 2) for r in G.multi_hop(rel, start, 5).collect()} == {0: 1.0, 1: 0.9, 2: 0.72}
    assert {(r.a, r.b) for r in G.decay(rel, 100).collect()} == {(0, 1), (1, 2), (5, 6)}


def test_chunks():
    text = "One. " * 100 + "\n\n" + "二。" * 90 + "\n\nend"
    found = chunk(text, 200)
    assert all(0 < len(c.encode()) <= 200 for c in found)
    assert "".join("".join(found).split()) == "".join(text.split())
    assert chunk("", 10) == chunk(None, 10) == []


def test_files(spark):
    assert one(spark, files.flatten_json(F.col("t")), t='{"a": 1, "b": {"c": "x", "d": null}, "e": ["p", "", "q"]}') == "a: 1\nb:\n  c: x\ne:\n  p\n  q"
    assert one(spark, files.flatten_json(F.col("t")), t="no json") == "no json"
    assert one(spark, files.csv_text(F.col("t")), t='h1,h2\n1,"x\n2,\n\n,3') == 'h1: 1\nh2: "x\n\nh1: 2\n\nh2: 3'
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    stay, trash = files.delete(rows, spark.createDataFrame([(2,), (3,)], "id long"), 1000)
    assert [r.id for r in stay.collect()] == [1] and trash.count() == 2
    assert sorted(r.id for r in files.restore(stay, trash, [2], 2000).collect()) == [1, 2]
    assert files.restore(stay, trash, [2], 1000 + 31 * 86400).count() == 1
    new = spark.createDataFrame([(2, "z"), (9, "y")], "id long, v string")
    assert sorted(tuple(r) for r in files.upsert(rows, new).collect()) == [(1, "a"), (2, "z"), (3, "c"), (9, "y")]


def test_log_lines(spark):
    line = '203.0.113.5 - - [..] "GET /etc/passwd HTTP/1.1" 404 0'
    assert tuple(one(spark, files.web_log(F.col("t")), t=line)) == ("203.0.113.5", "/etc/passwd", 404)
    assert one(spark, files.web_log(F.col("t")), t="garbage") is None
    line = "sshd: Failed password for invalid user admin from {} port 51823 ssh2"
    assert one(spark, files.login_failure(F.col("t")), t=line.format("203.0.113.9")) == "203.0.113.9"
    assert one(spark, files.login_failure(F.col("t")), t=line.format("10.0.0.5")) is None


def test_words_in_tasks_as_in_expressions(spark):
    """Tokens and vectors that a task makes are those of Spark's expressions, for odd characters too."""
    draw = random.Random(3)
    odd = "aZ09 -_./:\u00e9\u00b2\u00bd\u0345\u0301\u093e\u2160\u3007\u4e2d\u6587\u3042\u30fc\u3002\uac00\u0130\u00df\u03a3\u200b\u00a0\n\U00010400\U0001d7ce\U0001f600\U00020000\U0001f130|'"
    texts = ["".join(draw.choices(odd, k=draw.randrange(30))) for _ in range(500)] + ["\u4e2d", "\u4e2d\u6587", "\u4e2d\u6587\u4e2d", "a\u4e2d\u6587\u4e2d\u6587b", ""]
    tokens = T.tokenizer(T.letters())
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("labels", F.array(F.lit("ab"), F.lit("\u4e2d x")))
    for r in rows.select(F.lower("content").alias("low"), T.tokenize(F.col("content")).alias("tokens")).collect():
        assert tokens(r.low) == r.tokens
    full = rows.withColumns({"ts": F.lit(0), "mass": F.lit(1.0), "access_count": F.lit(0), "importance": F.lit(1.0)})
    asked = ["a", "ab", "z0", "\u4e2d", "\u6587\u4e2d", ".", "-", "\u00e9"]
    for words in (asked, [*asked, "a b", " "]):
        got = {r.id: r for r in I.read_texts(full, words, 0).collect()}
        for r in text_vectors(rows, T.word_set(F.col("content"))).withColumns({"low": F.lower("content"), "tokens": T.tokenize(F.concat_ws(" ", "content", F.array_join("labels", " ")))}).collect():
            x = got[r.id]
            assert x.embedding == r.embedding and x.dl == len(r.tokens) and {words[w] for w in x.low} == {w for w in words if w in r.low}
            assert {words[w]: n for w, n in zip(x.terms, x.tf, strict=True)} == {w: r.tokens.count(w) for w in words if w in r.tokens}
            assert {words[w] for w in x.marks} == {w for w in words if w in "ab \u4e2d x"}
