"""The pipeline's stages take effect, keep the columns, and leave clean documents alone."""

import collections
import random
import re
import time

import pytest

import corpus_pipeline
from lodestar.llm import common
from lodestar.session import materialize


def test_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact_copies", "near_copies", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["near_copies"]) <= set(seen["exact_copies"]) <= set(seen["language"]) <= set(seen["toxicity"])
    plain = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", "", t) for t in seen["exact_copies"].values())
    assert max(plain.values()) == 1
    assert len(plain) == len({re.sub(r"[\x20\x09-\x0D]+", "", t) for t in seen["language"].values()})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(seen["near_copies"])
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def odd_folder(spark, sf_dir, folder, rows):
    """A folder of tables whose documents are the given ones and those of folder, with columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], schema)
    docs = own.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(own.columns)) if rows else own
    names = "row component node text_sha256 keep_id score level draw fold".split()
    docs.withColumns({n: own_value for n, own_value in zip(names, [docs.doc_id] * len(names), strict=True)}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_odd_rows(spark, sf_dir, tmp_path):
    """Null, empty, very long, repeated and copied texts, null ids, extra columns of clashing names."""
    import corpus_pipeline

    plain = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) between 400 and 4000").orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"{plain[0][: 300 + i % 7]}" for i in range(900))
    rows = [
        (9000, None, "en"), (9001, "", "en"), (9002, " \n ", None), (9003, "12 34 !!", "en"), (9004, long, None),
        (9005, plain[1] + " and here ends another text", "en"), (9005, plain[1] + " and here ends another text", "en"), (9006, plain[1] + " and here  ends another\ntext", "fr"),
        (None, plain[2] + " of a row without an id", "en"), (None, None, None),
    ]
    folder = odd_folder(spark, sf_dir, str(tmp_path / "odd"), rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept = collections.Counter(r.doc_id for r in docs.select("doc_id").where("doc_id is null or doc_id >= 9000").collect())
        if name == "toxicity":
            assert kept == collections.Counter(i for i, _, _ in rows)
        elif name == "language":
            assert kept == {9004: 1, 9005: 2, 9006: 1, None: 1}
    assert kept[9004] == 1 and kept[9006] == 0 and kept[9005] <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline

    folder = odd_folder(spark, sf_dir, str(tmp_path / "empty"), [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def moved_bytes(spark, make) -> int:
    """What a function shuffles, with joins as over large tables: none is broadcast for the size of its sides."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.5)
        return sum(x.totalShuffleWrite() for x in spark.sparkContext._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))

    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return written() - before


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """2,000 texts of 300 drawn words, no two of them alike, and a copy of each hundredth; with the characters of all."""
    draw = random.Random(8)
    rows = [(i, " ".join(f"{draw.getrandbits(40):010x}" for _ in range(300))) for i in range(2000)]
    rows += [(5000 + i, text) for i, text in rows[::100]]
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path), sum(len(t) for _, t in rows)


def test_exact_copies_move_few_texts(spark, many):
    docs, size = many
    left = []
    moved = moved_bytes(spark, lambda: left.extend(r.doc_id for r in corpus_pipeline.exact_copies(spark, docs, "").select("doc_id", "text").collect()))
    assert sorted(left) == list(range(2000))
    assert moved < 0.2 * size


def test_near_copies_move_postings_once(spark, many):
    docs, size = many
    left = []
    moved = moved_bytes(spark, lambda: left.extend(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").select("doc_id", "text").collect()))
    assert sorted(left) == list(range(2000))
    assert moved < 45 * 2020 * 61  # bytes for each of a text's 61 postings


def test_rows_whose_id_may_be_among_ids(spark):
    ids = [i * 7 for i in range(500)] + [None]
    rows = [(i, f"t{i}", i, i) for i in range(20_000)] + [(None, "none", 0, 0), (7, "again", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket long, Bitmap long")
    among, rest = common.split_by_ids(docs, "doc_id", spark.createDataFrame([(i,) for i in ids], "gone long"), "gone")
    assert among.columns == rest.columns == docs.columns
    among, rest = [tuple(r) for r in among.collect()], [tuple(r) for r in rest.collect()]
    assert sorted(map(str, among + rest)) == sorted(map(str, rows))
    assert not [r for r in rest if r[0] in set(ids)]
    assert len(among) < 502 + 0.05 * 20_000
    none, all_rows = common.split_by_ids(docs, "doc_id", spark.createDataFrame([], "gone long"), "gone")
    assert none.count() == 0 and all_rows.count() == len(rows)
