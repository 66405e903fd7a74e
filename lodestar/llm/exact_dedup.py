"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

* Flush: every scan task is a memtable and writes one sorted run of (digest, length, id), with a Parquet Bloom filter
  and min/max statistics on the digest. No shuffle, and no text moves.
* Compaction: runs are merged by digest in two levels, first within FANOUT tiers of runs, then over all tiers; each
  level is written as sorted runs with filters. The entry with the most code points, then the smallest id, stays. Partial
  aggregation and the tiers leave of a digest that holds a third of all rows a row a task.
* Probe: a bitmap filter over the digests that have several rows is broadcast (at most FILTER_BITS bits, 16 MB; beyond
  some ten million such digests it lets more rows pass, none are lost). Texts that it rules out never move.
* Verification: a row that passes meets the index entry of its digest and is compared, byte for byte, with the text of
  the row that stays. Digests with more than HOT_ROWS rows are dealt to several tasks, each with a copy of that text.
  Rows that differ in spite of equal digests are grouped again by their whole text.

Cases: a null text is empty; texts of white space only equal the empty text; a null id sorts last; repeated rows
with one id and one text are copies of each other, and all carry kept = true if that id stays; of equally long texts with
equal ids either stays; very long texts move whole, and only if another row has their digest; an empty table gives an
empty result; extra columns are ignored by `exact_dedup` and kept by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, fresh, split_by_ids, table, text_of
from lodestar.session import discard, materialize

#: Tiers of runs that the first compaction merges apart.
FANOUT = 8
#: Bits of the broadcast filter for each digest with several rows, and at most.
BITS_EACH = 16
FILTER_BITS = 1 << 27
#: Rows of one digest that a task verifies; at most HOT_DIGESTS digests can have more than their share of rows.
HOT_ROWS = 512
HOT_DIGESTS = 50_000

_FILTERED = {"parquet.bloom.filter.enabled#digest": "true"}


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _run(df: DataFrame, name: str) -> DataFrame:
    """df as sorted runs of digests with filters."""
    return materialize(df.sortWithinPartitions("digest"), name, **_FILTERED)


def merge_index(rows: DataFrame) -> DataFrame:
    """digest, best (length, id and row of the entry that stays) and group_size, from row, doc_id, n_chars, digest."""
    flushed = rows.select("row", "doc_id", "n_chars", "digest", F.spark_partition_id().alias("run"))
    runs = _run(flushed, "dedup-runs")
    entry = F.struct((-F.col("n_chars")).alias("n"), F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "row")
    tiers = runs.groupBy(F.pmod("run", F.lit(FANOUT)).alias("tier"), "digest").agg(
        F.min(entry).alias("best"), F.count("*").alias("group_size")
    )
    tiers = _run(tiers, "dedup-tiers")
    merged = tiers.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    index = _run(merged, "dedup-index")
    discard(runs, tiers)
    return index


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def hit_filter(hits: DataFrame, several: int) -> tuple[DataFrame, int]:
    """The bitmaps (bucket, bitmap) of the digests in hits, and the number of bits."""
    bits = 1 << 15
    while bits < min(BITS_EACH * several, FILTER_BITS):
        bits *= 2
    at = _bit(bits)
    maps = hits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    return maps, bits


def probe(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """Those of the rows whose digest may be in the filter. The filter is broadcast: no row moves."""
    at = _bit(bits)
    found = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "bucket")
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bitmap, place div 8 + 1, 1)")), 16, 10).cast("int")
    found = found.withColumn("place", place).withColumn("byte", byte)
    return found.where("(shiftright(byte, place % 8) & 1) = 1").drop("bucket", "bitmap", "place", "byte")


def resolve(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """row, doc_id, keep_id, keep_row, group_size, sha, digest and mark (the text's hash; null for the only one of its
    digest) for every one of rows (row, doc_id, text); and the tables that it was made of."""
    rows = rows.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.translate("text", SPACES, "").alias("norm"))
    rows = rows.withColumn("digest", digest_of(F.col("norm")))
    index = merge_index(rows)
    sums = index.agg(F.sum("group_size").alias("rows"), F.count_if(F.col("group_size") > 1).alias("several"), F.max("group_size").alias("most")).first()
    out = ["row", "doc_id", "keep_id", "keep_row", "group_size", "sha", "digest", "mark"]
    sha = F.lower(F.hex("digest")).alias("sha")
    kept = [F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"]
    single = index.where("group_size = 1").select(F.col("best.row").alias("row"), F.col("best.id").alias("doc_id"), *kept, sha, "digest", F.lit(None).cast("long").alias("mark"))
    if not sums.several:
        return single, [index]
    entries = hits = index.where("group_size > 1").select("digest", "best", "group_size")
    moved = probe(rows, *hit_filter(hits, sums.several))
    hot_rows, keys = max(HOT_ROWS, sums.rows // HOT_DIGESTS), ["digest"]
    if sums.most > hot_rows:
        hot = F.broadcast(hits.where(F.col("group_size") > hot_rows).select("digest", F.ceil(F.col("group_size") / hot_rows).alias("salts")))
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        moved = moved.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("row", "doc_id", "n_chars"), salts)).drop("salts")
        each = F.sequence(F.lit(0).cast("long"), salts - 1)
        hits = hits.join(hot, "digest", "left").withColumn("salt", F.explode(each)).drop("salts")
        keys.append("salt")
    moved = materialize(moved, "dedup-moved")  # hashed once for both sides of the comparison
    found = moved.join(hits, keys)
    is_kept = F.expr("row = best.row and doc_id <=> best.id and n_chars = -best.n")
    # only the rows that stay move, once to their digest's entry and once with it to the rows of the digest
    names = entries.select(F.xxhash64("digest", "best.row", "best.id", -F.col("best.n")).alias("name"))
    firsts = moved.select("row", "doc_id", "n_chars", "digest", "norm", F.xxhash64("digest", "row", "doc_id", "n_chars").alias("name"))
    firsts = split_by_ids(firsts, "name", names, "name")[0].join(entries, "digest").where(is_kept)
    stays = firsts.groupBy("digest").agg(F.max("norm").alias("keep_norm"))
    if len(keys) > 1:  # the text that stays goes to every task of its digest
        stays = stays.join(hot, "digest", "left").select("digest", "keep_norm", F.explode(each).alias("salt"))
    same = F.coalesce(F.col("norm") == F.col("keep_norm"), F.lit(False)).alias("same")
    mark = F.xxhash64("norm").alias("mark")
    checked = found.join(stays, keys, "left").select("row", "doc_id", *kept, sha, "digest", mark, same)
    checked = materialize(checked, "dedup-hits")
    discard(moved)
    clash = checked.where("not same").select("digest").distinct()
    if clash.isEmpty():
        return single.unionByName(checked.select(*out)), [index, checked]
    texts = rows.join(clash, "digest")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "row"))
    again = texts.groupBy("digest", "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    apart = texts.join(again, ["digest", "norm"]).select("row", "doc_id", *kept, F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "digest", mark)
    return single.unionByName(checked.join(clash, "digest", "left_anti").select(*out)).unionByName(apart), [index, checked]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return resolve(rows)[0].select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay. A row is named by its id, digest and hash of
    the text; of rows of one id and text the longest stays, whichever of several."""
    norm = F.translate(text_of(text_col), SPACES, "")
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found, made = resolve(rows)
    size = F.count("*").alias("size")
    several = found.where("group_size > 1").groupBy("doc_id", "keep_id", "digest", "mark").agg(size)
    several = materialize(several.where("size > 1 or not doc_id <=> keep_id"), "dedup-gone")
    discard(*made)
    key = [fresh(docs, name) for name in ("gone_id", "gone_digest", "gone_mark")]
    named = several.select("size", F.expr("doc_id <=> keep_id").alias("stays"), *(F.col(c).alias(k) for c, k in zip(("doc_id", "digest", "mark"), key)))
    same = F.col(id_col).eqNullSafe(F.col(key[0])) & (digest_of(norm) == F.col(key[1])) & (F.xxhash64(norm) == F.col(key[2]))
    gone = named.drop("size", "stays")
    doubtful, clear = split_by_ids(docs, id_col, gone, key[0])  # only the texts of doubtful rows move
    left = clear.unionByName(doubtful.join(gone, same, "left_anti"))
    again = named.where("stays").drop("size", "stays")
    if again.isEmpty():
        return left
    first = fresh(docs, "first")
    order = Window.partitionBy(id_col, F.sha2(norm.cast("binary"), 256)).orderBy(F.desc(F.length(text_col)))
    once = doubtful.join(again, same, "left_semi").withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(first)
    return left.unionByName(once)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
