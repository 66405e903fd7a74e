"""Document fingerprints as invertible Bloom lookup tables, in DataFrame operations only.

A text's paragraphs (pieces that end at a line break or at the end of a sentence) are hashed; each distinct digest is
put into one cell of each of three subtables. A cell holds a count, the xor of its digests and the xor of their
check sums. The cells of two versions subtract, which leaves the digests that only one of them has; cells that hold
a single digest are peeled, one subtable at a time, until nothing is left. Pairs that don't come out are sketched
anew at twice the size. Likeness is the Jaccard similarity of the two sets of digests: the number of recovered
digests and the sizes of the sets give it exactly.

The fingerprint proper is the table of BASE_CELLS cells, written out with the number of digests.

Neighbours by id meet without a window over the whole table: ids are cut into buckets at quantiles, and the first
row of a bucket is copied into the bucket before it. Everything after that one shuffle stays within a bucket.

Cases: a null text is empty and has no digests; two empty sets are alike (1); rows are taken in ascending order of
id (null first), then text; a text that follows itself (one row) is its own next; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import table, text_of
from lodestar.session import materialize, shared_folder

BASE_CELLS = 12
TASK_BYTES = 1_500_000
ROUNDS = 6
RETRIES = 8

_BREAK = r"[.!?] +|[ \t\r]*\n\s*"


def _hash(key: Column, *salt: int) -> Column:
    return F.xxhash64(key, *map(F.lit, salt))


def paragraphs(text: Column) -> Column:
    """Distinct digests of the text's paragraphs."""
    return F.array_distinct(F.transform(F.filter(F.split(text, _BREAK), lambda p: p != ""), lambda p: F.xxhash64(p)))


def base_table(digests: Column) -> Column:
    """The fingerprint as text: the number of digests and, per cell, count, xor of digests and xor of check sums."""
    size = BASE_CELLS // 3

    def cell(j: Column) -> Column:
        own = F.filter(digests, lambda d: F.pmod(F.xxhash64(d, F.floor(j / size)), F.lit(size)) == j % size)
        xor = F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))
        check = F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(_hash(d, 99)))
        return F.concat(F.hex(F.size(own)), F.lit(":"), F.hex(xor), F.lit(":"), F.hex(F.shiftrightunsigned(check, 32)))

    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BASE_CELLS - 1).cast("long")), cell)
    return F.concat_ws(",", F.hex(F.size(digests)), cells)


def _bucket(cuts: list[int]) -> Column:
    """Number of cuts (sorted) up to the id, less one; looked up in two steps, so the cost is the root of their number."""
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    coarse = F.greatest(upto(F.lit([g[0] for g in groups]).cast("array<long>")), F.lit(1))
    fine = upto(F.element_at(F.array(*(F.lit(g).cast("array<long>") for g in groups)), coarse))
    return F.greatest((coarse - 1) * step + fine - 1, F.lit(0))


def with_next(rows: DataFrame) -> tuple[DataFrame, int]:
    """bucket, row, doc_id, text and the text of the row after it, for the last the first's; the number of tasks."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least")).first()
    # Sketches of a text take many times its size while they are built: tasks are small, and aren't put together again.
    tasks = max((size.bytes or 0) // TASK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(tasks, 16_384)
    parts = min(16_384, 4 * tasks)
    cuts: list[int] = []
    if size.least is not None:
        shares = [i / parts for i in range(parts)]
        cuts = sorted({size.least, *rows.agg(F.percentile_approx("doc_id", shares, 4 * parts).alias("p")).first().p})
    bucket = F.coalesce(_bucket(cuts), F.lit(0)) if cuts else F.lit(0)
    # Copies of the first rows of a bucket go to the bucket before it, those of all to the last; null ids come first.
    starts = F.array_contains(F.lit(cuts).cast("array<long>"), F.col("doc_id")) if cuts else F.lit(False)
    first = F.coalesce(F.col("doc_id") == F.lit(size.least), F.lit(True)) if cuts else F.lit(True)
    before = F.when(first, F.lit(max(0, len(cuts) - 1))).when(starts, F.col("own") - 1)
    place = lambda at, copy: F.struct(at.cast("int").alias("bucket"), F.lit(copy).alias("copy"))
    places = F.when(before.isNull(), F.array(place(F.col("own"), False))).otherwise(
        F.array(place(F.col("own"), False), place(before, True))
    )
    dealt = (
        rows.withColumn("own", bucket)
        .withColumn("at", F.explode(places))
        .select("at.bucket", "at.copy", "doc_id", "text")
        .repartition(tasks, "bucket")
    )
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    found = dealt.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    return found.where("not copy").drop("copy"), tasks


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder that later aggregations by the column read without a shuffle."""
    name = f"lodestar_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


_KEY = ["bucket", "row", "pair", "m", "cell"]


def _merge(cells: DataFrame) -> DataFrame:
    """Cells that meet add up; empty ones go."""
    summed = cells.groupBy(*_KEY).agg(
        F.sum("n").alias("n"), F.expr("bit_xor(digest)").alias("digest"), F.expr("bit_xor(check)").alias("check")
    )
    return summed.where("cell < 0 or n <> 0 or digest <> 0 or check <> 0")


def sketch_difference(pairs: DataFrame) -> DataFrame:
    """Cells of the difference of two sketches, for rows of bucket, row, pair, m (cells of a subtable), own, other."""
    signed = lambda side, n: F.transform(side, lambda d: F.struct(d.alias("digest"), F.lit(n).cast("long").alias("n")))
    units = pairs.select("bucket", "row", "pair", "m", F.explode(F.concat(signed("own", 1), signed("other", -1))).alias("u"))
    units = units.select("bucket", "row", "pair", "m", "u.n", "u.digest", _hash(F.col("u.digest"), 99).alias("check"))
    cells = F.array(*(_cell(F.col("digest"), j) for j in range(3)))
    return _merge(units.withColumn("cell", F.explode(cells)))


def _cell(digest: Column, j: int) -> Column:
    return F.lit(j) * F.col("m") + F.pmod(_hash(digest, j), F.col("m"))


def peel(cells: DataFrame, rounds: int) -> DataFrame:
    """After some rounds over the subtables: under cell -1 the number of recovered digests, and the cells left.

    Within one subtable a digest has one cell, so none is taken twice in a step; a step is an explode and an
    aggregate by the same keys, without a shuffle."""
    for step in range(3 * rounds):
        j = step % 3
        pure = (F.floor(F.col("cell") / F.col("m")) == j) & (F.abs("n") == 1) & (_hash(F.col("digest"), 99) == F.col("check"))
        row = lambda cell, n, digest, check: F.struct(
            cell.cast("long").alias("cell"), n.alias("n"), digest.alias("digest"), check.alias("check")
        )
        same = row(F.col("cell"), F.col("n"), F.col("digest"), F.col("check"))
        zero = F.lit(0).cast("long")
        off = [row(_cell(F.col("digest"), k), -F.col("n"), F.col("digest"), F.col("check")) for k in range(3) if k != j]
        found = row(F.lit(-1), F.lit(1).cast("long"), zero, zero)
        out = F.when(pure, F.array(*off, found)).otherwise(F.array(same))
        cells = _merge(cells.select("bucket", "row", "pair", "m", F.explode(out).alias("c")).select("bucket", "row", "pair", "m", "c.*"))
    return cells


def compare(sides: DataFrame, grow: float) -> DataFrame:
    """bucket, row, and per pair the number of digests in one set only (null: not recovered at this size).

    sides: bucket, row, own, and others, an array of the sets to compare with (null: none)."""
    pairs = sides.select("bucket", "row", "own", F.posexplode("others").alias("pair", "other")).where("other is not null")
    # Neighbours have next to nothing in common, an edited text about half; peeling needs 1.23 cells a digest at least.
    cells = F.when(F.col("pair") == 0, grow).otherwise(1.4 * grow) * (F.size("own") + F.size("other"))
    m = (F.ceil(cells / 3) + 3).cast("long")
    left = peel(sketch_difference(pairs.withColumn("m", m)), ROUNDS)
    per = lambda k, of: F.coalesce(F.sum(F.when((F.col("pair") == k) & of, F.col("n"))), F.lit(0))
    rest = lambda k: F.sum(F.when((F.col("pair") == k) & (F.col("cell") >= 0), 1).otherwise(0))
    found = left.groupBy("bucket", "row").agg(*(F.when(rest(k) == 0, per(k, F.col("cell") < 0)).alias(f"d{k}") for k in (0, 1)))
    return found


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.expr("left(next_text, int(floor(length(text) / 2)))"))
    beside, tasks = with_next(rows)
    base = bucketed(
        beside.withColumn("edited", edited).select(
            "bucket",
            "row",
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha"),
            paragraphs(F.col("text")).alias("own"),
            F.array(paragraphs(F.col("edited")), paragraphs(F.col("next_text"))).alias("others"),
        ),
        "bucket",
        tasks,
    )
    # per pair the number of digests in one set only; null: not recovered yet
    state = materialize(compare(base, 1.0), "fingerprint-pairs")
    open_ = F.col("d0").isNull() | F.col("d1").isNull()
    done, left, grow = [state.where(~open_)], state.where(open_), 2.0
    for _ in range(RETRIES):
        if left.isEmpty():
            break
        waiting = F.transform("others", lambda x, i: F.when(F.when(i == 0, F.col("d0")).otherwise(F.col("d1")).isNull(), x))
        sides = base.join(left, ["bucket", "row"]).select("bucket", "row", "own", waiting.alias("others"))
        found = compare(sides, grow).select("bucket", "row", F.col("d0").alias("e0"), F.col("d1").alias("e1"))
        # a pair that was solved before stays so; one that wasn't has cells, so it is in found
        left = left.join(found, ["bucket", "row"]).withColumns({f"d{k}": F.coalesce(f"d{k}", f"e{k}") for k in (0, 1)}).drop("e0", "e1")
        left = materialize(left, "fingerprint-pairs")
        done.append(left.where(~open_))
        left, grow = left.where(open_), grow * 2
    else:
        if not left.isEmpty():
            raise RuntimeError("sketches could not be peeled")
    solved = done[0]
    for more in done[1:]:
        solved = solved.unionByName(more)
    # a document whose two pairs are of equal sets leaves no cell at all, and isn't in solved
    joined = base.join(solved, ["bucket", "row"], "left").withColumns({f"d{k}": F.coalesce(f"d{k}", F.lit(0)) for k in (0, 1)})
    sizes = [F.size("own"), F.size(F.col("others")[0]), F.size(F.col("others")[1])]

    def near(k: int) -> Column:
        both = sizes[0] + sizes[k + 1]
        return F.when(both == 0, 1.0).otherwise((both - F.col(f"d{k}")) / (both + F.col(f"d{k}")))

    return joined.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        base_table(F.col("own")).alias("fingerprint"),
        base_table(F.col("others")[0]).alias("edited_fingerprint"),
        near(0).alias("near_edited"),
        near(1).alias("near_next"),
    )


def op2_fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
