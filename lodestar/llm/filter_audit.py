"""How document filters interact: what each removes in every order in which they can be applied.

Each document fails some of the filters A to E, which is a mask of five bits; documents with the same mask behave alike.
So the table shrinks to cells of (part, mask) with the number of documents in it, of good and of toxic ones, and each
cell is folded across the array of all 120 orders: `transform` over the orders and `aggregate` over the five filters of
an order give 600 structs, weighted by the cell's counts. The cells of a part, 32 at most, are merged by elementwise sums.
Everything behind the cells is of fixed size a part, whatever the number of documents.

Texts are read once, and what is known of each goes into a table of ids, parts, masks and SHA-256 digests. A text that
a smaller id has too is found by its digest: the least id of every digest comes from an aggregate with partial sums, and
meets the rows again by digest and id, so a group of copies with a third of all rows stays spread over all tasks.

Cases: a null text is empty; a null lang is the part of the empty string; a row without an id is nobody's copy, makes
none, and has no labels; repeated rows of one id don't fail E through each other and each count; labels of an id that
come more than once are good or toxic if one of them says so; very long texts are read where they lie; parts without
documents don't occur, steps that remove nothing are rows of zeros; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import SPACES, table, text_of
from lodestar.session import materialize

FILTERS = "ABCDE"
#: All orders of the filters, as numbers of bits.
ORDERS = list(permutations(range(len(FILTERS))))
COPY = 1 << FILTERS.index("E")
FEW_WORDS, DISTINCT_SHARE, UPPER_SHARE, MARKS = 200, 50, 3, "[#$%&*|]"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that the text fails."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    some = trimmed != ""
    n, distinct = F.when(some, F.size(words)).otherwise(0), F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        n < FEW_WORDS,
        distinct * 100 < n * DISTINCT_SHARE,
        upper.cast("long") * 100 > F.length(text).cast("long") * UPPER_SHARE,
        text.rlike(MARKS),
    )
    out = F.lit(0)
    for bit, failed in enumerate(fails):
        out = out + F.when(failed, 1 << bit).otherwise(0)
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of all failed filters), good, toxic of every row of docs."""
    text = text_of("text")
    facts = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures(text).cast("int").alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    facts = materialize(facts, "filter-facts")
    named = facts.where("doc_id is not null")
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    marks = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    seen = named.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    mark = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    known = seen.select(
        "part",
        F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + COPY).alias("mask"),
        mark("quality").alias("good"),
        mark("toxic").alias("toxic"),
    )
    nameless = facts.where("doc_id is null").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless)


def fold(cell: Column) -> Column:
    """600 structs of COUNTS: the cell (mask, n, good, toxic) after every step of every order."""
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        mine = F.element_at(F.lit([1 << b for b in range(len(FILTERS))]), bit + 1)
        failed, alive = cell["mask"].bitwiseAND(mine) != 0, state["alive"]
        count = lambda when, n: F.when(when, n).otherwise(zero)
        values = (
            count(alive & ~failed, cell["n"]),
            count(alive & failed, cell["n"]),
            count(~alive & failed, cell["n"]),
            count(cell["mask"] == mine, cell["n"]),
            count(alive & failed, cell["good"]),
            count(alive & failed, cell["toxic"]),
        )
        made = F.struct(*(v.alias(c) for v, c in zip(values, COUNTS, strict=True)))
        return F.struct((alive & ~failed).alias("alive"), F.concat(state["steps"], F.array(made)).alias("steps"))

    empty = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), empty.alias("steps"))
    orders = F.lit([list(o) for o in ORDERS])
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS, shapley of cells of part, mask, n, good, toxic."""
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zeros = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), len(ORDERS) * len(FILTERS))
    add = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
    merged = F.aggregate("cells", zeros, lambda sums, cell: F.zip_with(sums, fold(cell), add))
    steps = per_part.select("part", merged.alias("steps"))
    bits = F.lit([bit for order in ORDERS for bit in order])
    removed = F.zip_with("steps", bits, lambda s, bit: F.struct(s["removed"].alias("n"), bit.alias("bit")))
    total = lambda bit: F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + F.when(x["bit"] == bit, x["n"]).otherwise(0))
    shares = steps.withColumn("shapley", F.array(*map(total, range(len(FILTERS)))))
    rows = shares.select("part", "shapley", F.posexplode("steps").alias("at", "s"))
    names = F.lit(["".join(FILTERS[b] for b in order) for order in ORDERS])
    return rows.select(
        "part",
        F.element_at(names, F.floor(F.col("at") / len(FILTERS)).cast("int") + 1).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
        *(F.col(f"s.{c}").alias(c) for c in COUNTS),
        F.element_at("shapley", F.element_at(bits, F.col("at") + 1) + 1).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over all rows of docs, a row per part, order and step."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return audit(cells)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_FAIL = " + ".join(f"{c}::INTEGER * {1 << b}" for b, c in enumerate("abcde"))
_SPACES = r"[^\x20\x09-\x0D]+"
OP12_SQL = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
 regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS words FROM documents),
x AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {_FAIL} AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
 FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order FROM f p, f q, f r, f s, f t
 WHERE len(list_distinct([p.letter, q.letter, r.letter, s.letter, t.letter])) = 5),
k AS (SELECT filter_order, step::INTEGER AS step, letter, bit,
 (SELECT coalesce(sum(y.bit), 0) FROM f y WHERE contains(substr(filter_order, 1, step - 1), y.letter)) AS earlier
 FROM o, range(1, 6) i(step) JOIN f ON letter = substr(filter_order, step, 1)),
s AS (SELECT part, filter_order, step, letter,
 sum(CASE WHEN mask & earlier::INTEGER = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
 sum(CASE WHEN mask & earlier::INTEGER = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN mask & earlier::INTEGER > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN mask & earlier::INTEGER = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN mask & earlier::INTEGER = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s"""
