"""New memories against the stored ones and against those that come in before them: what is noise, what repeats or
contradicts which text, what goes in.

The rule is sequential: a row's three most similar rows are looked for among the stored ones and the rows of its batch
that have gone in before it. Here it runs in rounds over the whole batch. A row keeps its three nearest stored rows and
its LIST nearest earlier rows of the batch; it is decided as soon as the decisions about those that matter are known,
and in each round every row is whose neighbours were decided in the round before. The row with the lowest id always is.
A row whose list is used up by rows that turned out to repeat others gets a new list without these. Lists are short, so
a batch of which a third is one text makes no more pairs than another.

Similarity is the cosine of the embeddings; a row without one repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.nearest import nearest
from lodestar.session import discard, materialize

NEAR, SAME = 0.75, 0.85
CHECKED, LIST = 3, 8
MOST_BYTES, MOST_LABELS, LABEL_BYTES = 10_000, 10, 64

COLUMNS = ("id", "content", "labels", "embedding")


def accepted_form(rows: DataFrame) -> DataFrame:
    """rows with valid, class, importance, rationale, and the labels that the class and the tags add."""
    content = F.col("content")
    fits = F.forall("labels", lambda x: (F.octet_length(x) <= LABEL_BYTES) & (F.trim(x) != ""))
    valid = (F.trim(content) != "") & (F.octet_length(content) <= MOST_BYTES) & (F.size("labels") <= MOST_LABELS) & fits
    classed = rows.withColumns({"valid": F.coalesce(valid, F.lit(False)), "class": T.memory_class(content, F.col("labels"))})
    own = F.when(F.col("class") == "general", F.array().cast("array<string>")).otherwise(F.array("class"))
    return classed.withColumns(
        {
            "importance": T.intake_importance(content, F.col("class")),
            "rationale": T.reason(content, F.col("class")),
            "labels": F.array_union(F.array_union("labels", own), T.tags(content)),
        }
    )


def _judged(pairs: DataFrame, new: DataFrame, others: DataFrame, history: bool) -> DataFrame:
    """pairs (a, b, similarity) with repeats and corrects: whether row a repeats text b or corrects it."""
    side = lambda rows, name: rows.select(
        F.col("id").alias(name),
        F.octet_length("content").alias(f"size_{name}"),
        T.word_list(F.col("content")).alias(f"words_{name}"),
        *([T.any_contained(F.lower("content"), T.INTAKE_DENIALS).alias("denies")] if name == "a" else []),
    )
    met = pairs.join(side(new, "a"), "a").join(side(others, "b"), "b")
    met = met.withColumn("set_b", F.array_distinct("words_b"))
    own = F.array_distinct("words_a")
    alike = F.when((F.size(own) == 0) | (F.size("set_b") == 0), 0.0).otherwise(T.jaccard(own, F.col("set_b")))
    threshold = F.lit(0.55) if history else F.when(F.col("size_a") < 30, 0.80).otherwise(0.55)
    share = T.topic_overlap(F.col("words_a"), F.col("set_b"))
    corrects = F.lit(False) if history else F.col("denies") & (share > 0.4)
    return met.select(
        "a",
        "b",
        "similarity",
        ((F.col("similarity") > SAME) & (F.col("size_b") > 20) & (alike > threshold)).alias("repeats"),
        F.coalesce(corrects, F.lit(False)).alias("corrects"),
    )


def _decide(neighbours: Column) -> Column:
    """(taken, original, conflicts, open) after walking a list of (similarity, b, repeats, corrects, state), nearest first.
    state: 1 is in, 0 not decided yet, -1 didn't go in."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("taken"), F.lit(None).cast("bigint").alias("original"), none.alias("conflicts"), F.lit(False).alias("open"))

    def step(s: Column, n: Column) -> Column:
        over = s["open"] | (s["taken"] >= CHECKED) | s["original"].isNotNull() | (n["state"] == -1)
        in_ = ~over & (n["state"] == 1)
        return F.struct(
            F.when(in_, s["taken"] + 1).otherwise(s["taken"]).alias("taken"),
            F.when(in_ & n["repeats"], n["b"]).otherwise(s["original"]).alias("original"),
            F.when(in_ & n["corrects"], F.array_append(s["conflicts"], n["b"])).otherwise(s["conflicts"]).alias("conflicts"),
            (s["open"] | ~over & (n["state"] == 0)).alias("open"),
        )

    return F.aggregate(neighbours, start, step)


def ingest(stored: DataFrame, batch: DataFrame, history: bool = False) -> DataFrame:
    """One row for every row of batch (id, content, labels, embedding), taken in the order of ids, against stored (the same
    columns): outcome (in, repeat, noise, invalid), original (the row that it repeats), conflicts (rows that it corrects),
    and class, importance, rationale and labels as they go in. history: rows of the past, for which the threshold of
    short texts and the conflicts don't hold.

    Ids are distinct and not null. A null content is invalid, a null embedding repeats nothing; an empty batch gives an
    empty result."""
    rows = materialize(accepted_form(batch.select(*COLUMNS)), "ingest-batch")
    new = rows.where("valid and class <> 'noise'").select("id", "content", "embedding")
    old = nearest(new, stored, CHECKED, NEAR)
    old = materialize(_judged(old, new, stored, history).withColumns({"end": F.lit(False), "state": F.lit(1)}), "ingest-stored")
    decided = materialize(new.select("id", F.lit(None).cast("bigint").alias("original"), F.array().cast("array<bigint>").alias("conflicts")).limit(0), "ingest-decided")
    left, done = new.count(), 0
    while done < left:
        gone = decided.where("original is not null").select("id")
        waiting = new.join(decided.select("id"), "id", "left_anti")
        near = nearest(waiting, new.join(gone, "id", "left_anti"), LIST, NEAR, earlier=True)
        near = _judged(near, new, new, history)
        # behind the last of a full list there may be more: whoever gets there waits for the next list
        last = near.groupBy("a").agg(F.max(F.struct((-F.col("similarity")).alias("far"), "b")).alias("last"), F.count("*").alias("n"))
        no = F.lit(False)
        end = last.where(F.col("n") == LIST).select("a", "last.b", (-F.col("last.far")).alias("similarity"), no.alias("repeats"), no.alias("corrects"))
        lists = near.withColumn("end", no).unionByName(end.withColumn("end", F.lit(True)))
        lists = materialize(lists, "ingest-lists")
        before = -1
        while before < done < left:
            before = done
            rest = new.join(decided.select("id"), "id", "left_anti").select(F.col("id").alias("a"))
            state = decided.select(F.col("id").alias("b"), F.when(F.col("original").isNull(), 1).otherwise(-1).alias("known"))
            known = lists.join(state, "b", "left").withColumn("state", F.when(F.col("end"), 0).otherwise(F.coalesce("known", F.lit(0)))).drop("known")
            entry = F.struct((-F.col("similarity")).alias("far"), "b", "end", "repeats", "corrects", "state")
            walked = known.unionByName(old).join(rest, "a", "left_semi").groupBy("a").agg(F.array_sort(F.collect_list(entry)).alias("list"))
            found = rest.join(walked, "a", "left").withColumn("list", F.coalesce("list", F.array().cast(walked.schema["list"].dataType)))
            settled = found.withColumn("s", _decide(F.col("list"))).where("not s.open").select(F.col("a").alias("id"), "s.original", "s.conflicts")
            now = materialize(decided.unionByName(settled), "ingest-decided")
            discard(decided)
            decided, done = now, now.count()
        discard(lists)
    result = rows.join(decided, "id", "left")
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("class") == "noise", "noise").when(F.col("original").isNotNull(), "repeat").otherwise("in")
    shown = lambda name: F.when(F.col("outcome") == "in", F.col(name)).alias(name)
    return result.withColumn("outcome", outcome).select(
        "id", "outcome", "original", F.array_sort(F.when(F.col("outcome") == "in", F.col("conflicts"))).alias("conflicts"),
        "class", shown("importance"), shown("rationale"), shown("labels"),
    )
