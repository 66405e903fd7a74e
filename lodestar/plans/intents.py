"""Queries that read what a text asks for or gives as its reason, and check what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.plans.rules import _CLASS, _lit
from lodestar.sources.tables import MEMORIES, memories


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory read as a query: labels that it favours, words to widen by, words to leave out."""
    text = F.col("content")
    return memories(spark, sf_dir).select(
        "id",
        F.array_join(T.favoured(text), ",").alias("favoured"),
        F.array_join(T.widened(text), ",").alias("widened"),
        F.array_join(T.excluded(text), ",").alias("excluded"),
    )


_LIST = lambda x: f"coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"
_FAVOURED = ", ".join(f"CASE WHEN contains(text, {_lit(w)}) THEN {_lit(x)} END" for w, x in T.FAVOURED)
_WIDENED = ", ".join(f"CASE WHEN contains(text, {_lit(w)}) THEN {x.split()} ELSE []::VARCHAR[] END" for w, x in T.WIDENED.items())
_EXCLUDED = ", ".join(f"nullif(regexp_extract(text, '{w}([a-z0-9]{{2,}})', 1), '')" for w in T.EXCLUDING)
QUERY_INTENT = f"""WITH {MEMORIES}, t AS (SELECT id, lower(content) AS text FROM memories)
SELECT id, {_LIST(f"[{_FAVOURED}]")} AS favoured, {_LIST(f"flatten([{_WIDENED}])")} AS widened, {_LIST(f"[{_EXCLUDED}]")} AS excluded FROM t"""


def stated_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that decisions, findings and patterns give."""
    rows = memories(spark, sf_dir).withColumn("class", T.memory_class(F.col("content"), F.col("labels")))
    return rows.select("id", "class", T.reason(F.col("content"), F.col("class")).alias("reason")).where("reason is not null")


_REASON = " ".join(f"WHEN contains(lower(content), {_lit(w)}) THEN trim(substr(content, instr(lower(content), {_lit(w)}), 250))" for w in T.CAUSAL)
STATED_REASONS = f"""WITH {MEMORIES}, c AS (SELECT *, {_CLASS} AS class FROM memories),
r AS (SELECT id, class, CASE WHEN class NOT IN ('decision', 'finding', 'pattern') THEN NULL
WHEN contains(lower(content), 'rationale:') THEN trim(substr(content, instr(lower(content), 'rationale:') + 10, 300)) {_REASON} END AS reason FROM c)
SELECT * FROM r WHERE reason IS NOT NULL"""


def intake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether content and labels may come in: not blank, at most 10000 bytes; at most ten labels of allowed characters."""
    size = F.octet_length("content")
    fits = F.forall("labels", lambda x: (F.octet_length(x) <= 64) & x.rlike(r"^[A-Za-z0-9_. \-]+$"))
    rows = memories(spark, sf_dir)
    return rows.select(
        "id",
        ((F.trim("content") != "") & (size <= 10000)).alias("content_ok"),
        ((F.size("labels") <= 10) & fits).alias("labels_ok"),
        F.substring("content", 1, 80).alias("preview"),
    )


INTAKE_CHECKS = rf"""WITH {MEMORIES} SELECT id, trim(content) <> '' AND strlen(content) <= 10000 AS content_ok,
len(labels) <= 10 AND len(list_filter(labels, lambda x: strlen(x) > 64 OR NOT regexp_full_match(x, '[A-Za-z0-9_. \-]+'))) = 0 AS labels_ok,
substr(content, 1, 80) AS preview FROM memories"""

NAMES = "query_intent stated_reasons intake_checks".split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
