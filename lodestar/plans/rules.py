"""Queries that classify, score and age memories by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.retrieval import noise_label, top_per_key
from lodestar.sources.tables import AS_OF, MEMORIES, PLAIN_MEMORIES, memories, read, spread


def _age() -> Column:
    return (F.lit(AS_OF) - F.col("ts")) / 86400.0


def _lit(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")"


def _count(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {_lit(w)})::INTEGER" for w in words) + ")"


_AGE = f"(({AS_OF} - ts) / 86400.0::DOUBLE)"


def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every memory by keywords, labels and length."""
    rows = memories(spark, sf_dir)
    return rows.select("id", F.round(T.importance(F.col("content"), F.col("labels")), 6).alias("importance"))


IMPORTANCE_SCORE = f"""WITH {MEMORIES}, t AS (SELECT *, lower(content) AS text, strlen(content) AS size FROM memories)
SELECT id, round(least(greatest(1.0::DOUBLE + 0.3 * {_count("text", T.HIGH_VALUE)} - 0.3 * {_count("text", T.LOW_VALUE)}
 - 0.5 * list_contains(labels, 'junk')::INTEGER
 + CASE WHEN size > 1500 THEN 0.5 WHEN size > 500 THEN 0.2 WHEN size < 30 THEN -0.2 ELSE 0 END, 0.1), 3.0), 6) AS importance FROM t"""


def intake_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every memory at intake, and its importance by that class."""
    rows = spread(memories(spark, sf_dir)).select("id", "content", T.memory_class(F.col("content"), F.col("labels")).alias("class"))
    return rows.select("id", "class", F.round(T.intake_importance(F.col("content"), F.col("class")), 6).alias("importance"))


_CLASS = (
    f"CASE WHEN strlen(trim(content)) < 5 OR strlen(trim(content)) < 20 AND lower(trim(content)) IN ({', '.join(map(_lit, T.NOISE_WORDS))}) THEN 'noise' "
    + " ".join(
        f"WHEN {_any('lower(trim(content))', words)}"
        + (" OR starts_with(lower(trim(content)), 'v') AND contains(lower(trim(content)), '实验')" if name == "experiment" else "")
        + f" THEN '{name}'"
        for name, words in T.CONTENT_CLASSES
    )
    + " ELSE 'general' END"
)
INTAKE_CLASS = f"""WITH {MEMORIES}, c AS (SELECT *, lower(content) AS text, {_CLASS} AS class FROM memories)
SELECT id, class, round(least(greatest((CASE class {" ".join(f"WHEN '{k}' THEN {v}" for k, v in T.CLASS_BASE.items())} END)::DOUBLE
 + CASE WHEN {_any("text", T.CRUCIAL)} THEN 0.5 WHEN {_any("text", T.NOTABLE)} THEN 0.3 ELSE 0 END
 + CASE WHEN strlen(content) > 200 THEN 0.2 WHEN strlen(content) > 50 THEN 0.1 ELSE 0 END
 + CASE WHEN {_any("text", T.CODE_MARKS)} THEN 0.1 ELSE 0 END, 0.1), 3.5), 6) AS importance FROM c"""


def memory_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every memory, joined by commas."""
    return memories(spark, sf_dir).select("id", F.array_join(T.tags(F.col("content")), ",").alias("tags"))


_TAGS = ", ".join(f"CASE WHEN contains(text, {_lit(w)}) THEN {_lit(t)} END" for w, t in T.TAGS)
MEMORY_TAGS = f"""WITH {MEMORIES}, t AS (SELECT id, lower(content) AS text FROM memories)
SELECT id, coalesce(array_to_string(list_sort(list_distinct([{_TAGS}])), ','), '') AS tags FROM t"""


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three topic labels of every memory, in the order of the rules."""
    return memories(spark, sf_dir).select("id", F.array_join(T.topics(F.col("content")), ",").alias("topics"))


_TOPICS = ", ".join(f"({i}, {_lit(w)}, {_lit(x)})" for i, (w, x) in enumerate(T.TOPICS))
TOPIC_LABELS = f"""WITH {MEMORIES}, rule(n, word, label) AS (VALUES {_TOPICS}),
hit AS (SELECT id, label, min(n) AS n FROM memories JOIN rule ON contains(lower(content), word) GROUP BY id, label),
top AS (SELECT id, label, n, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM hit)
SELECT m.id, coalesce(string_agg(label, ',' ORDER BY n), 'general') AS topics FROM memories m LEFT JOIN top ON top.id = m.id AND r <= 3 GROUP BY m.id"""


def mood_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pleasure, arousal and dominance of the texts of each conversation, damped by the number of hits, clamped."""
    text = F.lower(F.col("text"))
    hits, sums = F.lit(0), [F.lit(0.0)] * 3
    for word, values in T.MOODS.items():
        hit = F.contains(text, F.lit(word)).cast("int")
        hits, sums = hits + hit, [s + hit * v for s, v in zip(sums, values)]
    rows = read(spark, sf_dir, "conversations").select("conv_id", hits.alias("hits"), *(s.alias(n) for s, n in zip(sums, "pad")))
    total = rows.groupBy("conv_id").agg(F.sum("hits").alias("hits"), *(F.sum(n).alias(n) for n in "pad"))
    scale = 0.3 / (1 + F.col("hits") * 0.15)
    clamp = lambda n: F.round(F.least(F.greatest(F.col(n) * scale, F.lit(-1.0)), F.lit(1.0)), 6)
    return total.select("conv_id", "hits", clamp("p").alias("pleasure"), clamp("a").alias("arousal"), clamp("d").alias("dominance"))


_MOODS = ", ".join(f"({_lit(w)}, {p}, {a}, {d})" for w, (p, a, d) in T.MOODS.items())
MOOD_BY_ROLE = f"""WITH mood(word, p, a, d) AS (VALUES {_MOODS}),
h AS (SELECT conv_id, p::DOUBLE AS p, a::DOUBLE AS a, d::DOUBLE AS d, word FROM conversations LEFT JOIN mood ON contains(lower(text), word)),
s AS (SELECT conv_id, count(word) AS hits, coalesce(sum(p), 0) AS p, coalesce(sum(a), 0) AS a, coalesce(sum(d), 0) AS d FROM h GROUP BY conv_id)
SELECT conv_id, hits, round(least(greatest(p * 0.3 / (1 + hits * 0.15), -1), 1), 6) AS pleasure,
round(least(greatest(a * 0.3 / (1 + hits * 0.15), -1), 1), 6) AS arousal, round(least(greatest(d * 0.3 / (1 + hits * 0.15), -1), 1), 6) AS dominance FROM s"""


def label_frequency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent labels."""
    labels = memories(spark, sf_dir).select(F.explode("labels").alias("label"))
    labels = labels.where(~F.col("label").startswith("meta-") & ~F.col("label").startswith("entity:"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(30)


LABEL_FREQUENCY_TOP = f"""WITH {MEMORIES}, l AS (SELECT unnest(labels) AS label FROM memories)
SELECT label, count(*) AS n FROM l WHERE NOT starts_with(label, 'meta-') AND NOT starts_with(label, 'entity:')
GROUP BY label ORDER BY n DESC, label LIMIT 30"""


def mass_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of memories by mass."""
    m = F.col("mass")
    band = F.when(m < 0.5, "<0.5").when(m < 1, "0.5-1").when(m < 2, "1-2").when(m < 5, "2-5").otherwise("5+")
    return memories(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("mass"), 6).alias("mean_mass"))


MASS_HISTOGRAM = f"""WITH {MEMORIES} SELECT CASE WHEN mass < 0.5 THEN '<0.5' WHEN mass < 1 THEN '0.5-1' WHEN mass < 2 THEN '1-2'
WHEN mass < 5 THEN '2-5' ELSE '5+' END AS band, count(*) AS n, round(avg(mass), 6) AS mean_mass FROM memories GROUP BY band"""


def age_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of memories by age in days."""
    a = _age()
    band = F.when(a < 1, "<1").when(a < 7, "1-7").when(a < 30, "7-30").when(a < 90, "30-90").otherwise("90+")
    return memories(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


AGE_HISTOGRAM = f"""WITH {MEMORIES} SELECT CASE WHEN {_AGE} < 1 THEN '<1' WHEN {_AGE} < 7 THEN '1-7' WHEN {_AGE} < 30 THEN '7-30'
WHEN {_AGE} < 90 THEN '30-90' ELSE '90+' END AS band, count(*) AS n FROM memories GROUP BY band"""


def _log_access() -> Column:
    return F.when(F.col("access_count") > 0, F.log("access_count")).otherwise(0.0)


_LOG_ACCESS = "(CASE WHEN access_count > 0 THEN ln(access_count) ELSE 0 END)"


def effective_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance after access and decay, and the quality score."""
    age = _age()
    effective = (F.col("importance") + 0.3 * _log_access()) * F.when(age > 0, F.pow(F.lit(0.98), age)).otherwise(1.0)
    quality = F.col("importance") * (1 + F.log(F.col("access_count") + 1)) / (1 + F.greatest(age, F.lit(0.0)) / 7)
    return memories(spark, sf_dir).select(
        "id", F.round(effective, 6).alias("effective"), F.round(F.least(F.greatest(quality, F.lit(0.01)), F.lit(10.0)), 6).alias("quality")
    )


_QUALITY = f"least(greatest(importance * (1 + ln(access_count + 1)) / (1 + greatest({_AGE}, 0) / 7), 0.01), 10.0)"
EFFECTIVE_IMPORTANCE = f"""WITH {MEMORIES} SELECT id, round((importance + 0.3 * {_LOG_ACCESS}) * (CASE WHEN {_AGE} > 0 THEN pow(0.98, {_AGE}) ELSE 1 END), 6)
AS effective, round({_QUALITY}, 6) AS quality FROM memories"""


def recompute_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New importance by access and age, and the boost by access band."""
    a, age = F.col("access_count"), _age()
    new = F.col("importance") + F.when(a > 5, 0.1).otherwise(0.0) - F.when((age > 7) & (a == 0), 0.05).otherwise(0.0)
    new = new - F.when((age > 30) & (a == 0), 0.1).otherwise(0.0)
    boost = F.when(a >= 8, 0.3).when(a >= 5, 0.2).when(a >= 3, 0.1).otherwise(0.0)
    clamp = F.least(F.greatest(new, F.lit(0.1)), F.lit(3.0))
    return memories(spark, sf_dir).select("id", F.round(clamp, 6).alias("importance"), F.round(F.least(clamp + boost, F.lit(3.5)), 6).alias("boosted"))


RECOMPUTE_IMPORTANCE = f"""WITH {MEMORIES}, n AS (SELECT id, access_count AS a, least(greatest(importance + (CASE WHEN access_count > 5 THEN 0.1 ELSE 0 END)
 - (CASE WHEN {_AGE} > 7 AND access_count = 0 THEN 0.05 ELSE 0 END) - (CASE WHEN {_AGE} > 30 AND access_count = 0 THEN 0.1 ELSE 0 END), 0.1), 3.0) AS i FROM memories)
SELECT id, round(i, 6) AS importance, round(least(i + (CASE WHEN a >= 8 THEN 0.3 WHEN a >= 5 THEN 0.2 WHEN a >= 3 THEN 0.1 ELSE 0 END), 3.5), 6) AS boosted FROM n"""


def junk_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories to evict as junk, with the reason."""
    age = _age()
    reason = F.when(F.array_contains("labels", "junk"), "junk").when(F.col("mass") < 0.1, "light")
    reason = reason.when((age > 30) & (F.col("importance") < 0.3), "old").when(F.col("importance") < 0.2, "unimportant")
    return memories(spark, sf_dir).where(~F.col("enforced")).select("id", reason.alias("reason")).where("reason is not null")


JUNK_EVICTION = f"""WITH {MEMORIES}, r AS (SELECT id, CASE WHEN list_contains(labels, 'junk') THEN 'junk' WHEN mass < 0.1 THEN 'light'
WHEN {_AGE} > 30 AND importance < 0.3 THEN 'old' WHEN importance < 0.2 THEN 'unimportant' END AS reason FROM memories WHERE NOT enforced)
SELECT * FROM r WHERE reason IS NOT NULL"""


def capacity_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 memories to go first when room is short: lowest quality first, enforced ones never."""
    quality = F.col("importance") * (1 + F.log(F.col("access_count") + 1)) / (1 + F.greatest(_age(), F.lit(0.0)) / 7)
    quality = F.round(F.least(F.greatest(quality, F.lit(0.01)), F.lit(10.0)), 6)
    return memories(spark, sf_dir).where(~F.col("enforced")).select("id", quality.alias("quality")).orderBy("quality", "id").limit(50)


CAPACITY_EVICTION = f"WITH {MEMORIES} SELECT id, round({_QUALITY}, 6) AS quality FROM memories WHERE NOT enforced ORDER BY quality, id LIMIT 50"


def context_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 memories to load as context: important, no junk, by importance and mass."""
    score = F.round(F.col("importance") * (1 + F.greatest(F.col("mass") - 1, F.lit(0.0)) * 0.1), 6)
    rows = memories(spark, sf_dir).where((F.col("importance") >= 0.3) & ~noise_label(F.col("labels")))
    return rows.select("id", score.alias("score"), F.element_at("labels", 1).alias("section")).orderBy(F.desc("score"), "id").limit(30)


CONTEXT_RANKING = f"""WITH {MEMORIES} SELECT id, round(importance * (1 + greatest(mass - 1, 0) * 0.1), 6) AS score, labels[1] AS section
FROM memories WHERE importance >= 0.3 AND NOT list_contains(labels, 'junk') ORDER BY score DESC, id LIMIT 30"""


def recall_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by first label: the three best memories of each, and the section's best score."""
    score = F.round(F.col("importance") * (1 + F.greatest(F.col("mass") - 1, F.lit(0.0)) * 0.1), 6)
    rows = memories(spark, sf_dir).select(F.element_at("labels", 2).alias("section"), "id", score.alias("score"))
    top = top_per_key(rows, "section", 3, F.desc("score"), F.col("id"))
    return top.withColumn("best", F.max("score").over(Window.partitionBy("section")))


RECALL_SECTIONS = f"""WITH {MEMORIES}, s AS (SELECT labels[2] AS section, id, round(importance * (1 + greatest(mass - 1, 0) * 0.1), 6) AS score FROM memories),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY section) AS best FROM s)
SELECT * FROM r WHERE rank <= 3"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories, importance and texts' bytes by day."""
    day = F.floor(F.col("ts") / 86400).alias("day")
    return memories(spark, sf_dir, plain=True).groupBy(day).agg(
        F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"), F.sum(F.octet_length("content")).alias("bytes")
    )


TIMELINE = f"""WITH {PLAIN_MEMORIES} SELECT ts // 86400 AS day, count(*) AS n, round(avg(importance), 6) AS importance, sum(strlen(content))::BIGINT AS bytes
FROM memories GROUP BY day"""


def trash_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted memories that can still be restored, and the days left; those past 30 days are purged."""
    gone = memories(spark, sf_dir).where(F.array_contains("labels", "junk"))
    left = F.col("ts") + 30 * 86400 - AS_OF
    return gone.select("id", F.when(left > 0, "kept").otherwise("purged").alias("state"), F.greatest(F.floor(left / 86400), F.lit(0)).alias("days_left"))


TRASH_EXPIRY = f"""WITH {MEMORIES}, g AS (SELECT id, ts + 30 * 86400 - {AS_OF} AS left_s FROM memories WHERE list_contains(labels, 'junk'))
SELECT id, CASE WHEN left_s > 0 THEN 'kept' ELSE 'purged' END AS state, greatest(floor(left_s / 86400.0), 0)::BIGINT AS days_left FROM g"""


def content_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a of the benchmark texts."""
    return read(spark, sf_dir, "benchmark").select("item_id", T.fnv1a(F.col("text")).alias("hash"))


def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text: the smallest id, their number, and the share of rows that are redundant."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return groups.where("copies > 1").select("first_id", "copies", F.round(1 - 1 / F.col("copies"), 6).alias("redundancy"))


TEXT_GROUPS = """SELECT min(doc_id) AS first_id, count(*) AS copies, round(1 - 1.0 / count(*), 6) AS redundancy FROM documents GROUP BY text HAVING count(*) > 1"""


def role_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of each turn with the turn before it in its conversation."""
    rows = read(spark, sf_dir, "conversations").withColumn("words", T.word_set(F.col("text")))
    before = F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("words"), F.col("before")), 6).alias("overlap"))


_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\-]+'), lambda w: strlen(w) >= 2))"
ROLE_OVERLAP = f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 0 ELSE len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) END, 6) AS overlap
FROM l WHERE b IS NOT NULL"""

NAMES = (
    "importance_score intake_class memory_tags topic_labels mood_by_role label_frequency_top mass_histogram age_histogram "
    "effective_importance recompute_importance junk_eviction capacity_eviction context_ranking recall_sections timeline trash_expiry "
    "text_groups role_overlap"
).split()
QUERIES = {name: globals()[name] for name in NAMES} | {"content_fnv": content_fnv}
SQL = {name: globals()[name.upper()] for name in NAMES}
