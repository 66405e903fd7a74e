"""Queries over new texts: what they repeat, correct or contradict, how they are labelled, and what goes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators.overlaps import set_overlaps
from lodestar.operators.retrieval import top_per_key
from lodestar.plans.graphs import relations
from lodestar.plans.rules import _CLASS, _TAGS, _any, _lit
from lodestar.plans.search import PAIRS
from lodestar.sources.tables import AS_OF, MEMORIES, memories, read, vectors

_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\-]+'), lambda w: strlen(w) >= 2)"
_SET = "list_distinct(" + _WORDS + ")"
_LIST = lambda words: "[" + ", ".join(map(_lit, words)) + "]"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).where("before is not null")


def turn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the turn before it: share of its words that come back, whether the texts match but for details,
    and whether it corrects the earlier one (words of denial and more than 0.4 of its words)."""
    overlap = T.topic_overlap(F.col("own"), F.col("others"))
    denies = T.any_contained(F.lower("text"), T.INTAKE_DENIALS)
    turns = _turns(spark, sf_dir).withColumns({"own": T.word_list(F.col("text")), "others": T.word_set(F.col("before"))})
    return turns.select(
        "conv_id",
        "turn",
        F.round(overlap, 6).alias("overlap"),
        T.fuzzy_match(F.col("text"), F.col("before")).alias("matches"),
        (denies & (overlap > 0.4)).alias("conflict"),
    )


_BEFORE = "l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
TURN_CONFLICTS = f"""WITH {_BEFORE}, w AS (SELECT *, {_WORDS.format("text")} AS a, {_SET.format("text")} AS s, {_SET.format("before")} AS b FROM l WHERE before IS NOT NULL),
o AS (SELECT *, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(a) END AS overlap FROM w)
SELECT conv_id, turn, round(overlap, 6) AS overlap,
abs(strlen(text) - strlen(before)) <= strlen(text) // 3 AND len(list_distinct(list_concat(s, b))) > 0
 AND len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))) > 0.85 AS matches,
{_any("lower(text)", T.INTAKE_DENIALS)} AND overlap > 0.4 AS conflict FROM o"""


FIRST_OF_GROUP = 80


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of one source that contradict each other, among its first 80: word overlap of 0.08 or more, exactly one
    side with a word of denial, both of 30 bytes or more, neither enforced."""
    rows = memories(spark, sf_dir).select("id", F.element_at("labels", 2).alias("group"), "content", "enforced")
    first = top_per_key(rows, "group", FIRST_OF_GROUP, F.col("id")).where((F.octet_length("content") >= 30) & ~F.col("enforced"))
    denies = T.any_contained(F.lower("content"), T.DENIALS)
    pairs = set_overlaps(first.select("group", "id", T.word_set(F.col("content")).alias("words"), denies.alias("side")), 0.08)
    return pairs.select("a", "b", F.round("overlap", 6).alias("overlap"))


CONTRADICTIONS = f"""WITH {MEMORIES}, f AS (SELECT *, labels[2] AS source FROM memories QUALIFY row_number() OVER (PARTITION BY labels[2] ORDER BY id) <= {FIRST_OF_GROUP}),
r AS (SELECT id, source, {_SET.format("content")} AS w, {_any("lower(content)", T.DENIALS)} AS denies FROM f WHERE strlen(content) >= 30 AND NOT enforced),
s AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS overlap
FROM r x JOIN r y ON x.source = y.source AND x.id < y.id AND x.denies <> y.denies)
SELECT a, b, round(overlap, 6) AS overlap FROM s WHERE overlap >= 0.08"""


def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose texts have the same words: the newest stays, with the labels of all; how many go."""
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", F.array("lang", "source").alias("labels"), F.sha2(F.array_join(F.array_sort(T.word_set(F.col("text"))), " "), 256).alias("key")
    )
    sizes = rows.groupBy("key").agg(F.max("doc_id").alias("keep_id"), (F.count("*") - 1).alias("removed"))
    named = rows.select("key", F.explode("labels").alias("label")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return sizes.where("removed > 0").join(named, "key").select("keep_id", "removed", "labels")


MERGED_DUPLICATES = f"""WITH k AS (SELECT doc_id, lang, source, array_to_string(list_sort({_SET.format("text")}), ' ') AS key FROM documents),
n AS (SELECT key, max(doc_id) AS keep_id, count(*) - 1 AS removed FROM k GROUP BY key HAVING count(*) > 1),
x AS (SELECT key, unnest([lang, source]) AS label FROM k)
SELECT keep_id, removed, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM n JOIN x USING (key) GROUP BY key, keep_id, removed"""


def enriched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every memory with its class (unless general) and its tags after them, each once."""
    kind = F.col("class")
    rows = memories(spark, sf_dir).select("id", "labels", "content", T.memory_class(F.col("content"), F.col("labels")).alias("class"))
    named = F.when(kind == "general", F.array().cast("array<string>")).otherwise(F.array(kind))
    return rows.select("id", F.array_join(F.array_union(F.array_union("labels", named), T.tags(F.col("content"))), ",").alias("labels"))


ENRICHED_LABELS = f"""WITH {MEMORIES}, c AS (SELECT id, labels, {_CLASS} AS class, lower(content) AS text FROM memories),
t AS (SELECT id, list_concat(labels, list_concat(CASE WHEN class = 'general' THEN [] ELSE [class] END,
 coalesce(list_sort(list_distinct([{_TAGS}])), []))) AS l FROM c),
x AS (SELECT id, unnest(l) AS label, unnest(range(len(l))) AS pos FROM t), f AS (SELECT id, label, min(pos) AS pos FROM x WHERE label IS NOT NULL GROUP BY id, label)
SELECT id, string_agg(label, ',' ORDER BY pos) AS labels FROM f GROUP BY id"""


def label_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and layer of every memory by its tags and topics."""
    rows = memories(spark, sf_dir).select("id", F.array_union(T.tags(F.col("content")), T.topics(F.col("content"))).alias("labels"))
    return rows.select("id", T.label_category(F.col("labels")).alias("category"), T.label_layer(F.col("labels")).alias("layer"))


_TOPIC_CASES = ", ".join(f"CASE WHEN contains(lower(content), {_lit(w)}) THEN {_lit(x)} END" for w, x in T.TOPICS)
_CATEGORY = "CASE " + " ".join(f"WHEN list_has_any(l, {_LIST(words.split())}) THEN '{name}'" for name, words in T.CATEGORIES) + " ELSE 'general' END"
LABEL_CATEGORIES = f"""WITH {MEMORIES}, t AS (SELECT id, list_filter([{_TAGS.replace("text", "lower(content)")}], lambda x: x IS NOT NULL) AS tags,
 list_filter([{_TOPIC_CASES}], lambda x: x IS NOT NULL) AS topics FROM memories),
o AS (SELECT id, unnest(topics) AS label, unnest(range(len(topics))) AS pos FROM t),
f AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS r FROM o GROUP BY id, label),
g AS (SELECT id, list(label) AS l FROM f WHERE r <= 3 GROUP BY id),
a AS (SELECT t.id, list_concat(tags, coalesce(g.l, ['general'])) AS l FROM t LEFT JOIN g ON g.id = t.id)
SELECT id, {_CATEGORY} AS category,
CASE WHEN list_has_any(l, ['system']) OR contains(array_to_string(l, ' '), 'identity') THEN 'identity'
 WHEN list_has_any(l, {_LIST(T.SERVICE)}) OR contains(array_to_string(l, ' '), 'tool') OR contains(array_to_string(l, ' '), 'service') THEN 'service'
 WHEN list_has_any(l, {_LIST(T.COGNITIVE)}) THEN 'cognitive' ELSE 'instinct' END AS layer FROM a"""


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent of every memory's text taken as a query: its primary kind, and the boosts of recency and of classes."""
    temporal, primary, boosts = T.query_intent(F.col("content"))
    return memories(spark, sf_dir).select("id", temporal.alias("temporal"), primary.alias("intent"), *(c.alias(k) for k, c in sorted(boosts.items())))


def _boost_sql(kind: str) -> str:
    rules = [(words, given[kind]) for _, words, given in T.INTENTS if kind in given]
    return "CASE " + " ".join(f"WHEN {_any('text', words)} THEN {boost}" for words, boost in reversed(rules)) + f" ELSE 1 END::DOUBLE AS {kind}"


QUERY_INTENTS = f"""WITH {MEMORIES}, t AS (SELECT id, lower(content) AS text FROM memories)
SELECT id, CASE WHEN {_any("text", T.THIS_WEEK)} THEN 2.0 WHEN {_any("text", T.RECENT)} THEN 2.5 ELSE 1 END::DOUBLE AS temporal,
CASE WHEN {_any("text", T.THIS_WEEK + T.RECENT)} THEN 'temporal' {" ".join(f"WHEN {_any('text', words)} THEN '{name}'" for name, words, _ in T.INTENTS)} ELSE 'general' END AS intent,
{", ".join(_boost_sql(kind) for kind in sorted({k for _, _, given in T.INTENTS for k in given}))} FROM t"""


def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and brands as labels: letters, digits and - _ . stay."""
    label = F.concat_ws("/", "p_name", "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", T.sanitized_label(label).alias("label"))


CLEAN_LABELS = r"SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^\p{L}\p{N}\-_.]', '-', 'g') AS label FROM part"


def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every memory, its first 60 bytes cut between characters, and its age in words."""
    hours = F.floor((F.lit(AS_OF) - F.col("ts")) / 3600)
    rows = memories(spark, sf_dir, plain=True)
    return rows.select("id", T.estimated_tokens(F.col("content")).alias("tokens"), T.cut_bytes(F.col("content"), 60).alias("head"), T.time_ago(hours).alias("age"))


TEXT_BUDGET = rf"""WITH {MEMORIES.replace("phrase || ' ' || d.text", "d.text")}, h AS (SELECT *, floor(({AS_OF} - ts) / 3600.0)::BIGINT AS hours FROM memories)
SELECT id, (strlen(content) // 3 + length(regexp_replace(content, '[^\x00-\x7F]', '', 'g')) // 5)::BIGINT AS tokens,
substr(content, 1, list_max(list_filter(range(15, 61), lambda n: strlen(substr(content, 1, n)) <= 60))) AS head,
CASE WHEN hours < 1 THEN 'just now' WHEN hours < 24 THEN hours || 'h ago' ELSE (floor(hours / 24.0)::BIGINT) || 'd ago' END AS age FROM h"""


def best_similarity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of every memory and the next: cosine where both have a vector, else of their labels."""
    rows = memories(spark, sf_dir).select("id", "labels").join(vectors(spark, sf_dir).select("id", "embedding"), "id", "left")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("labels").alias("labels2"), F.col("embedding").alias("embedding2"))
    both = F.col("embedding").isNotNull() & F.col("embedding2").isNotNull()
    like = F.when(both, V.cosine(F.col("embedding"), F.col("embedding2"))).otherwise(T.jaccard(F.col("labels"), F.col("labels2")))
    return rows.join(other, "id").select("id", both.alias("by_vector"), F.round(like, 6).alias("similarity"))


BEST_SIMILARITY_FALLBACK = f"""WITH {MEMORIES}, r AS (SELECT m.id, labels, embedding::DOUBLE[] AS v FROM memories m LEFT JOIN embeddings ON vec_id = m.id)
SELECT a.id, a.v IS NOT NULL AND b.v IS NOT NULL AS by_vector, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL
THEN least(greatest(list_cosine_similarity(a.v, b.v), 0), 1) ELSE len(list_intersect(a.labels, b.labels)) / len(list_distinct(list_concat(a.labels, b.labels))) END, 6) AS similarity
FROM r a JOIN r b ON b.id = a.id + 1"""


def low_quality_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten memories that go first: junk, or light and of a test's wording, without a relation, in the order of ids."""
    text = F.col("content")
    light = (F.octet_length(text) < 20) | text.startswith("test ") | text.startswith("[session] accomplished: test")
    rows = memories(spark, sf_dir, plain=True).where(F.array_contains("labels", "junk") | (F.col("mass") < 1.3) & light)
    ends = relations(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("id"))
    return rows.join(ends, "id", "left_anti").select("id", "mass").orderBy("id").limit(10)


LOW_QUALITY_EVICTION = f"""WITH {MEMORIES.replace("phrase || ' ' || d.text", "d.text")}, {PAIRS}
SELECT id, mass FROM memories WHERE (list_contains(labels, 'junk') OR mass < 1.3 AND (strlen(content) < 20 OR starts_with(content, 'test ')
OR starts_with(content, '[session] accomplished: test'))) AND id NOT IN (SELECT a FROM pairs UNION SELECT b FROM pairs) ORDER BY id LIMIT 10"""


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of memories after feedback: junk and curated go, outdated comes to the old ones."""
    rows = memories(spark, sf_dir)
    old = F.when(F.lit(AS_OF) - F.col("ts") > 20 * 86400, F.array(F.lit("outdated"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.array_join(F.array_union(F.array_except("labels", F.lit(["junk", "curated"])), old), ",").alias("labels"))


RELABELLED = f"""WITH {MEMORIES} SELECT id, array_to_string(list_concat(list_filter(labels, lambda x: x NOT IN ('junk', 'curated')),
CASE WHEN {AS_OF} - ts > 20 * 86400 THEN ['outdated'] ELSE [] END), ',') AS labels FROM memories"""


def attack_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address, or whose source without it, holds parts that mark an attack, and how many."""
    rows = read(spark, sf_dir, "pages")
    return rows.select(
        "page_id",
        T.any_contained(F.lower("url"), T.ATTACKS).alias("in_url"),
        T.count_contained(F.lower("html"), T.ATTACKS).cast("long").alias("in_html"),
    )


_COUNT_ATTACKS = " + ".join(f"contains(lower(html), {_lit(w)})::BIGINT" for w in T.ATTACKS)
ATTACK_MARKS = f"SELECT page_id, {_any('lower(url)', T.ATTACKS)} AS in_url, {_COUNT_ATTACKS} AS in_html FROM pages"

NAMES = (
    "turn_conflicts contradictions merged_duplicates enriched_labels label_categories query_intents clean_labels text_budget "
    "best_similarity_fallback low_quality_eviction relabelled attack_marks"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {name: globals()[name.upper()] for name in NAMES}
