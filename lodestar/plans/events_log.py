"""Queries over the event log: threat scores, bans, limits, windows, changes, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.guard import guard_changes
from lodestar.sources.tables import AS_OF, EVENT_LOG, event_log, read

#: Points of an event by its type, as the log's types stand for the kinds of the guard.
POINTS = {"error": 5, "login": 3, "click": 1}


def points() -> Column:
    out = None
    for kind, n in POINTS.items():
        out = F.when(F.col("event_type") == kind, n) if out is None else out.when(F.col("event_type") == kind, n)
    return out.otherwise(0)


_POINTS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in POINTS.items()) + " ELSE 0 END"


def threat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, events by category and last event of every key, with the ban that follows."""
    rows = event_log(spark, sf_dir).groupBy("user_id").agg(
        F.sum(points()).alias("score"),
        F.count_if(F.col("event_type") == "error").alias("attacks"),
        F.count_if(F.col("event_type") == "login").alias("logins"),
        F.max("epoch").alias("last_seen"),
    )
    days = F.when(F.col("score") < 10, 0).when(F.col("logins") >= 5, 7).when(F.col("attacks") > 0, 2).otherwise(1)
    return rows.withColumn("ban_days", days.cast("long")).withColumn("banned", F.col("last_seen") + F.col("ban_days") * 86400 > AS_OF)


THREAT_SCORE = f"""WITH {EVENT_LOG}, s AS (SELECT user_id, sum({_POINTS})::BIGINT AS score, count(*) FILTER (event_type = 'error') AS attacks,
count(*) FILTER (event_type = 'login') AS logins, max(epoch) AS last_seen FROM event_log GROUP BY user_id),
d AS (SELECT *, CASE WHEN score < 10 THEN 0 WHEN logins >= 5 THEN 7 WHEN attacks > 0 THEN 2 ELSE 1 END::BIGINT AS ban_days FROM s)
SELECT *, last_seen + ban_days * 86400 > {AS_OF} AS banned FROM d"""


#: The log has a few events a day of each key, so points fade more slowly than in a guard's log.
FADE_S = 6 * 3600


def ban_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans, their ends, and keys that are forgotten, with fading points."""
    return guard_changes(event_log(spark, sf_dir).withColumn("points", points()), AS_OF, FADE_S)


_ENDS = f"CASE WHEN until > 0 THEN until ELSE last + {FADE_S} * ((score + 1) // 2) END + 1"
_FADED = f"CASE WHEN gone THEN 0 WHEN until > 0 THEN score ELSE greatest(score - 2 * greatest((epoch - last - 1) // {FADE_S}, 0), 0) END"
BAN_STATES = f"""WITH RECURSIVE {EVENT_LOG}, ev AS (SELECT user_id, epoch, event_type, {_POINTS} AS points, row_number() OVER (PARTITION BY user_id ORDER BY epoch, event_id) AS n
 FROM event_log WHERE {_POINTS} > 0 AND epoch <= {AS_OF}),
walk AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS score, 0::BIGINT AS logins, 0::BIGINT AS attacks, 0::BIGINT AS last, 0::BIGINT AS until, true AS gone, false AS banned
 FROM (SELECT DISTINCT user_id FROM ev) UNION ALL
 SELECT user_id, n, score, logins, attacks, epoch, CASE WHEN was > 0 THEN was WHEN score < 10 THEN 0 ELSE epoch + 86400 * CASE WHEN logins >= 5 THEN 7 WHEN attacks > 0 THEN 2 ELSE 1 END END,
  false, was = 0 AND score >= 10
 FROM (SELECT user_id, n, epoch, points + {_FADED} AS score, CASE WHEN gone THEN 0 ELSE logins END + (event_type = 'login')::BIGINT AS logins,
  CASE WHEN gone THEN 0 ELSE attacks END + (event_type = 'error')::BIGINT AS attacks, CASE WHEN gone THEN 0 ELSE until END AS was
  FROM (SELECT w.user_id, e.n, e.epoch, e.event_type, e.points, score, logins, attacks, last, until, gone OR {_ENDS} <= e.epoch AS gone
   FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.n = w.n + 1))),
s AS (SELECT *, {_ENDS} AS ends, coalesce(lead(last) OVER (PARTITION BY user_id ORDER BY n), {AS_OF}) AS next FROM walk WHERE n > 0)
SELECT user_id, last AS at, 'ban' AS kind, score, until FROM s WHERE banned UNION ALL
SELECT user_id, ends, CASE WHEN until > 0 THEN 'release' ELSE 'forget' END, score, until FROM s WHERE ends <= next"""


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each key by minute, and those over the limit of two."""
    minute = F.floor(F.col("epoch") / 60) * 60
    counts = event_log(spark, sf_dir).groupBy("user_id", minute.alias("minute")).agg(F.count("*").alias("requests"))
    return counts.where("requests > 1").withColumn("denied", F.greatest(F.col("requests") - 2, F.lit(0)))


RATE_LIMIT = f"""WITH {EVENT_LOG}, c AS (SELECT user_id, epoch // 60 * 60 AS minute, count(*) AS requests FROM event_log GROUP BY ALL)
SELECT *, greatest(requests - 2, 0) AS denied FROM c WHERE requests > 1"""


def heartbeat_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of every key; healthy if it is less than two days before the last of all."""
    last = event_log(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("epoch", "event_id", "event_type")).alias("l"))
    newest = F.broadcast(last.agg(F.max("l.epoch").alias("newest")))
    return last.join(newest, F.lit(True)).select("user_id", "l.event_type", "l.epoch", (F.col("newest") - F.col("l.epoch") < 2 * 86400).alias("healthy"))


HEARTBEAT_HEALTH = f"""WITH {EVENT_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, event_id DESC) AS n FROM event_log)
SELECT user_id, event_type, epoch, (SELECT max(epoch) FROM event_log) - epoch < 2 * 86400 AS healthy FROM r WHERE n = 1"""


def audit_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page of the audit trail of denied actions: 25 after 25, newest first."""
    rows = event_log(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", "epoch", F.round("value", 6).alias("value"))
    return rows.orderBy(F.desc("epoch"), "event_id").offset(25).limit(25)


AUDIT_BY_USER = f"WITH {EVENT_LOG} SELECT event_id, user_id, epoch, round(value, 6) AS value FROM event_log WHERE event_type = 'error' ORDER BY epoch DESC, event_id LIMIT 25 OFFSET 25"


def health_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and mean value by day with the change since the day before."""
    days = event_log(spark, sf_dir).groupBy(F.floor(F.col("epoch") / 86400).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    before = Window.orderBy("day")  # one row a day
    return days.withColumn("change", F.coalesce(F.col("n") - F.lag("n").over(before), F.lit(0)))


HEALTH_TREND = f"""WITH {EVENT_LOG}, d AS (SELECT epoch // 86400 AS day, count(*) AS n, round(avg(value), 6) AS mean FROM event_log GROUP BY 1)
SELECT *, coalesce(n - lag(n) OVER (ORDER BY day), 0) AS change FROM d"""


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values by type in windows of six hours."""
    rows = event_log(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


EVENT_TUMBLING = f"WITH {EVENT_LOG} SELECT epoch // 21600 * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM event_log GROUP BY ALL"


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys in windows of a day that start every twelve hours."""
    rows = event_log(spark, sf_dir).groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))
    return rows.select(F.unix_timestamp("window.start").alias("start"), "users", "n")


EVENT_SLIDING = f"""WITH {EVENT_LOG}, w AS (SELECT epoch // 43200 * 43200 - 43200 * unnest([0, 1]) AS start, user_id FROM event_log)
SELECT start, count(DISTINCT user_id) AS users, count(*) AS n FROM w GROUP BY start"""


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each key: events less than an hour apart."""
    rows = event_log(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"), F.max("epoch").alias("last"))
    return rows.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "last", "n")


EVENT_SESSIONS = f"""WITH {EVENT_LOG}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM event_log),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, min(epoch) AS start, max(epoch) AS last, count(*) AS n FROM s GROUP BY user_id, session"""


def props_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the number in their JSON properties."""
    return event_log(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


PROPS_BY_KEY = f"WITH {EVENT_LOG} SELECT k, count(*) AS n, round(avg(value), 6) AS mean FROM event_log GROUP BY k"


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a key's type differs from its event before."""
    order = Window.partitionBy("user_id").orderBy("epoch", "event_id")
    rows = event_log(spark, sf_dir).withColumn("before", F.lag("event_type").over(order))
    return rows.where("before <> event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


STATE_CHANGES = f"""WITH {EVENT_LOG}, l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch, event_id) AS before FROM event_log)
SELECT before, event_type, count(*) AS n FROM l WHERE before <> event_type GROUP BY ALL"""


def feedback_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback by key: small deltas are skipped, the sum is damped and clamped."""
    delta = F.col("value") / 250 - 1
    rows = event_log(spark, sf_dir).where(F.abs(delta) >= 0.01).groupBy("user_id").agg(F.sum(delta).alias("s"), F.count("*").alias("n"))
    return rows.select("user_id", "n", F.round(F.least(F.greatest(0.3 * F.col("s"), F.lit(-0.5)), F.lit(0.5)), 6).alias("adjustment"))


FEEDBACK_APPLY = f"""WITH {EVENT_LOG} SELECT user_id, count(*) AS n, round(least(greatest(0.3 * sum(value / 250 - 1), -0.5), 0.5), 6) AS adjustment
FROM event_log WHERE abs(value / 250 - 1) >= 0.01 GROUP BY user_id"""


#: Events of a user that are folded in one row.
SLICE_EVENTS = 4096


def _slices(log: DataFrame, *columns: str) -> DataFrame:
    """user_id, slice, e: the events of each user in order, cut by hours and then into slices of SLICE_EVENTS at most."""
    order = Window.partitionBy("user_id", "hour").orderBy("epoch", "event_id")
    number = F.floor((F.row_number().over(order) - 1) / SLICE_EVENTS)
    sliced = log.withColumn("hour", F.floor(F.col("epoch") / 3600)).withColumn("slice", F.struct("hour", number.alias("number")))
    return sliced.groupBy("user_id", "slice").agg(F.array_sort(F.collect_list(F.struct("epoch", "event_id", *columns))).alias("e"))


def outcome_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential average of each key's values in order of time: 0.85 of the old, 0.15 of the new."""
    fold = F.aggregate("e", F.lit(0.0), lambda s, x: s * 0.85 + x["value"] * 0.15)
    parts = _slices(event_log(spark, sf_dir), "value").select("user_id", "slice", fold.alias("part"), F.size("e").cast("long").alias("n"))
    # what follows a slice fades it by a power of 0.85, so that slices are summed in any order
    after = F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("slice"))) - F.col("n")
    faded = parts.withColumn("part", F.col("part") * F.pow(F.lit(0.85), after))
    return faded.groupBy("user_id").agg(F.round(F.sum("part"), 6).alias("average"), F.sum("n").alias("n"))


OUTCOME_AVERAGE = f"""WITH {EVENT_LOG}, r AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n,
row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, event_id DESC) - 1 AS back FROM event_log)
SELECT user_id, round(sum(value * 0.15 * pow(0.85, back)), 6) AS average, max(n) AS n FROM r GROUP BY user_id"""


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the values of each type."""
    # counts of distinct values, cumulated within ranges of values and over the ranges
    counts = event_log(spark, sf_dir).groupBy("event_type", "value").agg(F.count("value").alias("n"))
    counts = counts.withColumn("range", F.coalesce(F.floor("value"), F.lit(0)))
    ranges = counts.groupBy(F.col("event_type").alias("type"), F.col("range").alias("of")).agg(F.sum("n").alias("m"))
    types = Window.partitionBy("type")
    ranges = ranges.select("type", "of", F.sum("m").over(types).alias("total"), (F.sum("m").over(types.orderBy("of")) - F.col("m")).alias("before"))
    placed = counts.join(ranges, F.col("event_type").eqNullSafe(F.col("type")) & (F.col("range") == F.col("of")))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("event_type", "range").orderBy("value"))
    placed = placed.withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))

    def p(q: float) -> Column:
        at = (F.col("total") - 1) * F.lit(q)
        low, high = (F.max(F.when((F.col("first") <= i) & (F.col("last") > i), F.col("value"))) for i in (F.floor(at), F.ceil(at)))
        return F.round(low + F.max(at - F.floor(at)) * (high - low), 6)

    return placed.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("value").alias("most"))


VALUE_PERCENTILES = f"""WITH {EVENT_LOG} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM event_log GROUP BY event_type"""


def energy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget of each key after its events in order: a purchase costs, anything else refills, within 0 and 1000."""
    # a run of events is x -> min(max(x + add, low), high), with low <= high; so are two runs after another
    change = lambda x: F.when(x["event_type"] == "purchase", -x["value"]).otherwise(12.0)
    clamp = lambda x, low, high: F.least(F.greatest(x, low), high)
    whole = F.struct(F.lit(0.0).alias("add"), F.lit(0.0).alias("low"), F.lit(1000.0).alias("high"))
    none, full = F.lit(0.0), F.lit(1000.0)
    event = lambda s, x: F.struct(
        (s["add"] + change(x)).alias("add"),
        clamp(s["low"] + change(x), none, full).alias("low"),
        clamp(s["high"] + change(x), none, full).alias("high"),
    )
    parts = _slices(event_log(spark, sf_dir), "event_type", "value").select("user_id", "slice", F.aggregate("e", whole, event).alias("run"))
    runs = parts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slice", "run"))).alias("runs"))
    step = lambda s, x: clamp(s + x["run"]["add"], x["run"]["low"], x["run"]["high"])
    return runs.select("user_id", F.round(F.aggregate("runs", full, step), 6).alias("energy"))


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: every purchase with the same key's last click before it.

    One sort by key and time over both sides, instead of a range join."""
    order = Window.partitionBy("user_id").orderBy("epoch", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = event_log(spark, sf_dir).where(F.col("event_type").isin("purchase", "click"))
    click = F.when(F.col("event_type") == "click", F.col("epoch"))
    found = rows.withColumn("click", F.last(click, ignorenulls=True).over(order)).where("event_type = 'purchase'")
    return found.select("event_id", "user_id", "epoch", F.coalesce("click", F.lit(-1)).alias("last_click"))


LATEST_BEFORE = f"""WITH {EVENT_LOG} SELECT p.event_id, p.user_id, p.epoch, coalesce(max(c.epoch), -1) AS last_click
FROM event_log p LEFT JOIN event_log c ON c.event_type = 'click' AND c.user_id = p.user_id AND (c.epoch, c.event_id) < (p.epoch, p.event_id)
WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id, p.epoch"""


def ring_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the shard that a hash range gives them: 128 equal arcs, dealt to four shards."""
    arc = F.shiftrightunsigned(F.xxhash64("user_id"), 57)
    return read(spark, sf_dir, "events").groupBy(F.pmod(arc, F.lit(4)).alias("shard")).agg(F.countDistinct("user_id").alias("keys"), F.count("*").alias("n"))


NAMES = (
    "threat_score ban_states rate_limit heartbeat_health audit_by_user health_trend event_tumbling event_sliding event_sessions props_by_key "
    "state_changes feedback_apply outcome_average value_percentiles latest_before"
).split()
QUERIES = {name: globals()[name] for name in NAMES} | {"energy_balance": energy_balance, "ring_routing": ring_routing}
SQL = {name: globals()[name.upper()] for name in NAMES}
