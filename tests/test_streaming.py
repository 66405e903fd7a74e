"""Streams that are run to their end give what the batch queries give."""

from pyspark.sql import functions as F

from lodestar.plans import events_log
from lodestar.streaming import event_stream as S

from .conftest import SF


def run(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def split(spark, folder):
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(3, "ts").write.parquet(folder)
    return folder


def test_tumbling_and_scores(spark, tmp_path):
    folder = split(spark, str(tmp_path / "events"))
    found = run(S.tumbling(S.read_events(spark, folder, 10)), "tumbling", "complete")
    batch = events_log.event_tumbling(spark, SF)
    assert sorted(map(tuple, found.select("start", "event_type", "n", F.round("total", 4)).collect())) == sorted(map(tuple, batch.collect()))
    found = run(S.scores(S.read_events(spark, folder)), "scores", "complete")
    batch = events_log.threat_score(spark, SF).select("user_id", "score", "last_seen")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_anchored_limit(spark, tmp_path):
    folder = split(spark, str(tmp_path / "events"))
    rows = run(S.anchored_limit(S.read_events(spark, folder, 10), 86400, 5), "anchored", "append").collect()
    want = {}
    for r in sorted(events_log.event_log(spark, SF).collect(), key=lambda r: r.epoch):
        start, used, ok, no = want.get(r.user_id, (-1, 0, 0, 0))
        if start < 0 or r.epoch - start >= 86400:
            start, used = r.epoch, 0
        used += 1
        want[r.user_id] = (start, used, ok + (used <= 5), no + (used > 5))
    assert {r.user_id: (r.allowed, r.denied) for r in rows} == {k: v[2:] for k, v in want.items()}


def test_anchored_limit_ends(spark, tmp_path):
    """State of keys that are quiet goes; a key that comes back begins anew."""
    folder = str(tmp_path / "events")
    rows = [(1, 100, 1), (1, 110, 2), (2, 10 * 86400, 3), (1, 20 * 86400, 4), (2, 20 * 86400 + 5, 5)]
    frame = spark.createDataFrame(rows, "user_id long, epoch long, event_id long").withColumn("ts", F.timestamp_seconds("epoch"))
    for low, high in ((0, 3), (3, 4), (4, 6)):
        frame.where(f"event_id >= {low} and event_id < {high}").drop("epoch").coalesce(1).write.mode("append").parquet(folder)
    stream = S.anchored_limit(S.read_events(spark, folder), 60, 1)
    found = run(stream, "ended", "append").collect()
    assert sorted((r.user_id, r.allowed, r.denied) for r in found if r.allowed + r.denied) == [(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 0)]


def follow_by_hand(events, interval, upto):
    """Changes of one key by going through time second by second: events are (epoch, points, kind)."""
    out, score, logins, attacks, last, until = [], 0, 0, 0, None, 0
    at_times = {}
    for epoch, points, kind in events:
        at_times.setdefault(epoch, []).append((points, kind))
    for now in range(min(at_times), upto + 1):
        if last is not None and until and now > until:
            out.append((now, "release", score, until))
            score, logins, attacks, last, until = 0, 0, 0, None, 0
        elif last is not None and not until and now > last and (now - last - 1) % interval == 0 and now - last > 1:
            if score > 2:
                score -= 2
            else:
                out.append((now, "forget", None, 0))
                score, logins, attacks, last = 0, 0, 0, None
        for points, kind in at_times.get(now, ()):
            score, logins, attacks, last = score + points, logins + (kind == "login"), attacks + (kind == "error"), now
            if not until and score >= 10:
                until = now + 86400 * (7 if logins >= 5 else 2 if attacks else 1)
                out.append((now, "ban", score, until))
    return out


def guard_log(seed, keys):
    """(user_id, epoch, event_id, event_type), bursts and pauses."""
    import random

    draw, out = random.Random(seed), []
    for key in keys:
        now = draw.randrange(3000)
        for _ in range(draw.randrange(1, 40)):
            now += draw.choice([0, 1, 30, 299, 300, 301, 302, 900, 3000, 90_000])
            out.append((key, now, len(out), draw.choice(["error", "login", "click", "view"])))
    return out


def test_guard_rule(spark):
    from lodestar.operators import guard

    rows, upto = guard_log(3, range(8)), 800_000
    points = {"error": 5, "login": 3, "click": 1}
    frame = spark.createDataFrame([(*r, points.get(r[3], 0)) for r in rows] + [(None, 5, -1, "error", 5)], "user_id long, epoch long, event_id long, event_type string, points long")
    found = guard.guard_changes(frame.repartition(3), upto).collect()
    want = []
    for key in range(8):
        own = sorted((e, i, points[k], k) for u, e, i, k in rows if u == key and k in points)
        want += [(key, *c) for c in follow_by_hand([(e, p, k) for e, _, p, k in own], 300, upto)] if own else []
    plain = lambda u, at, kind, score, until: (u, at, kind, None if kind == "forget" else score, until)
    assert sorted(plain(*r) for r in found) == sorted(plain(*w) for w in want)
    assert {r.kind for r in found} == {"ban", "forget", "release"}


def test_guard_stream(spark, tmp_path):
    """The stream gives the batch's changes up to its watermark, and keeps no state of keys that ended."""
    from lodestar.operators import guard

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path / "events")
    rows = guard_log(5, range(6)) + [(99, 30 * 86400, 10_000, "click"), (99, 31 * 86400, 10_001, "click")]
    frame = spark.createDataFrame(rows, "user_id long, epoch long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("epoch"))
    for low, high in ((0, 4000), (4000, 20_000), (20_000, 30 * 86400 + 1), (30 * 86400 + 1, 32 * 86400)):
        frame.where(f"epoch >= {low} and epoch < {high}").drop("epoch").coalesce(1).write.mode("append").parquet(folder)
    try:
        found = run(S.guard_states(S.read_events(spark, folder), late="1 minute"), "guard", "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = guard.guard_changes(frame.withColumn("points", events_log.points()).drop("ts"), 31 * 86400 - 60).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch))
    assert {r.kind for r in found} == {"ban", "forget", "release"} and 99 in {r.user_id for r in found}


def test_log_tail(spark, tmp_path):
    """Lines that are appended come once, a line without an end waits, a file begun anew is read again."""
    from lodestar.sources import log_tail

    spark.dataSource.register(log_tail.LogTail)
    log, other = tmp_path / "a.log", tmp_path / "b.log"
    seen = []

    def turn():
        stream = spark.readStream.format("log_tail").option("path", str(tmp_path / "*.log")).option("range", 7).load()
        take = lambda batch, _: seen.extend((r.path.rsplit("/", 1)[1], r.at, r.line) for r in batch.collect())
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        out = sorted(seen)
        seen.clear()
        return out

    log.write_bytes("first line of some length\n\n  zweite zeile äö \nhalf".encode())
    assert turn() == [("a.log", 0, "first line of some length"), ("a.log", 27, "zweite zeile äö")]
    assert turn() == []
    with log.open("ab") as file:
        file.write(b" and whole\n")
    other.write_bytes(b"x\ny\n")
    assert turn() == [("a.log", 48, "half and whole"), ("b.log", 0, "x"), ("b.log", 2, "y")]
    log.write_bytes(b"anew\n")
    other.unlink()
    assert turn() == [("a.log", 0, "anew")]
    assert turn() == []
