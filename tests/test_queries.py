"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

import lodestar.plans.catalogue as catalogue

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(rows, names):
    def cell(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("slice_events", [4096, 2])
def test_hot_user_folds_in_slices(spark, monkeypatch, slice_events):
    import random

    from lodestar.plans import events_log

    draw = random.Random(4)
    rows = [(i, i % 3 and 7, 1000 * draw.randrange(40), draw.choice(["purchase", "click"]), draw.randrange(50_000) / 100) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, epoch long, event_type string, value double")
    monkeypatch.setattr(events_log, "event_log", lambda *_: frame)
    monkeypatch.setattr(events_log, "SLICE_EVENTS", slice_events)
    assert events_log._slices(frame, "value").agg({"e": "count"}).first()[0] > 2
    assert all(len(r.e) <= slice_events for r in events_log._slices(frame, "value").collect())
    average, energy = {}, {}
    for _, user, _, kind, value in sorted(rows, key=lambda r: (r[2], r[0])):
        average[user] = average.get(user, 0.0) * 0.85 + value * 0.15
        energy[user] = min(max(energy.get(user, 1000.0) + (-value if kind == "purchase" else 12.0), 0.0), 1000.0)
    assert {r.user_id: r.average for r in events_log.outcome_average(spark, "").collect()} == pytest.approx(average, abs=1e-6)
    assert {r.user_id: r.energy for r in events_log.energy_balance(spark, "").collect()} == pytest.approx(energy, abs=1e-6)
    exact = {r.event_type: r for r in frame.groupBy("event_type").agg({"value": "max"}).collect()}
    found = {r.event_type: r for r in events_log.value_percentiles(spark, "").collect()}
    assert found.keys() == exact.keys()
    for kind, r in found.items():
        want = frame.where(frame.event_type == kind).selectExpr("percentile(value, array(0.5, 0.95, 0.99)) as p").first().p
        assert [r.p50, r.p95, r.p99] == pytest.approx(want, abs=1e-6)
