"""Recall by expansion against paths that are followed one by one."""

import random
from collections import Counter

import pytest

from lodestar.operators import recall as R


def by_hand(seeds, relations, clusters, depth):
    """Highest score that comes in over all walks; (query, row) -> score."""
    out = {}
    edges = relations + [(b, a, s) for a, b, s in relations]
    front = list(seeds)
    for level in range(depth):
        step = [(q, b, max(score, s)) for q, i, score in front for a, b, s in edges if a == i]
        if level + 1 < depth:
            step += [(q, m, 0.5 * score) for q, i, score in front for m, c in clusters if m != i and (i, c) in clusters]
        best = {}
        for q, i, score in step:
            best[q, i] = max(score, best.get((q, i), 0.0))
        for key, score in best.items():
            out[key] = max(score, out.get(key, 0.0))
        front = [(q, i, s) for (q, i), s in best.items()]
    return out


def frames(spark, seeds, relations, clusters):
    return (
        spark.createDataFrame(seeds, "query_id long, id long, score double"),
        spark.createDataFrame(relations, "a long, b long, strength double"),
        spark.createDataFrame(clusters, "id long, cluster long"),
    )


def test_expand(spark):
    draw = random.Random(8)
    seeds = [(q, draw.randrange(60), round(draw.random(), 3)) for q in range(4) for _ in range(3)]
    seeds = [(q, i, s) for (q, i), s in {(q, i): s for q, i, s in seeds}.items()]
    relations = [(a, b, round(draw.random(), 3)) for a, b in {(draw.randrange(60), draw.randrange(60)) for _ in range(70)} if a != b]
    clusters = [(i, i % 9) for i in range(0, 60, 2)]
    asked, edges, members = frames(spark, seeds, relations, clusters)
    for depth, peers in ((1, True), (3, True), (3, False), (0, True)):
        got = {(r.query_id, r.id): r.assoc for r in R.expand(asked, edges, depth, members if peers else None).collect()}
        assert got == by_hand(seeds, relations, clusters if peers else [], depth)


def test_recall_keeps_the_best(spark):
    seeds = [(1, i, 0.9 - i / 100) for i in range(20)]
    relations = [(0, 100 + i, 0.001 * i) for i in range(50)] + [(0, 1, 0.95)]
    asked, edges, members = frames(spark, seeds, relations, [])
    found = R.recall(asked, edges, members, 1).orderBy("rank").collect()
    assert len(found) == 40 and [r.rank for r in found] == list(range(1, 41))
    assert [(r.id, r.direct, r.assoc) for r in found[:2]] == [(0, 0.9, 0.95), (1, 0.89, 0.95)]  # a relation leads both ways
    # what comes over a relation has at least the seed's own score; of 50 equal ones the 30 lowest ids are kept
    assert {r.id for r in found if not r.direct} == set(range(100, 130))
    assert {r.assoc for r in found if not r.direct} == {0.9}


def test_hot_cluster_is_not_paired_with_itself(spark):
    """All members of a cluster of 3,000 are seeds: two of them stand for all."""
    seeds = [(1, i, i / 3000) for i in range(3000)]
    asked, edges, members = frames(spark, seeds, [], [(i, 5) for i in range(3001)])
    got = {r.id: r.score for r in R._to_peers(asked, members).collect()}
    assert got[0] == got[3000] == 0.5 * 2999 / 3000 and got[2999] == 0.5 * 2998 / 3000


def test_sections(spark):
    found = spark.createDataFrame([(1, 1, 0.5, 0.0, 2), (1, 2, 0.0, 0.7, 1), (1, 3, 0.2, 0.1, 3)], "query_id long, id long, direct double, assoc double, rank int")
    sections = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id long, section string")
    got = sorted((r.id, r.section, r.section_rank) for r in R.in_sections(found, sections.where("id < 3")).collect())
    assert got == [(1, "b", 2), (2, "a", 1), (3, "general", 3)]


def test_reached_count_stops_at_most(spark):
    from lodestar.operators.recall import reached_count

    rel = spark.createDataFrame([(i, i + 1, 0.5) for i in range(30)] + [(100, b, 0.4) for b in range(101, 200)], "a long, b long, strength double")
    seeds = spark.createDataFrame([(1, 0, 0.9), (2, 100, 0.9), (2, 5, 0.1), (3, 999, 0.2), (4, 10, 0.3), (4, 12, 0.3)], "query_id long, id long, score double")
    assert {r.query_id: r.n for r in reached_count(seeds, rel, 3, 30).collect()} == {1: 4, 2: 30, 3: 1, 4: 9}
    edges = spark.createDataFrame([(7, b, 0.4) for b in range(101, 200)], "a long, b long, strength double")
    assert reached_count(seeds.where("query_id = 2"), rel.union(edges), 3, 30).first().n == 30


def test_words_are_looked_for_once_a_row(spark):
    from lodestar.operators import intent_search as S

    rows = spark.createDataFrame([(1, "Ada naps", ["entity:Ada", "xnaps"]), (2, "", []), (3, None, ["b"])], "id long, content string, labels array<string>")
    queries = spark.createDataFrame([(9, ["ada", "nap", "ada", "x"]), (8, []), (7, ["b"])], "query_id long, terms array<string>")
    pairs = spark.createDataFrame([(q, i) for q in (9, 8, 7) for i in (1, 2, 3)], "query_id long, id long")
    found = {(r.query_id, r.id): tuple(round(x, 4) for x in r[2:]) for r in S.parts(rows, queries, pairs).collect()}
    assert len(found) == 9 and found[9, 1][1:] == (0.75, 1.0, 1.0, 0.5) and found[8, 1] == (0, 0, 0, 0, 0) and found[7, 3][1:] == (0, 1, 1, 0)
    assert found[9, 1][0] > 0 == found[9, 2][0] and found[7, 3][0] > 0


def _components(relations):
    least = {i: i for a, b, _ in relations for i in (a, b)}
    for _ in least:
        for a, b, _ in relations:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(least.items())


@pytest.mark.parametrize("case", range(4))
def test_connected_as_step_by_step(spark, monkeypatch, case):
    """Few rows or all of a component fit the result; scores tie; strengths are all above, below or among the seeds' scores."""
    monkeypatch.setattr(R, "FEW", case)
    draw = random.Random(case)
    size, low, high = [(40, 0, 9), (150, 0, 3), (150, 5, 9), (300, 0, 6)][case]
    relations = [(a, b, draw.randint(low, high) / 10) for a, b in sorted({tuple(sorted(draw.sample(range(size), 2))) for _ in range(size * (1 + case % 3))})]
    relations += [(900, 901, 0.7), (910, 911, 0.2), (911, 912, 0.1)]
    seeds = [(q, i, draw.randint(1, 6) / 10) for q in range(8) for i in draw.sample([*range(size), 900, 910, 912, 950], draw.choice([1, 2, 6]))]
    seeds += [(20, 900, 0.3), (21, 910, 0.3), (22, 950, 0.5), (23, 900, 0.2), (23, 901, 0.4)]
    asked, edges, members = frames(spark, seeds, relations, _components(relations))
    got = sorted(tuple(r) for r in R.recall_connected(asked, edges, members).select("query_id", "rank", "id", "direct", "assoc").collect())
    assert got == sorted(tuple(r) for r in R.recall(asked, edges, members, 3).select("query_id", "rank", "id", "direct", "assoc").collect())
    assert max(Counter(q for q, *_ in got).values()) > 30


def test_connected_follows_few_rows(spark, monkeypatch):
    """A component of 3,000 rows with a hub: what is met, for 40 queries, are a few rows each and not the component."""
    sizes, keep = {}, R.materialize

    def count(df, name):
        table = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(R, "materialize", count)
    relations = [(0, i, 0.4 + i % 7 / 100) for i in range(1, 3000)] + [(i, i + 1, 0.5) for i in range(1, 2999)]
    seeds = [(q, 10 * q + 5, 0.3) for q in range(40)]
    asked, edges, members = frames(spark, seeds, relations, [(i, 0) for i in range(3000)])
    assert R.recall_connected(asked, edges, members).count() == 40 * 31
    assert max(n for name, n in sizes.items() if name not in ("recall-most", "recall-rows")) <= 40 * 100


def test_second_step_starts_from_few(spark, monkeypatch):
    """Seeds that tie, each with 120 neighbours: the second step doesn't lead from all of them to all of the component."""
    sizes, keep = {}, R.materialize

    def count(df, name):
        table = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(R, "materialize", count)
    relations = [(i, (i + d) % 600, 0.5) for i in range(600) for d in range(1, 61)]
    seeds = [(q, (31 * q + 190 * n) % 600, 0.9) for q in range(10) for n in range(3)]
    asked, edges, members = frames(spark, seeds, relations, [(i, 0) for i in range(600)])
    got = sorted(tuple(r) for r in R.recall_connected(asked, edges, members).select("query_id", "rank", "id", "direct", "assoc").collect())
    assert sizes["recall-two"] <= 500
    monkeypatch.setattr(R, "materialize", keep)
    assert got == sorted(tuple(r) for r in R.recall(asked, edges, members, 3).select("query_id", "rank", "id", "direct", "assoc").collect())
