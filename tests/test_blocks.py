"""Products of blocks against all pairs."""

import numpy as np
import pytest

from lodestar.operators import blocks as B
from lodestar.operators.components import connected_components
from lodestar.plans import graphs

LEAST = 0.4


@pytest.fixture(scope="module")
def given(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 8)).round(3)
    x[40:60] = x[0]
    x[60] = 0
    rows = [(int(i) * 3, [float(v) for v in x[i]], f"k{i % 4}") for i in draw.permutation(300)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-10)[:, None]
    cosine = np.minimum(unit @ unit.T, 1.0)
    pairs = {(3 * a, 3 * b): cosine[a, b] for a in range(300) for b in range(a + 1, 300) if cosine[a, b] > LEAST}
    return spark.createDataFrame([*rows, (None, [1.0] * 8, "k0"), (2000, None, "k0")], "id long, embedding array<double>, kind string"), pairs


@pytest.fixture(params=[(16, 1024, 1024), (4, 40, 7)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(B, "GRID", request.param[0])
    monkeypatch.setattr(B, "PIECE", request.param[2])
    return request.param[1]


def test_rows_are_sent_grid_times(given):
    placed = B.meet(given[0], 5)
    assert placed.count() == B.GRID * 300 and B.sides(600_000, 1024) == B.GRID and B.sides(10_000_000, 1024) == 153


def test_pairs(given, sizes):
    rows, pairs = given
    found = B.similar_pairs(rows, LEAST, sizes, ("kind",)).collect()
    assert len(found) == len(pairs) and {(r.a, r.b) for r in found} == set(pairs)
    assert all(r.similarity == pytest.approx(pairs[r.a, r.b]) and r.kind_a == f"k{r.a // 3 % 4}" and r.kind_b == f"k{r.b // 3 % 4}" for r in found)


def test_links_hold_the_same_rows_together(spark, given, sizes):
    rows, pairs = given
    few = B.links(rows, 0.85, sizes)
    all_ = spark.createDataFrame([p for p, c in pairs.items() if c > 0.85], "a long, b long")
    groups = [{r.node: r.component for r in connected_components(e, "a", "b").collect()} for e in (few, all_)]
    assert groups[0] == groups[1] and len(set(groups[0].values())) > 1
    assert B.links(rows, LEAST).count() < 300 < len(pairs)


@pytest.mark.parametrize("decimals", [None, 1])
def test_neighbours(given, sizes, decimals):
    rows, pairs = given
    want = {}
    for (a, b), c in pairs.items():
        for one, other in ((a, b), (b, a)):
            want.setdefault(one, []).append((-(round(c, 9) if decimals is None else round(c, decimals)), other))
    found = B.neighbours(rows, 5, LEAST, 9 if decimals is None else decimals, sizes).toPandas()
    got = {a: set(part["b"]) for a, part in found.groupby("a")}
    assert got == {a: {b for _, b in sorted(near)[:5]} for a, near in want.items()}


def test_components_write_no_relations(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(graphs, "relations", None)
    for name in ("components", "component_sizes", "concepts", "inter_label_edges", "neighbour_top"):
        assert graphs.QUERIES[name](spark, sf_dir).count() > 0


def test_hops_write_no_relations(spark, sf_dir, given, sizes, monkeypatch):
    rows, pairs = given
    monkeypatch.setattr(graphs, "relations", None)
    assert graphs.QUERIES["bfs_hops"](spark, sf_dir).count() > 1
    monkeypatch.setattr(graphs, "LOT", 1)
    monkeypatch.setattr(graphs, "DISTANT", 0.8)
    monkeypatch.setattr(graphs, "vectors", lambda *_: rows)
    near = {p for p, c in pairs.items() if c > 0.8}
    want, front = {min(min(p) for p in near): 0}, {min(min(p) for p in near)}
    for hop in range(1, 5):
        front = {x for p in near if front & set(p) for x in p} - set(want)
        want |= dict.fromkeys(front, hop)
    assert {r.node: r.hop for r in graphs.QUERIES["bfs_hops"](spark, sf_dir).collect()} == want
