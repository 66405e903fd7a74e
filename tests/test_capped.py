"""Relations with a cap against adding them one by one."""

import random

import pytest

from lodestar.operators.capped import add_relations, remove_nodes

SCHEMA = "a long, b long, kind string, seq long, strength double"


def one_by_one(rows, most):
    held, pairs, out = {}, set(), []
    for a, b, kind, seq, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[3]):
        pair = (min(a, b), max(a, b), kind)
        if pair in pairs:
            continue
        if held.get(a, 0) < most and held.get(b, 0) < most:
            out.append(seq)
            pairs.add(pair)
            for end in {a, b}:
                held[end] = held.get(end, 0) + 1
    return sorted(out)


def seqs(frame):
    return sorted(r.seq for r in frame.collect())


def test_star(spark):
    rows = [(0, i, "similar", i, 0.5) for i in range(1, 61)]
    assert seqs(add_relations(spark.createDataFrame(rows, SCHEMA))) == list(range(1, 51))


@pytest.mark.parametrize("seed, nodes, most", [(1, 12, 3), (2, 40, 2), (3, 8, 1), (4, 30, 50)])
def test_random(spark, seed, nodes, most):
    draw = random.Random(seed)
    order = draw.sample(range(1000), 200)
    pairs = [(0 if draw.random() < 0.4 else draw.randrange(nodes), draw.randrange(nodes)) for _ in order]
    rows = [(a, b, draw.choice("st"), s, 0.1) for (a, b), s in zip(pairs, order, strict=True)] + [(None, 1, "s", 5000, 0.1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # a pair that comes again after the first was refused is refused as well: its end is still full
    assert seqs(add_relations(frame, most)) == one_by_one(rows, most)
    assert add_relations(frame.limit(0), most).count() == 0


def test_remove(spark):
    rows = [(1, 2, "s", 1, 0.1), (2, 3, "s", 2, 0.1), (3, 4, "s", 3, 0.1)]
    left = remove_nodes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(2,), (9,)], "id long"))
    assert left.columns == ["a", "b", "kind", "seq", "strength"] and seqs(left) == [3]


@pytest.mark.parametrize("most", [1, 3])
def test_nearest_without_a_table_of_pairs(spark, most):
    import numpy as np

    from lodestar.operators.capped import add_nearest

    x = np.random.default_rng(most).normal(size=(120, 5)).round(2)
    x[30:45] = x[3]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    order = sorted((-round(min(cosine[a, b], 1.0), 3), a, b) for a in range(120) for b in range(a + 1, 120) if cosine[a, b] > 0.3)
    want = one_by_one([(a, b, "s", n, -s) for n, (s, a, b) in enumerate(order)], most)
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], "id long, embedding array<double>")
    found = add_nearest(frame, 0.3, most, 3).collect()
    assert sorted((r.a, r.b) for r in found) == sorted(order[n][1:] for n in want)
