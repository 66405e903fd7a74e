"""Splitting groups around their two least similar members, against trying all pairs."""

import random

import pytest

from lodestar.operators.splits import farthest_pairs, two_seed_split

SCHEMA = "group long, id long, labels array<string>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def by_hand(members):
    ids = sorted(members)
    if len(ids) < 2:
        return None, {i: "a" for i in ids}
    _, a, b = min((jaccard(members[x], members[y]), x, y) for x in ids for y in ids if x < y)
    side = lambda i: "a" if i == a or (i != b and jaccard(members[i], members[a]) >= jaccard(members[i], members[b])) else "b"
    return (a, b), {i: side(i) for i in ids}


@pytest.mark.parametrize("block", [3, 512])
def test_random_groups(spark, block):
    draw = random.Random(block)
    groups = {}
    for g, size in enumerate([1, 2, 3, 12, 40, 60]):
        kinds = [draw.choices("abcdefg", k=draw.randrange(4)) for _ in range(max(size // 3, 1))]
        groups[g] = {g * 100 + i: draw.choice(kinds) for i in range(size)}
    groups[6] = {600 + i: ["x", "y"] for i in range(5)}  # all alike
    groups[7] = {700: [], 701: []}
    rows = [(g, i, labels) for g, members in groups.items() for i, labels in members.items()]
    frame = spark.createDataFrame(rows, SCHEMA)
    pairs = {r.group: (r.a, r.b) for r in farthest_pairs(frame, block).collect()}
    sides = {r.id: r.side for r in two_seed_split(frame, block).collect()}
    for g, members in groups.items():
        pair, side = by_hand(members)
        assert pairs.get(g) == pair
        assert {i: sides[i] for i in members} == side


def test_empty(spark):
    assert two_seed_split(spark.createDataFrame([], SCHEMA)).count() == 0
