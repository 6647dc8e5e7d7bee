"""Ancestry against a plain search, and its rounds on a long line."""

import random

import pytest

from evidentia.operators import ancestry

EDGES = "child string, parent string"


def plain(edges, start):
    parents, found, todo = {}, {start}, [start]
    for child, parent in edges:
        if child is not None and parent is not None:
            parents.setdefault(child, []).append(parent)
    while todo:
        for p in parents.get(todo.pop(), ()):
            if p not in found:
                found.add(p)
                todo.append(p)
    return found


def made(seed, n):
    r = random.Random(seed)
    edges = [(f"c{i}", f"c{i - 1 if r.random() < 0.9 else r.randrange(i)}") for i in range(1, n)]
    edges += [(f"c{i}", f"c{r.randrange(i)}") for i in r.sample(range(5, n), n // 20)]
    return edges + edges[:10] + [("c3", None), (None, "c4")] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1")] + [("y1", "y2"), ("y2", "y3"), ("y3", "y1"), ("z", "y1"), ("s", "s")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, seed):
    edges = made(seed, 200)
    of = ["c199", "c120", "c57", "c0", "x2", "y2", "z", "s", "unknown", "c57"]
    got = ancestry.ancestors(spark.createDataFrame(edges, EDGES), of).collect()
    found = {}
    for row in got:
        found.setdefault(row.of, []).append(row.commit)
    assert {k: sorted(v) for k, v in found.items()} == {c: sorted(plain(edges, c)) for c in set(of)}


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = ancestry.written
    monkeypatch.setattr(ancestry, "written", lambda frame, name: rounds.append(name) or kept(frame, name))
    line = spark.range(1, 20_000).selectExpr("concat('c', id) AS child", "concat('c', id - 1) AS parent")
    assert ancestry.ancestors(line, ["c15000"]).count() == 15_001
    assert len(rounds) <= 14  # two doublings a table


def test_no_edges(spark):
    assert [tuple(r) for r in ancestry.ancestors(spark.createDataFrame([], EDGES), ["a"]).collect()] == [("a", "a")]
