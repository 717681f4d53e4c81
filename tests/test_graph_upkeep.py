"""Closures by doubling, kept up to date as edges come and go."""

from __future__ import annotations

import random

import pytest

from shoal.operators import graph


def plain(edges):
    """Shortest distances by breadth-first search from each node."""
    out = {}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
    for a in near:
        seen, front, d = {a}, {a}, 0
        while front:
            d += 1
            front = {c for x in front for c in near.get(x, ())} - seen
            seen |= front
            out.update({(a, c): d for c in front})
    return out


def table(spark, edges):
    return spark.createDataFrame(list(edges), "parent long, child long")


def pairs(df):
    rows = [tuple(r) for r in df.select("ancestor", "node", "distance").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {(a, b): d for a, b, d in rows}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_edges_coming_and_going(spark, seed):
    rng = random.Random(seed)
    n = 14
    some = lambda k: {(rng.randrange(n), rng.randrange(n)) for _ in range(k)}
    edges, new = some(18), some(5)
    reached = graph.closure(table(spark, edges))
    assert pairs(reached) == plain(edges)
    more = graph.closure_with(reached, table(spark, new))
    assert pairs(more) == plain(edges | new)
    gone = set(rng.sample(sorted(edges | new), 6))
    fewer = graph.closure_without(more, table(spark, gone), table(spark, (edges | new) - gone))
    assert pairs(fewer) == plain((edges | new) - gone)


def test_tree_loses_and_gains_a_branch(spark):
    edges = {(k // 2, k) for k in range(2, 64)}
    reached = graph.closure(table(spark, edges))
    without = graph.closure_without(reached, table(spark, {(1, 2)}), table(spark, edges - {(1, 2)}))
    assert pairs(without) == plain(edges - {(1, 2)})
    moved = graph.closure_with(without, table(spark, {(3, 2)}))
    assert pairs(moved) == plain(edges - {(1, 2)} | {(3, 2)})
    assert graph.closure(table(spark, [])).count() == 0 and graph.closure(table(spark, [(1, 1), (None, 2)])).count() == 0


def test_a_chain_of_4096_takes_thirteen_rounds_at_most(spark, monkeypatch):
    rounds = []
    plain_written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or plain_written(df, name))
    chain = spark.range(4096).selectExpr("id AS parent", "id + 1 AS child")
    assert graph.closure(chain).count() == 4096 * 4097 // 2
    assert len(rounds) - 1 <= 13  # the first writes the edges
