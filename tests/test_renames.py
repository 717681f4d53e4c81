"""Rename batches against renames one by one; upserts whose batch repeats keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shoal.operators import changes, renames


def one_by_one(identities, ops):
    """Names and where each merged identity's detections end, by the plain loop."""
    names, moved = dict(identities), {i: i for i in identities}
    for i, name in ops:
        name = name.strip()
        if i not in names:
            continue
        holder = next((j for j, n in names.items() if n == name), None)
        if holder is not None and holder != i:
            del names[i]
            moved = {k: holder if v == i else v for k, v in moved.items()}
        else:
            names[i] = name
    return names, moved


def batch(spark, identities, ops):
    ids = spark.createDataFrame(list(identities.items()), "identity_id long, name string")
    found = spark.createDataFrame([(k, i) for k, i in enumerate(identities)] + [(-1, None)], "id long, identity_id long")
    asked = spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(ops)], "seq int, identity_id long, name string")
    left, moved = changes.identity_merge(ids, found, asked)
    at = {r.id: r.identity_id for r in moved.collect()}
    assert at.pop(-1) is None
    return dict(map(tuple, left.collect())), {i: at[k] for k, i in enumerate(identities)}


ABC = {1: "a", 2: "b", 3: "c"}


@pytest.mark.parametrize("ops,names,moved", [
    ([(1, "b"), (2, "c")], {3: "c"}, {1: 3, 2: 3, 3: 3}),  # a chain
    ([(1, "b"), (2, "a")], {2: "a", 3: "c"}, {1: 2, 2: 2, 3: 3}),  # a swap
    ([(1, "x"), (1, "y")], {1: "y", 2: "b", 3: "c"}, {1: 1, 2: 2, 3: 3}),  # a repeat
    ([(1, "x"), (2, "x"), (1, "y"), (3, "x")], {1: "y", 3: "x"}, {1: 1, 2: 1, 3: 3}),  # a name given up and taken
    ([(1, "b"), (2, "c"), (3, "a")], {3: "a"}, {1: 3, 2: 3, 3: 3}),  # a cycle
    ([(7, "b"), (1, " a "), (2, "b")], ABC, {1: 1, 2: 2, 3: 3}),
    ([], ABC, {1: 1, 2: 2, 3: 3}),
])
def test_known_batches(spark, ops, names, moved):
    assert one_by_one(ABC, ops) == (names, moved)
    assert batch(spark, ABC, ops) == (names, moved)


@pytest.mark.parametrize("seed", range(6))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    identities = {k: f"n{k}" for k in range(14)}
    names = [f"n{k}" for k in range(16)] + [" n3", "x"]
    ops = [(rng.randrange(15), rng.choice(names)) for _ in range(rng.choice([10, 25, 40]))]
    assert batch(spark, identities, ops) == one_by_one(identities, ops)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 300, []
    plain = renames.written
    monkeypatch.setattr(renames, "written", lambda df, name: rounds.append(name) or plain(df, name))
    ids = {k: f"n{k}" for k in range(n)}
    names, moved = batch(spark, ids, [(k, f"n{k + 1}") for k in range(n - 1)])
    assert names == {n - 1: f"n{n - 1}"} and set(moved.values()) == {n - 1}
    assert rounds.count("renames") <= 4 and rounds.count("links") <= 12


def test_repeated_keys_in_a_batch(spark):
    old = spark.createDataFrame([(1, "a", "e1"), (2, "b", "e2"), (None, "n", "e")], "k long, v string, etag string")
    new = spark.createDataFrame([(1, 1, "x", "first"), (2, 1, "z", None), (1, 3, "q", "q"), (2, 3, "r", None), (3, None, "m", None)], "seq int, k long, v string, etag string")
    got = sorted(map(tuple, changes.keyed_upsert(old, new, ["k"], ["etag"], "seq").collect()), key=repr)
    assert got == sorted([(1, "z", "first"), (2, "b", "e2"), (3, "r", "q"), (None, "m", "e")], key=repr)
    assert changes.keyed_upsert(old, new.drop("seq"), ["k"]).count() == 4
    flags = spark.createDataFrame([(1, True)], "k long, n boolean")  # names that the operator uses within
    assert list(map(tuple, changes.keyed_upsert(flags, flags.select("k", (~F.col("n")).alias("n")), ["k"]).collect())) == [(1, False)]


def test_repeated_scores(spark):
    assets = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None)], "id long, s double")
    scores = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.5), (1, 3, 0.3)], "seq int, id long, s double")
    assert sorted(map(tuple, changes.score_writeback(assets, scores, ["s"], "seq").collect())) == [(1, 0.5), (2, 0.2), (3, 0.3)]
