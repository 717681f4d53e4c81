"""Metric joins equal all pairs and leave most blocks out; the vector index finds what brute force finds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from plan_metrics import rows_read
from pyspark.sql import functions as F

from shoal.operators import groups, metric, similarity, vectorindex
from shoal.operators.vectorindex import VectorIndex
from shoal.shared import fresh_path


def clustered(n, dim, centres, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, start=0):
    return spark.createDataFrame([(start + k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


def near_pairs(distance):
    """Pairs of two blocks within a distance, and one row that tells how many pairs met."""

    def found(q, r):
        if not len(q) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "met": []}).astype("int64")
        d = np.linalg.norm(np.stack(q["v"])[:, None] - np.stack(r["v"])[None], axis=2)
        a, b = np.nonzero(d <= distance)
        return pd.DataFrame({"a": np.append(q["id"].to_numpy()[a], -1), "b": np.append(r["id"].to_numpy()[b], -1), "met": np.append(np.zeros(len(a), int), len(q) * len(r))})

    return found


@pytest.mark.parametrize("distance", [0.0, 0.2, 0.6, 3.0])
def test_equals_all_pairs(spark, distance):
    x, y = clustered(300, 8, 12), clustered(150, 8, 12, spread=0.3)
    x[5] = x[6]
    got = metric.in_balls(table(spark, y), table(spark, x), distance, near_pairs(distance), "a long, b long, met long", block=40, together=32).where("a >= 0")
    d = np.linalg.norm(y[:, None] - x[None], axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= distance))}
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_most_blocks_never_meet(spark):
    x = clustered(2000, 16, 40)
    met = metric.in_balls(table(spark, x), table(spark, x), 0.3, near_pairs(0.3), "a long, b long, met long", block=50).where("a < 0").agg(F.sum("met")).first()[0]
    assert met < 0.1 * len(x) ** 2


def test_one_point_nulls_and_empty_sides(spark):
    x = table(spark, np.tile(clustered(1, 4, 1), (30, 1)))
    every = metric.in_balls(x, x.unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>")), 0.1, near_pairs(0.1), "a long, b long, met long", block=7).where("a >= 0")
    assert every.count() == 900
    assert metric.in_balls(x, x.limit(0), 1.0, near_pairs(1.0), "a long, b long, met long").count() == 0


def test_identities_equal_plain_loop(spark):
    x = clustered(400, 16, 25, spread=0.2)
    owner = [k % 25 if k % 3 else None for k in range(400)]
    rows = spark.createDataFrame([(k, v.tolist(), o) for k, (v, o) in enumerate(zip(x, owner))], "id long, vector array<double>, identity_id int")
    means = {o: np.mean([v for v, p in zip(x, owner) if p == o], axis=0) for o in set(owner) - {None}}
    for mode in ("best", "first"):
        got = {r.detection_id: r.identity_id for r in similarity.identity_match(rows, rows, 0.7, mode).collect()}
        for k, v in enumerate(x):
            d = sorted((1 - v @ c, o) if mode == "best" else (o, 1 - v @ c) for o, c in means.items() if 1 - v @ c <= 0.7)
            assert got.get(k) == ((d[0][1] if mode == "best" else d[0][0]) if d else None)


def test_new_identities_equal_all_pairs(spark, monkeypatch):
    x = clustered(500, 12, 60, seed=2, spread=0.08)
    monkeypatch.setattr(groups, "in_balls", lambda q, r, d, f, s: metric.in_balls(q, r, d, f, s, block=40, together=60))
    got = {r.id: r.identity_id for r in groups.new_identities(table(spark, x), 0, 0.05).collect()}
    label = list(range(500))
    close = 1 - x @ x.T <= 0.05
    for _ in range(500):
        new = [min(label[j] for j in np.flatnonzero(close[k])) for k in range(500)]
        if new == label:
            break
        label = new
    names = {v: k + 1 for k, v in enumerate(sorted(set(label)))}
    assert got == {k: names[v] for k, v in enumerate(label)}


def test_index_of_a_hundred_thousand(spark):
    """Recall of 0.9 and more with under a tenth of the rows read; an append and a removal leave the files as they are."""
    n = 100_000
    x = clustered(n, 32, 2000, seed=3, spread=0.25)
    frame = spark.createDataFrame(pa.table({"id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float64()))}))
    index = VectorIndex.create(frame.where("id < 90000"), fresh_path(spark, "vectors"))
    learned = index.spark.read.parquet(f"{index.path}/quantizer").count()
    index.append(frame.where("id >= 90000"))
    assert index.spark.read.parquet(f"{index.path}/quantizer").count() == learned
    rng = np.random.default_rng(1)
    asked = rng.choice(n, 60, replace=False)
    queries = frame.where(F.col("id").isin([int(k) for k in asked]))
    got = index.search(queries).collect()
    found = {(r.query_id, r.id) for r in got}
    score = x[asked] @ x.T
    score[np.arange(60), asked] = -2
    want = {(int(q), int(i)) for q, top in zip(asked, np.argsort(-score, axis=1)[:, :10]) for i in top}
    assert len(found & want) >= 0.9 * len(want)
    assert all(abs(r.score - float(x[r.query_id] @ x[r.id])) < 1e-9 for r in got) and {r["rank"] for r in got} == set(range(1, 11))
    one = index.search(frame.where(F.col("id") == int(asked[0])))
    assert rows_read(one) < n / 10
    best = max(got, key=lambda r: (r.query_id == asked[0], r.score)).id
    index.remove(spark.createDataFrame([(best,)], "id long"))
    assert best not in {r.id for r in VectorIndex(spark, index.path).search(frame.where(F.col("id") == int(asked[0]))).collect()}
    index.append(frame.where(F.col("id") == best))
    assert best in {r.id for r in index.search(frame.where(F.col("id") == int(asked[0]))).collect()}


def test_index_of_few_and_equal_rows(spark):
    same = table(spark, np.tile(clustered(1, 6, 1), (40, 1))).unionByName(spark.createDataFrame([(None, [1.0] * 6), (77, None)], "id long, v array<double>"))
    index = VectorIndex.create(same, fresh_path(spark, "vectors"))
    got = index.search(same.where("id = 3"), 5).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 4, 5] and all(abs(r.score - 1) < 1e-9 for r in got)
    assert index.search(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.create(same.limit(0), fresh_path(spark, "vectors"))


def test_kmeans_keeps_empty_centres():
    x = np.array([[0.0], [0.0], [10.0]])
    assert sorted(vectorindex.kmeans(x, 3).ravel().tolist()) == [0.0, 0.0, 10.0]


def test_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.1]), (5, []), (6, [1.0])], "vec_id long, embedding array<double>")
    v = similarity.unit(rows)
    assert {(r.query_id, r.id) for r in similarity.knn_exact(v, v, 5).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    got = {r.id: r.identity_id for r in groups.new_identities(v.where("size(v) > 0"), 0, 0.2).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 6: 3}
