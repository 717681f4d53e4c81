"""On vectors without clusters the index visits, and scores again, as many as nine of ten true neighbours need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shoal.operators.vectorindex import VectorIndex
from shoal.shared import fresh_path


def test_recall_without_clusters(spark):
    n = 48_000
    x = np.random.default_rng(0).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame(pa.table({"id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))}))
    index = VectorIndex.create(rows, fresh_path(spark, "vectors"), sample=4000)
    found = {(r.query_id, r.id) for r in index.search(rows.where("id % 480 = 0")).collect()}
    asked = np.arange(0, n, 480)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(i)) for q, top in zip(asked, np.argsort(-score, axis=1)[:, :10]) for i in top}
    recall = len(found & want) / len(want)
    assert recall >= 0.9, recall
