"""The vector search by lists holds bounded pieces, in one Python worker a task, and assigns lists as the plain order does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from paths import SF

from shoal.operators import similarity
from shoal.queries import QUERIES


def test_pieces_of_a_large_batch_are_bounded(monkeypatch):
    monkeypatch.setattr(similarity, "SCORES", 1 << 10)
    rng = np.random.default_rng(0)
    x, lists = rng.normal(size=(700, 8)), rng.normal(size=(50, 8))
    batch = pa.record_batch([pa.array(np.arange(700)), pa.array(x.tolist())], ["id", "v"])
    for probes in (1, 7, 50):
        pieces = list(similarity._near_lists([batch], lists, probes))
        assert max(p.num_rows for p in pieces) * len(lists) <= 1 << 10
        got = {i: near for p in pieces for i, near in zip(p.column(0).to_pylist(), p.column(2).to_pylist())}
        assert got == {i: row.tolist() for i, row in enumerate(np.argsort(-(x @ lists.T), axis=1, kind="stable")[:, :probes])}


def test_no_second_python_worker_a_task(spark):
    """Vectors are normalised once and lists assigned by one map: no evaluation of Python functions beside it."""
    plan = QUERIES["knn_lsh"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" in plan
