"""What a metric join sends doesn't follow the square of its rows, and the pairs are those of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from plan_metrics import _nodes
from pyspark.sql import functions as F

from shoal.functions.vectors import l2_normalized
from shoal.operators import groups, metric


def sent(df) -> int:
    """Run ``df``; the rows that its plan shuffles."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return sum(int(n.metrics().apply("shuffleRecordsWritten").value()) for n in _nodes(execution.executedPlan()) if "ShuffleExchange" in n.getClass().getSimpleName())


def test_rows_sent_where_nothing_is_left_out(spark):
    """Vectors without clusters, 100 blocks a side: before, a row went to every block of queries, a query to every ball."""
    n = 1600
    x = np.random.default_rng(0).normal(size=(n, 8))
    rows = spark.createDataFrame(pa.table({"id": np.arange(n), "v": x.tolist()}))
    met = metric.in_balls(rows, rows, 50.0, lambda q, r: pd.DataFrame({"met": [len(q) * len(r)]}), "met long", block=16, together=16)
    assert sent(met) <= 2 * n * metric.SIDE
    assert sum(r.met for r in met.collect()) == n * n


def test_a_part_has_bounded_bytes():
    assert metric._parts(600_000, 64, metric.ROWS) == metric.SIDE
    assert metric._parts(40_000_000, 64, metric.ROWS) * metric.HELD >= 40_000_000 * 64 * 8


def test_pairs_at_the_threshold():
    """Single precision can't tell these pairs; doubles do."""
    angle = np.arccos(0.45) + np.array([-1e-7, -1e-12, 1e-12, 1e-7, 0.1, -0.1])
    q, r = np.array([[1.0, 0.0]] * 3), np.column_stack((np.cos(angle), np.sin(angle)))
    a, b = groups._linked(q, r, 0.55)
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(3) for j in (0, 1, 5)]


def test_links_of_a_task_stay_few(monkeypatch):
    monkeypatch.setattr(groups, "LINKS", 200)
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"u": rng.integers(0, 50, 120), "v": rng.integers(50, 100, 120)}) for _ in range(40)]
    assert sum(len(f) for f in groups._fewer(iter(frames))) < 100


def test_unit_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1e-3] * 7), (6, [1.0, None])]
    got = {r.id: r.u for r in spark.createDataFrame(rows, "id long, v array<float>").select("id", l2_normalized(F.col("v")).alias("u")).collect()}
    assert got[1] == [0.6, 0.8] and got[2] == [0.0, 0.0] and got[3] is None and got[4] == [] and got[6] == [1.0, None]
    assert np.allclose(got[5], 7**-0.5, rtol=1e-12)
