"""Average hashes need neither a join nor a shuffle, and equal the plain loop."""

from __future__ import annotations

import numpy as np
from paths import SF

from shoal.functions.vectors import average_hash
from shoal.queries import QUERIES


def test_no_join_and_no_shuffle(spark):
    plan = QUERIES["average_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_equals_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [int(x) for x in rng.integers(0, 256, 64)]) for k in range(30)]
    rows += [(90, [7] * 64), (91, [None] * 64), (92, [0] * 63 + [255]), (93, [None] + [200] * 31 + [100] * 32), (None, [1] * 64), (94, None), (95, [])]
    got = {r.image_id: r.hash for r in average_hash(spark.createDataFrame(rows, "image_id long, luma array<long>")).collect()}
    want = {}
    for k, values in rows[:-3]:
        known = [x for x in values if x is not None]
        mean = sum(known) // len(known) if known else None
        want[k] = f"{sum(1 << i for i, x in enumerate(values) if x is not None and x >= mean):016x}"
    assert got == want
