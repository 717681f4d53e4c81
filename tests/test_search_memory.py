"""A block of a vector search holds a bounded number of scores at once, and finds what a full sort finds."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from shoal.operators import similarity


def frame(x, start=0):
    return pd.DataFrame({"id": np.arange(start, start + len(x)), "v": list(x)})


def test_full_block_in_bounded_memory():
    rng = np.random.default_rng(0)
    q, r = (frame(rng.normal(size=(n, 16))) for n in (similarity.QUERIES, similarity.ROWS))
    tracemalloc.start()
    similarity._best(q, r, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all scores of a block and their order were 200 MB


def test_ties_and_own_rows_as_a_full_sort(monkeypatch):
    monkeypatch.setattr(similarity, "SCORES", 50)
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, size=(60, 3)).astype(float)
    x = np.concatenate((x, x[:20]))
    got = similarity._best(frame(x[:30]), frame(x).sample(frac=1, random_state=0), 5)
    for k in range(30):
        want = sorted((-float(x[k] @ x[j]), j) for j in range(len(x)) if j != k)[:5]
        own = got[got["query_id"] == k]
        assert sorted(zip(-own["score"], own["id"])) == want
    assert len(similarity._best(frame(x[:2]), frame(x[:2]), 5)) == 2
