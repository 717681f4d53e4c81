"""All-pairs search of perceptual hashes against brute force."""

from __future__ import annotations

import numpy as np
from paths import SF

from shoal.operators.similarity import perceptual
from shoal.queries import QUERIES
from shoal.sources.views import Tables


def test_phash_pairs_of_every_asset(spark):
    h = np.unique([r.hash for r in perceptual(Tables(spark, SF)).select("hash").collect()])
    a, b = np.triu_indices(len(h), 1)
    d = np.bitwise_count(h[a].view(np.uint64) ^ h[b].view(np.uint64))
    near = d <= 10
    got = [tuple(r) for r in QUERIES["phash_pairs_all"](spark, SF).select("a", "b", "distance").collect()]
    assert sorted(got) == sorted(zip(h[a[near]].tolist(), h[b[near]].tolist(), d[near].tolist()))
