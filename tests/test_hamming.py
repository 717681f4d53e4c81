"""Hash pairs against brute force on skewed hashes, and what the choice of bits saves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from shoal.operators import hamming


def table(spark, h):
    return spark.createDataFrame(pd.DataFrame({"hash": h.view(np.int64)}))


def plain(h, distance):
    """All pairs of distinct hashes within a distance, in blocks."""
    h = np.unique(h.view(np.int64))
    u, out = h.view(np.uint64), set()
    for k in range(0, len(u), 500):
        a, b = np.nonzero(np.bitwise_count(u[k : k + 500, None] ^ u[None, k:]) <= distance)
        out |= {(int(h[k + x]), int(h[k + y])) for x, y in zip(a, b) if x < y}
    return out


def skewed(n, seed=0):
    """Random hashes; a third have one prefix of 24 bits, a tenth differ little from another one, the lowest eight bits move together."""
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    third = rng.random(n) < 1 / 3
    h[third] = h[third] >> np.uint64(24) | np.uint64(0xABCDEF) << np.uint64(40)
    low = rng.integers(0, 2, n).astype(np.uint64) * np.uint64(0xFF)
    h = h & ~np.uint64(0xFF) | low
    near = rng.choice(n, n // 10, replace=False)
    h[near] = h[rng.integers(0, n, len(near))]
    for _ in range(7):
        h[near] ^= np.uint64(1) << rng.integers(8, 40, len(near)).astype(np.uint64)
    return h


@pytest.mark.parametrize("distance,crowded", [(10, None), (10, {1: 3, 2: 2}), (11, {1: 8}), (3, {1: 2, 2: 1}), (0, None)])
def test_equals_brute_force(spark, distance, crowded):
    h = np.concatenate([skewed(700, distance), np.array([0, 1, 3, (1 << 64) - 1, 1 << 63, 0], np.uint64)])
    frame = table(spark, h).unionByName(spark.createDataFrame([(None,)], "hash long"))
    got = [(r.a, r.b, r.distance) for r in hamming.hash_pairs(frame, distance, crowded).collect()]
    assert {x[:2] for x in got} == plain(h, distance) and len(got) == len({x[:2] for x in got})
    assert all(d == ((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b, d in got)


def test_no_hashes(spark):
    assert hamming.hash_pairs(spark.createDataFrame([], "hash long")).count() == 0


def test_bits_that_move_together_are_dealt_apart():
    order = hamming.bit_order(skewed(4096))
    assert sorted(order) == list(range(64))
    low = [sum(b < 8 for b in order[16 * k : 16 * k + 16]) for k in range(4)]
    assert max(low) <= 3


def test_chosen_bits_leave_fewer_candidates(spark):
    """On skewed hashes the plain bands' keys are crowded; the chosen ones are about as large as random hashes' keys."""
    h = np.unique(skewed(20_000, 5))

    def met(p):
        """Pairs that share a key, by sizes of keys: probes of up to two bits from each hash."""
        masks = np.array([m for m in range(1 << 16) if m.bit_count() <= 2])
        total = 0
        for k in range(4):
            n = np.bincount((p >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF, minlength=1 << 16)
            at = np.flatnonzero(n)
            total += int((n[at, None] * n[at[:, None] ^ masks]).sum())
        return total

    order = hamming.bit_order(h[np.random.default_rng(0).permutation(len(h))[:4096]])
    moved = sum(((h >> np.uint64(at)) & np.uint64(1)) << np.uint64(to) for to, at in enumerate(order))
    chosen = met(moved)
    assert chosen < met(h) / 3
    assert hamming.candidates(table(spark, h)).count() < chosen
