"""Grid joins of boxes against plain loops, in images with very many boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from shoal.operators import boxes

SCHEMA = "image_id long, box_id long, x0 double, y0 double, x1 double, y1 double, confidence double"


def frame(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "box_id", "x0", "y0", "x1", "y1", "confidence"]), SCHEMA)


def plain(rows, threshold):
    """Greedy suppression of one image, box by box."""
    rows = sorted(set(map(tuple, rows)), key=lambda r: (-r[6], r[1], r[2:6]))
    held, n, out = np.zeros((4, len(rows))), 0, []
    for r in rows:
        a, (x0, y0, x1, y1) = r[2:6], held[:, :n]
        w = np.minimum(x1, a[2]) - np.maximum(x0, a[0])
        at = np.flatnonzero(w > 0)
        w, x0, y0, x1, y1 = w[at], x0[at], y0[at], x1[at], y1[at]
        h = np.maximum(0, np.minimum(y1, a[3]) - np.maximum(y0, a[1]))
        union = (x1 - x0) * (y1 - y0) + (a[2] - a[0]) * (a[3] - a[1]) - w * h
        if not (w * h > threshold * np.where(union > 0, union, np.inf)).any():
            held[:, n] = a
            n += 1
            out.append((r[0], r[1]))
    return sorted(out)


def scattered(n, seed, image=1, field=1000.0, spots=None):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0, field, (n, 2)) if spots is None else rng.uniform(0, field, (spots, 2))[rng.integers(0, spots, n)] + rng.normal(size=(n, 2)) * 4
    size = np.exp(rng.normal(3, 0.8, (n, 2)))
    low = np.round(centre - size / 2, 3)
    return [(image, k, *low[k], *np.round(low[k] + size[k], 3), round(float(rng.random()), 3)) for k in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_rounds_equal_the_plain_loop(spark, threshold):
    rows = scattered(400, 1) + scattered(300, 2, image=2, spots=9) + [(3, 1, 0.0, 0.0, 0.0, 5.0, 0.5), (3, 2, 0.0, 0.0, 0.0, 5.0, 0.4), (3, 3, 0.0, 0.0, 5.0, 5.0, 0.3)]
    rows += rows[:5]
    want = sorted(x for k in (1, 2, 3) for x in plain([r for r in rows if r[0] == k], threshold))
    for folded in (1, 1000):
        assert sorted(map(tuple, boxes.suppressed(frame(spark, rows), threshold, folded).collect())) == want


def test_a_hundred_thousand_boxes_of_one_image(spark):
    """Scattered ones, and a detector's heaps of nearly equal ones."""
    rows = scattered(60_000, 3, field=12_000.0) + [(1, 100_000 + k, *r[2:]) for k, r in enumerate(scattered(40_000, 4, field=12_000.0, spots=150))]
    assert sorted(map(tuple, boxes.suppressed(frame(spark, rows)).collect())) == plain(rows, 0.5)


def test_centres_in_regions(spark):
    rng = np.random.default_rng(5)
    points, regions = scattered(500, 6) + scattered(100, 7, image=2), []
    for k in range(60):
        x, y, w, h = rng.uniform(0, 900), rng.uniform(0, 900), np.exp(rng.normal(3.5, 1.5)), np.exp(rng.normal(3.5, 1.5))
        regions.append((1 + k % 2, k, x, y, x + w, y + h))
    regions += [(1, 99, 50.0, 50.0, -80.0, 60.0), (1, 98, 10.0, 10.0, 10.0, 10.0)]
    table = spark.createDataFrame(pd.DataFrame(regions, columns=["image_id", "region", "x0", "y0", "x1", "y1"]))
    got = {(r.image_id, r.box_id): r.region for r in boxes.boxes_in_regions(frame(spark, points), table).collect()}
    for i, b, x0, y0, x1, y1, _ in points:
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        held = [r[1] for r in regions if r[0] == i and r[2] - 20 <= x <= r[4] + 20 and r[3] - 20 <= y <= r[5] + 20]
        assert got.pop((i, b)) == (max(held) if held else None)
    assert not got
