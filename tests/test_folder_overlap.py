"""Folder overlaps against plain counting, and how many candidates the prefixes leave."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shoal.operators import stats


def assets(spark, rows):
    return spark.createDataFrame([(k, f, c) for k, (f, c) in enumerate(rows)], "id long, folder_id long, content_key string").withColumns({"is_deleted": F.lit(False), "is_missing": F.lit(False)})


def plain(rows, share):
    size, held = {}, {}
    for f, c in rows:
        size[f] = size.get(f, 0) + 1
        held.setdefault(f, set()).add(c)
    out = set()
    for a, b in itertools.combinations(sorted(held), 2):
        shared, smaller = len((held[a] & held[b]) - {None}), min(size[a], size[b])
        if shared and shared / smaller > share:
            out.add((a, b, shared, smaller))
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.9])
def test_against_plain_counting(spark, share):
    rng = random.Random(int(share * 10))
    common = [f"c{k}" for k in range(12)]
    rows = [(f, rng.choice(common) if rng.random() < 0.7 else f"own{f}-{k}") for f in range(40) for k in range(rng.randint(1, 8))] + [(3, None), (99, None)]
    got = {tuple(r) for r in stats.folder_overlap(assets(spark, rows), share).select("a", "b", "shared", "smaller").collect()}
    assert got == plain(rows, share) and got


def test_a_content_of_ten_thousand_folders_makes_few_candidates(spark):
    """Every folder holds the same cover beside contents of its own: no pair is similar, and none is looked at."""
    held = spark.range(10_000).selectExpr("id AS folder", "explode(array('cover', concat('a', id), concat('b', id), concat('c', id div 2))) AS content_key")
    sizes = held.groupBy("folder").agg(F.count("*").alias("size"))
    assert stats.overlap_candidates(held, sizes, 0.5).count() < 1_000_000
    assert stats.overlap_candidates(held, sizes, 0.4).count() == 5000  # those that share c and the cover
