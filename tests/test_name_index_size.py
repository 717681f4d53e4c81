"""The name index shuffles the grams of blocks, not the signs of all texts, and searches over many blocks stay exact."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.plans import names
from shoal.plans.names import NameIndex
from shoal.shared import fresh_path


def test_postings_follow_blocks(spark):
    """20 000 texts of 20 signs have 360 000 grams; before, each was a posting with its text."""
    rows = spark.range(0, 20_000, 1, 4).select("id", F.format_string("/library/part-%07d", F.col("id")).alias("text"))
    index = NameIndex.create(rows, fresh_path(spark, "names"))
    assert spark.read.parquet(f"{index.path}/postings").count() < 20_000
    assert sorted(r.id for r in index.contains("t-00123%5").collect()) == sorted(r.id for r in rows.where(F.col("text").ilike("%t-00123%5%")).collect())


@pytest.mark.parametrize("chunks, ranges", [(1 << 12, 64), (1 << 12, 3), (1, 64)])
def test_many_blocks(spark, monkeypatch, chunks, ranges):
    """Hits all over, as ranges, as fewer ranges with what lies between, and as chunks that are joined."""
    for name, value in (("BLOCK", 3), ("CHUNKS", chunks), ("RANGES", ranges)):
        monkeypatch.setattr(names, name, value)
    rows = spark.range(0, 6000, 1, 3).selectExpr("id", "CASE WHEN id % 97 = 0 THEN concat('Needle_', id) WHEN id % 31 = 0 THEN concat('needed ', id, ' nettle') ELSE concat('straw-', id) END AS text")
    index = NameIndex.create(rows.where("id % 4 > 0"), fresh_path(spark, "names"))
    index.append(rows.where("id % 4 = 0"))
    index.remove(rows.where("id % 5 = 0").select("id"))
    want = [k for k in range(6000) if k % 97 == 0 and k % 5]
    assert sorted(r.id for r in index.contains(r"needle\_").collect()) == want


def test_ranges():
    rng = np.random.default_rng(0)
    blocks = [(s, int(b)) for s in (1, 2) for b in rng.choice(5000, 400, replace=False)]
    found = names._ranges(blocks)
    assert len(found) <= names.RANGES and all(any(s == t and a <= b <= z for t, a, z in found) for s, b in blocks)
    assert names._ranges([(1, 4), (1, 5), (1, 9), (3, 10)]) == [(1, 4, 5), (1, 9, 9), (3, 10, 10)]


def test_codes_equal_the_engine_s_grams(spark):
    texts = ["", "a", "ab", "abc", "İstanbul", "ΣΑΣ", "a\U0001f600b\U0001f600c", "  x ", "abcabc"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"), names.grams(F.col("t")).alias("g")).collect()
    code, at = names._codes([r.t for r in frame])
    got = [{names._gram(int(c)) for c, k in zip(code, at) if k == i} for i in range(len(texts))]
    assert got == [set(r.g) for r in frame]
