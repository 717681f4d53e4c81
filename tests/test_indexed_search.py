"""A search over stored indexes gives what one over scans gives, and reads less."""

from __future__ import annotations

import numpy as np
from paths import SF
from plan_metrics import scans
from pyspark.sql import functions as F

from shoal.operators import similarity
from shoal.operators.vectorindex import VectorIndex
from shoal.plans.fulltext import TextIndex
from shoal.plans.names import NameIndex, pieces
from shoal.plans.search import Search, library, search
from shoal.shared import fresh_path
from shoal.sources.views import Tables


def test_same_rows_as_scans(spark):
    t = Tables(spark, SF)
    plain, indexed = library(t), library(t)
    indexed.text_index = TextIndex.create(t.text_lines, fresh_path(spark, "text"))
    indexed.name_index = NameIndex.create(t.assets.select("id", F.col("path").alias("text")), fresh_path(spark, "names"))
    indexed.vector_index = VectorIndex.create(plain.vectors, fresh_path(spark, "vectors"))
    for ask in (Search(text="the NOT of", limit=50), Search(filename="LUST_1000%2", limit=50), Search(filename="x", limit=20), Search(text='"in the" OR could', tags=["red widget 3"], filename="clip", limit=50)):
        rows = [tuple(r) for r in search(plain, ask).collect()]
        assert [tuple(r) for r in search(indexed, ask).collect()] == rows
    near = Search(image_vector=plain.vectors.where("id = 3"), limit=30)
    want, got = ({r.id for r in search(lib, near).collect()} for lib in (plain, indexed))
    assert len(want & got) >= 0.9 * len(want)
    read = scans(search(indexed, Search(text="could", limit=5)))
    assert not any("conversations" in s for s, _ in read)


def test_names_against_ilike(spark):
    rng = np.random.default_rng(0)
    signs = list("abcABé_% .\\ß")
    rows = [(k, "".join(rng.choice(signs, rng.integers(0, 14)))) for k in range(400)] + [(900, None), (None, "abcabc"), (901, "İstanbul"), (902, "ΣΑΣ")]
    table = spark.createDataFrame(rows, "id long, text string")
    index = NameIndex.create(table, fresh_path(spark, "names"), bucket_rows=64)
    hits = 0
    for text in ("abc", "ab", "", "a%b", "a_c", "AB", "É_", "aba%", "bcé", r"a\%b", r"\_a", "abca", "zzz", "b c", "ist", "σας", "ΣΑ"):
        want = sorted(r.id for r in table.where("id IS NOT NULL").where(F.col("text").ilike(f"%{text}%")).collect())
        assert sorted(r.id for r in index.contains(text).collect()) == want, text
        hits += bool(want)
    assert hits > 8
    index.remove(table.where("id % 2 = 0").select("id"))
    assert all(r.id % 2 for r in index.contains("abc").collect())
    assert pieces(r"a%b_c\%d") == ["a", "b", "c%d"]


def test_rows_read_by_count_of_hits(spark):
    """Ten times the rows that don't match leave what a search reads."""
    read = []
    for n in (2000, 20_000):
        rows = spark.range(n).selectExpr("id", "CASE WHEN id < 30 THEN concat('needle-', id) ELSE concat('straw-', id % 89) END AS text")
        found = NameIndex.create(rows, fresh_path(spark, "names"), bucket_rows=4096).contains("needle-1")
        read.append(sum(k for _, k in scans(found)))
        assert found.count() == 11
    assert max(read) < 1500 and read[1] < read[0] + 1100
