"""The source audit against plain Python and SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_corpus import FOLD, SCHEMA
from pyspark.sql import functions as F

from shoal.llm import divergence
from shoal.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """The audit of ``(text, lang, source)`` rows, in whole numbers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        terms = TERM.findall(text.translate(FOLD))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def share(c):
            size = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // size for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(found)]
    return sorted(out)


def corpus(seed=1):
    """Languages with many sources, with one, without kept terms; hot sources, groups without terms, terms of every kind."""
    rng = random.Random(seed)
    vocab = [f"w{c}é" for c in "abcdefghijklmnopqrstuvwxyz"] + ["The", "THE", "日本", "don't", "x_y", "a\x7fb", "ⅫX", "naïve", "NÏ", "\U0001d11e"]
    rows = []
    for k in range(400):
        lang = rng.choice(["en", "en", "en", None, ""])
        source = "hot" if rng.random() < 0.3 else rng.choice([None, "", "s1", "s2", "é", "z", *map(str, range(12))])
        words = rng.choices(vocab, [1 / (j + 1) for j in range(len(vocab))], k=rng.randint(0, 30))
        rows.append((rng.choice([" ", "\n", "7"]).join(words), lang, source))
    rows += [(None, "en", "silent"), ("12 34", "en", "digits"), ("few words", "rare", "a"), ("other words", "rare", "b"), (None, "rare", "c"), ("alone", "one", "one")]
    return rows + rows[:5] + [(" ".join(rng.choices(vocab, k=80_000)), "en", "s1")]


@pytest.mark.parametrize("segment,block", [(divergence.SEGMENT, divergence.BLOCK), (7, 3)])
def test_audit_against_plain_python(spark, segment, block):
    rows = corpus()
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    table = table.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "no", "item", "value", "rank", "segment", "place", "size", "rest")})
    got = divergence.audit(table, segment=segment, block=block)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain(rows)


def test_runs_and_their_intersection():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        columns = []
        for _ in range(2):
            dense = np.repeat(rng.integers(1, 4, n), rng.integers(1, 9, n))[:n] * int(rng.choice([1, 250_000_000]))
            rest = int(dense[0])
            at = np.flatnonzero(dense != rest)
            got = divergence.runs(at, dense[at], rest, n)
            assert (np.repeat(got[1], np.diff(np.append(got[0], n))) == dense).all() and (np.diff(got[1]) != 0).all()
            columns.append((dense, got))
        (a, ra), (b, rb) = columns
        assert divergence.divergence(ra, rb, n) == sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(a, b))


def test_large_counts_stay_exact(spark):
    n, total, terms = 10**17 + 3, 3 * 10**18 + 1, 10**9 + 7
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(divergence._smoothed(F.col("n"), F.col("total"), F.col("terms")).cast("long").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_order_clusters_equal_counts(spark):
    """Terms that occur alike in all sources lie side by side, so columns have few runs."""
    rows = [(" ".join(f"{kind}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)) + " ", "en", source) for kind, sources in (("a", "pq"), ("b", "qr"), ("c", "p")) for source in sources for _ in range(10)]
    counts = divergence.term_counts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"))
    named = counts.where("term IS NOT NULL").withColumn("no", F.ascii("source") - ord("p"))
    placed = {r.term: r.place for r in divergence.vocabulary(named).collect()}
    kinds = [t[0] for t in sorted(placed, key=placed.get)]
    assert len(placed) == 300 and sum(a != b for a, b in zip(kinds, kinds[1:])) == 2


def test_empty_table(spark, empty):
    assert divergence.audit(empty).count() == 0


def test_no_kept_terms(spark):
    rows = [("a b", "en", "x"), (None, "en", "y"), ("c", None, None)]
    got = divergence.audit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_query_and_its_sql(spark):
    got = QUERIES["op13_source_divergence"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_source_divergence"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
