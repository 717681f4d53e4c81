"""Line dedup, substring dedup and SimHash against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import importlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from llm_corpus import FOLD, WORD
from pyspark.sql import functions as F

from shoal.llm import lines, simhash, substrings
from shoal.llm.components import components


def counted(items):
    return Counter(items)


def test_lines_against_brute_force(docs, clashing, rows):
    held = defaultdict(set)  # documents: rows of one doc_id are one, rows without are one each
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for k, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add((i is not None, k if i is None else i))
    keeper = {x: max((i for named, i in held[x] if named), default=None) for x in held if len(held[x]) >= 3}
    want = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if key(x) not in keeper or keeper[key(x)] == i]
        want.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    for table in (docs, clashing):
        got = lines.drop_repeated_lines(table).select("doc_id", "n_lines", "n_dropped", "kept").collect()
        assert counted(map(tuple, got)) == counted(want)
    assert sum(w[2] for w in want) > 10


def test_rows_of_one_document_count_once(spark):
    line = "a line of more than twenty letters"
    two = [(1, line), (1, line), (2, line)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_dropped for r in lines.drop_repeated_lines(table(two)).collect()] == [0, 0, 0]
    got = lines.drop_repeated_lines(table([*two, (3, "x\n" + line + "\n" + line)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped, r.kept) for r in got] == [(1, 1, ""), (1, 1, ""), (2, 1, ""), (3, 0, "x\n" + line + "\n" + line)]


def test_many_dropped_lines_of_one_long_text(spark):
    """Positions are looked up by hash: 40 000 lines, half of them dropped."""
    text = "\n".join(f"a repeated line, number {k // 2:6}" if k % 2 else str(k) for k in range(40_000))
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")).collect()}
    assert got[2].n_dropped == 0 and got[0].n_dropped == 20_000 and got[0].kept == "\n".join(str(k) for k in range(0, 40_000, 2))


def test_full_filter_still_exact(docs, monkeypatch):
    want = counted(map(tuple, lines.drop_repeated_lines(docs).select("doc_id", "n_dropped", "kept").collect()))
    monkeypatch.setattr(lines, "MOST_BITS", 1 << 20)
    monkeypatch.setattr(lines, "HOT_ROWS", 2)  # and every repeated line counts as hot
    assert counted(map(tuple, lines.drop_repeated_lines(docs).select("doc_id", "n_dropped", "kept").collect())) == want


def test_substrings_against_brute_force(docs, clashing, rows):
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49) if i is not None else ():
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, i), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    for table in (docs, clashing):
        assert counted(map(tuple, substrings.remove_repeats(table).collect())) == counted(want)
    assert sum(w[2] for w in want) > 500


def fingerprint(text: str | None) -> int:
    w = WORD.findall((text or "").translate(FOLD))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    if not s:
        return 0
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def groups(fps: list[int]) -> list[int]:
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_simhash_against_brute_force(docs, clashing, rows):
    fps = [fingerprint(t) for _, t in rows]
    of = groups(fps)
    least = defaultdict(list)
    for (i, _), g in zip(rows, of):
        if i is not None:
            least[g].append(i)
    want = counted((i, f - (1 << 64) if f >> 63 else f, min(least[g], default=None)) for (i, _), f, g in zip(rows, fps, of))
    for table in (docs, clashing):
        assert counted(map(tuple, simhash.near_duplicates(table).collect())) == want


def test_links_of_large_families(spark):
    """Groups above the limit go through the finer keys and the bitmap; no link is lost."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(150):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(int(b) ^ sum(1 << int(k) for k in bits))
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = groups(fps)
    for limit in (1024, 8):
        label = dict(map(tuple, components(simhash.fingerprint_links(table, limit=limit)).collect()))
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        got = defaultdict(set)
        for s, w in zip(signed, want):
            got[label.get(s, s)].add(w)
        assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))


def test_keys_are_made_in_many_tasks(spark):
    """The fingerprints are dealt round robin before their 66 keys, so neither the optimizer nor a small table joins the tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    seen = []
    plain = simhash._variants
    try:
        simhash._variants = lambda df: seen.append(df) or plain(df)
        simhash.fingerprint_links(fps)
    finally:
        simhash._variants = plain
    assert "RoundRobinPartitioning(%d)" % n in seen[0]._jdf.queryExecution().toString() and seen[0].rdd.getNumPartitions() == n


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert dict(map(tuple, components(chain).collect())) == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_components_that_are_stars_already(spark, monkeypatch):
    """Stars need no round; a second parent or a grandchild does."""
    module, rounds = importlib.import_module(components.__module__), []
    plain = module._star
    monkeypatch.setattr(module, "_star", lambda links, large: rounds.append(large) or plain(links, large))
    for links, none in (([(5, 1), (6, 1), (1, 7), (9, 8), (5, 1), (8, 8)], True), ([(5, 1), (5, 2)], False), ([(5, 2), (2, 1)], False)):
        rounds.clear()
        got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
        assert (not rounds) == none
        assert got == ({1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8} if none else {1: 1, 2: 1, 5: 1})


def test_empty_tables(empty):
    assert lines.drop_repeated_lines(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_digests_are_of_the_kept_text(spark):
    from shoal.llm.queries import QUERIES

    got = QUERIES["op5_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in substrings.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_texts_without_ids_go_to_many_tasks(spark):
    rows = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', id, ' and more') AS text")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        parts = substrings.remove_repeats(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["count"] for r in parts) == 400 and len(parts) == 4 and max(r["count"] for r in parts) < 250
