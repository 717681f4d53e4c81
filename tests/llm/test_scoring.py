"""Classifiers by held-out accuracy and their parts by brute force; decontamination, top-k and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoal.llm import decontaminate, quality, sharding, topk, toxicity
from shoal.llm.text import chunks

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,column,least", [("op2_quality", "quality", 0.97), ("op3_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    from shoal.llm.queries import QUERIES

    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert held.where("score NOT BETWEEN 0 AND 1 OR (score >= 0.5) <> (predicted = 1)").count() == 0
    right = held.select(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]
    assert right >= least


def test_scores_stand_odd_rows(spark, docs, clashing, empty):
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).distinct()
    none = labels.limit(0)
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(docs, labels, column)
        for table in (docs, clashing):
            got = module.score(table, model)
            assert got.count() == table.count()
            assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
            assert not [c for c in table.columns if c not in got.columns]
        assert module.score(empty, module.train(empty, none, column)).count() == 0
        assert {r.score for r in module.score(docs, module.train(docs, none, column)).select("score").collect()} == {0.5}


def test_learning_ignores_held_out_labels(spark):
    """Flipping the labels that may not be learned from changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (dict(toxicity.score(docs, toxicity.train(docs, x.where(fold != 0))).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, -0.5, 1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(s))
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)] + [0])
        assert abs(max([x[2] for x in got] + [0]) - best) < 1e-9
        # the definition, step by step: the best segment, then the same left and right of it
        def split(a, b):
            spans = [(sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            top = max(x[0] for x in spans)
            _, _, i, j = min((x for x in spans if abs(x[0] - top) < 1e-9), key=lambda x: (x[3] - x[2], x[2]))
            return split(a, i) + [top] + split(j, b)
        assert abs(sum(x[2] for x in got) - sum(split(0, len(s)))) < 1e-9
        # and by what makes a segment maximal: it beats all within it, and no larger one does
        total = [0.0]
        for x in s:
            total.append(total[-1] + x)
        sound = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if all(total[a] < t for t in total[a + 1 : b + 1]) and all(total[b] > t for t in total[a:b])]
        want = [x for x in sound if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in sound)]
        assert [x[:2] for x in got] == sorted(want)


@pytest.mark.parametrize("pair", [(1.0, -3.0), (3.0, -1.0), (1.0, -1.0)])
def test_segments_take_linear_time(pair):
    """Clean text (isolated positive words) and toxic text alike: twice the words, twice the time."""
    def seconds(n):
        s = np.array(pair * n)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            toxicity.maximal_segments(s)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(64_000) < 8 * seconds(16_000) + 0.05


def test_word_scores_against_the_chain_of_priors(spark):
    """Counts of texts by label, smoothed from the shorter prefix to the word."""
    data = [(0, "spiteful spites cafés", 1), (1, "spiteful words", 1), (2, "spites spit words", 0), (3, "words", 0), (4, "cafés words", 0)]
    batch = pa.record_batch([pa.array([t for _, t, _ in data]), pa.array([y for *_, y in data], pa.int32())], ["text", "y"])
    levels, _ = toxicity._bins(next(chunks([batch])))
    odds = [np.zeros(toxicity._LEVELS * toxicity.BINS, np.float32) for _ in (0, 1)]
    for part in toxicity._summed(toxicity._counts([batch])):
        for k, x in zip(*(c.to_pylist() for c in part.columns)):
            own = np.frombuffer(x, np.int32)
            odds[k // 1000][(k % 1000) << 13 : ((k % 1000) << 13) + len(own)] = own
    got = toxicity.Model(odds, 0.4, shift=0.0).word_scores(levels)
    words = [(k, w.encode()) for k, t, _ in data for w in t.split()]
    label = {k: y for k, _, y in data}
    want = []
    for _, w in words:
        p = 0.4
        for cut in (4, 5, 100):
            texts = {k for k, v in words if v[:cut] == w[:cut]}
            n = [sum(label[k] == y for k in texts) for y in (0, 1)]
            p = (n[1] + toxicity.PRIOR * p) / (sum(n) + toxicity.PRIOR)
        want.append(min(max(np.log(p / (1 - p)) - np.log(0.4 / 0.6), toxicity.LOW), toxicity.HIGH))
    assert np.allclose(got, want, atol=1e-5)


def test_calibration_of_segments():
    """The logistic fit beats its neighbours, and a text's evidence is the best sum of its segments."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    loss = lambda a, b: np.logaddexp(0, a * x + b).sum() - (y * (a * x + b)).sum() + 5e-4 * a * a
    a, b = toxicity._fit_logistic(x, y, np.ones(400))
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-6 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05))
    model = toxicity.Model([], 0.1, rate=0.7, log_k=-1.0)
    scores = np.array([9.0, 2.0, 8.0])
    each = sorted((0.7 * s + 1.0 - np.log(50) for s in [*scores, 0.0]), reverse=True)
    each = [e for e in each if e > 0] or each[:1]
    want = max(sum(each[:r]) - (r - 1) * np.log(max(sum(each[:r]), 1)) + sum(np.log(range(1, r + 1))) + sum(np.log(range(1, r))) for r in range(1, len(each) + 1))
    assert abs(model.evidence(scores, 50) - want) < 1e-9


def test_word_vectors_and_pooling_against_brute_force(spark, docs, rows):
    batch = pa.record_batch([pa.array([t for _, t in rows])], ["text"])
    at, sign = quality.index_vectors()
    total = np.zeros((quality.BINS, quality.DIMS))
    tokens = []
    for c in chunks([batch]):
        own, of = quality._tokens(c)
        tokens += [x.tolist() for x in np.split(own, of[1:-1])]
    for own in tokens:
        if len(own) > 5000:  # the longest text's neighbours at once, the others one by one
            for r in (1, 2):
                for a, b in ((own[:-r], own[r:]), (own[r:], own[:-r])):
                    for d in (0, 1):
                        np.add.at(total, (a, at[d][b]), sign[d][b])
            continue
        for k, w in enumerate(own):
            for j in range(max(0, k - 2), min(len(own), k + 3)):
                if j != k:
                    for d in (0, 1):
                        total[w, at[d][own[j]]] += sign[d][own[j]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    want = total / np.where(norm > 0, norm, 1)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    assert (quality.word_vectors(docs.repartition(1)) == got).all()  # whatever the partitions
    means = np.concatenate([quality.pooled(c, got) for c in chunks([batch])])
    assert np.allclose(means, [got[x].astype(float).mean(axis=0) if x else np.zeros(quality.DIMS) for x in tokens], atol=1e-6)


def test_gradient_and_temperature():
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(20, 4)), (rng.random(20) < 0.5).astype(float)
    p = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss():
        s = np.tanh(z @ p[0] + p[1]) @ p[2] + p[3][0]
        return np.mean(np.logaddexp(0, s) - y * s) + quality.DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    for a, g in zip(p, quality.gradients(p, z, y)):
        for k in np.ndindex(a.shape):
            a[k] += 1e-5
            up = loss()
            a[k] -= 2e-5
            down = loss()
            a[k] += 1e-5
            assert abs((up - down) / 2e-5 - g[k]) < 1e-6
    logits = rng.normal(size=4000) * 3
    truth = (rng.random(4000) < 1 / (1 + np.exp(-logits / 2))).astype(float)  # twice too sure
    assert 1.7 < quality.best_temperature(logits, truth) < 2.4


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    flipped = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(quality.score(docs, quality.train(docs, x.where(fold != 1))).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_toxic_passage_is_found(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    bad = ["awful", "nasty", "vile"]
    data = []
    for k in range(400):
        w = say(80)
        if k % 4 == 0:
            at = rng.randrange(70)
            w[at : at + 5] = [rng.choice(bad) for _ in range(5)]
        data.append((k, " ".join(w), int(k % 4 == 0)))
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table)
    for r in toxicity.score(table, model).collect():
        spans = [m for p in r.passages for m in range(p.word_from, p.word_to)]
        where = [k for k, w in enumerate(r.text.split()) if w in bad]
        assert r.predicted == r.toxic and (not where or set(where) <= set(spans))


def test_masks_lose_no_overlap():
    def held(mask, wrong):
        return any(all(o + k not in wrong for k in mask) for o in range(decontaminate.OVERLAP - decontaminate.SPAN + 1))

    assert all(any(held(m, set(w)) for m in decontaminate.MASKS) for w in combinations(range(decontaminate.OVERLAP), decontaminate.SUBSTITUTIONS))
    assert all(max(m) < decontaminate.SPAN for m in decontaminate.MASKS)


def test_overlaps_against_brute_force(spark, clashing, empty):
    rng = random.Random(4)
    vocab = [f"{k}é" for k in range(200)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {k: say(n) for k, n in enumerate([5, 8, 10, 12, 13, 14, 30, 40])}
    data = {}
    for k in range(120):
        w = say(rng.randint(0, 60))
        if k % 2:
            own = list(items[rng.randrange(8)])
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = "other"
            a = rng.randrange(len(own))
            w[10:10] = own if k % 4 == 1 else own[a : a + 13]
        data[k] = w
    want = {}
    for k, w in data.items():
        for j, b in items.items():
            n = min(13, len(b))
            if n < 8:
                continue
            hits = [(a, sum(x == y for x, y in zip(w[a : a + n], b[c : c + n]))) for a in range(len(w) - n + 1) for c in range(len(b) - n + 1)]
            hits = [h for h in hits if h[1] >= n - (2 if n == 13 else 0)]
            if hits:
                want[k, j] = (min(h[0] for h in hits), max(h[0] for h in hits) + n, max(h[1] for h in hits))
    table = spark.createDataFrame([(k, ", ".join(w).upper()) for k, w in data.items()] + [(500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in items.items()] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.word_from, r.word_to, r.matched) for r in decontaminate.overlaps(table, bench).collect()}
    assert got == want and len(want) >= 20
    kept = {r.doc_id for r in decontaminate.decontaminated(table.withColumn("id", F.lit(1)).withColumn("row", F.lit(2)), bench).collect()}
    assert kept == ({*data, 500, 501} - {k for k, _ in want})
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.decontaminated(clashing, bench.limit(0)).count() == clashing.count()


def test_decontamination_goes_by_row(spark):
    """Of rows without doc_id, or of one doc_id, only those go whose own text overlaps; a very long text is read to its end."""
    item = " ".join(f"t{k}" for k in range(15))
    long = "filler " * 200_000 + item
    rows = [(None, "so " + item), (None, "clean"), (9, "clean"), (7, item), (7, "other"), (8, long), (5, None)]
    table = spark.createDataFrame([(i, t, "m", "h") for i, t in rows], "doc_id long, text string, mark string, at string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.decontaminated(table, bench).collect())
    assert got == Counter((i, t, "m", "h") for i, t in [rows[1], rows[2], rows[4], rows[6]])
    assert decontaminate.overlaps(table.where("doc_id = 8"), bench).first().word_to == 200_015


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_top_k_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", block)  # one block, or seven whose results merge
    rng = np.random.default_rng(0)
    data = [(int(k), [float(x) for x in np.round(rng.normal(size=8), 1)]) for k in range(400)]
    data += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (405, [0.0] * 8), (7, data[7][1]), (None, [1.0] * 8), (300 + 1000, data[3][1])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "v", "dim", "block", "asking")})
    rows = topk.quantized(table)
    got = defaultdict(list)
    for r in topk.top_k(rows.where("id % 20 = 0 OR id = 405 OR id = 404"), rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    sound = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for i, v in dict(sound).items():
        if i % 20 == 0 or i in (404, 405):
            all_ = sorted(((-int(v @ w), j) for j, w in sound if j != i and len(w) == len(v)))[:10]
            assert [x[1] for x in got.get(i, [])] == [-s for s, _ in all_]
            assert [x[0] for x in got.get(i, [])] == [j for _, j in all_]
    assert topk.top_k(rows.limit(0), rows).count() == 0 and topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(2)
    rows = rng.integers(-5, 6, (3000, 4))
    rows[:20] = 1000
    order = np.argsort(rows, axis=0, kind="stable").T.copy()
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, np.ndarray) and k.ndim == 1 and k.dtype != bool:
                read.append(len(k))
            return super().__getitem__(k)

    best = topk.threshold_search(np.array([1, 2, 3, 4]), rows.view(Watched), np.arange(3000), order, -1, 10)
    assert np.asarray(best).tolist() == list(range(10)) and sum(read) < 1000


def test_shards_fit_and_split_only_what_must(spark, docs, clashing, empty):
    for table, limit in ((docs, 2000), (clashing, 500), (docs, 1 << 30)):
        got = sharding.shards(table, limit).collect()
        assert len(got) == table.count()
        size, bits = defaultdict(int), {}
        for r in got:
            size[r.shard] += r.n_bytes
            h = bin(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            assert h.startswith(r.shard) and len(r.shard) == r.depth
            bits.setdefault(r.shard, set()).add(h)
        names = sorted(size)
        assert all(not b.startswith(a) for a in names for b in names if a != b)
        for r in got:
            assert r.shard_bytes == size[r.shard] and (size[r.shard] <= limit or len(bits[r.shard]) == 1)
        for name in names:  # the parent of a shard was too large
            if name:
                below = [s for s in names if s.startswith(name[:-1])]
                hashes = set().union(*(bits[s] for s in below))
                assert sum(size[s] for s in below) > limit and len(hashes) > 1
    assert sharding.shards(empty).count() == 0
    assert Counter(r.shard for r in sharding.shards(docs, 1 << 30).collect()).keys() == {""}


def test_written_shards_have_every_row_once(spark, docs, rows, tmp_path):
    few = spark.createDataFrame([(1, "x", "s"), (1, "y", None), (None, "z", "t"), (None, None, "t")], "doc_id long, text string, shard string")
    sharding.write_shards(few, f"file://{tmp_path}/few")
    got = spark.read.parquet(f"file://{tmp_path}/few")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "x"), (1, "y"), (None, "z"), (None, None)], key=repr)
    sharding.write_shards(docs, f"file://{tmp_path}/all", 2000)
    back = spark.read.parquet(f"file://{tmp_path}/all").withColumn("shard", F.col("shard").cast("string"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert back.select("shard").distinct().count() > 5


def test_learning_takes_one_text_an_id(spark):
    """Three labels and very many rows that share their ids: as many rows are learned from as there are labels."""
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    known = quality.labelled(docs, labels, "quality", 20)
    assert known.count() == 3 and quality.labelled(docs.repartition(7), labels, "quality", 20).exceptAll(known).count() == 0
    assert 0 <= quality.score(docs.limit(5), quality.train(docs, labels, sample=20)).agg(F.min("score")).first()[0] <= 1
