"""Toxic passages by maximum-scoring segments.

A word's score is its log-odds of standing in toxic texts, smoothed by a chain of Dirichlet priors: a
word's prior is what its first five bytes say, whose prior is the first four bytes, whose prior is the
share of toxic texts (bytes of UTF-8; a letter beyond ASCII may be cut, which only merges more words). A linear scan (Ruzzo and Tompa, 1999) finds every maximal segment of the scores,
which are shifted to be negative on the average; extreme-value statistics (Karlin and Altschul, 1990) turn
a segment's score and the text's length into an expected number of such segments in clean text; sum
statistics of the best segments together (Karlin and Altschul, 1993) give a text's evidence, and a logistic
fit turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import sampled
from .text import FOLD, Chunk, chunks, crc_of_id, hashes

#: Bins of each level, pseudo-count of a prior, and the most labelled rows that are learned from.
BINS, PRIOR, SAMPLE = 1 << 19, 10.0, 60_000
#: Bytes of the two prefixes; shift of the scores below their mean on clean text; bounds of a score.
PREFIXES, SHIFT, LOW, HIGH = (4, 5), 1.5, -2.0, 8.0
#: Bounds of a text's evidence.
WEAK, STRONG = -20.0, 60.0
#: A passage is significant if fewer than this many are expected in a clean text.
EXPECTED = 0.05

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LEVELS = len(PREFIXES) + 1
_LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 1000)))))


def _bins(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each word on every level (words of letters, A-Z lower-cased), and each text's first word."""
    first, last, of = c.words(_BREAK)
    buf = FOLD[c.buf]
    ends = [np.minimum(last, first + n) for n in PREFIXES] + [last]
    levels = [(hashes(buf, first, e, seed=k + 1) % np.uint64(BINS)).astype(np.int64) + k * BINS for k, e in enumerate(ends)]
    return np.stack(levels), of


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a bin."""
    total = np.zeros((2, _LEVELS * BINS), np.int32)
    for c in chunks(batches):
        levels, of = _bins(c)
        doc = np.repeat(np.arange(c.n), np.diff(of))
        pairs = np.unique(np.concatenate([doc * (_LEVELS * BINS) + x for x in levels]))
        y = c.column("y").to_numpy().astype(np.int64)
        np.add.at(total, (y[pairs // (_LEVELS * BINS)], pairs % (_LEVELS * BINS)), 1)
    for y in (0, 1):
        used = np.flatnonzero(total[y])
        piece = used >> 13
        cut = np.flatnonzero(np.diff(piece)) + 1
        for own in np.split(used, cut) if len(used) else ():
            yield pa.record_batch([pa.array([y * 1000 + int(own[0] >> 13)], pa.int32()), pa.array([own.astype(np.int32).tobytes()]), pa.array([total[y, own].tobytes()])], ["piece", "bins", "counts"])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
            np.add.at(held.setdefault(k, np.zeros(1 << 13, np.int64)), np.frombuffer(at, np.int32) & 8191, np.frombuffer(n, np.int32))
    for k, n in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n.astype(np.int32).tobytes()])], ["piece", "counts"])


@dataclass
class Model:
    """Score of each bin of the last level given its prefixes, and the statistics that calibrate segments."""

    odds: list[np.ndarray]  # counts of clean and toxic texts, all levels in a row
    base: float
    shift: float = 0.0
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def word_scores(self, levels: np.ndarray) -> np.ndarray:
        clean, toxic = self.odds
        p = np.full(levels.shape[1], self.base)
        for at in levels:
            p = (toxic[at] + PRIOR * p) / (clean[at] + toxic[at] + PRIOR)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.clip(np.log(p / (1 - p)) - np.log(self.base / (1 - self.base)) - self.shift, LOW, HIGH)

    def surprise(self, score: np.ndarray, n: int) -> np.ndarray:
        """Minus the logarithm of the expected number of segments of this score in a clean text of ``n`` words."""
        return self.rate * score - self.log_k - np.log(max(n, 1))

    def evidence(self, scores: np.ndarray, n: int) -> float:
        """Of a text's segments, from the r best together, for the r that says most."""
        each = self.surprise(-np.sort(-np.append(scores, 0.0)), n)
        each = each[: max(1, int((each > 0).sum()))]
        r = np.arange(1, len(each) + 1)
        total = np.cumsum(each)
        sums = total - (r - 1) * np.log(np.maximum(total, 1)) + _LOG_FACTORIAL[np.minimum(r, 999)] + _LOG_FACTORIAL[np.minimum(r - 1, 999)]
        return float(np.clip(sums.max(), WEAK, STRONG))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, sum) in linear time; only positive scores are visited one by one.

    Each held segment knows the nearest one before it that begins at a smaller sum, so a search passes over
    those that a later segment can't be joined with only once. A segment without such a predecessor makes
    all before it final.
    """
    out: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum up to its end, predecessor
    total = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    for k, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first, j = k, len(held) - 1
        while j >= 0 and held[j][2] >= low:
            j = held[j][4]
        while j >= 0 and held[j][3] < high:  # joined, its own predecessor is the next to look at
            first, _, low, _, before = held[j]
            del held[j:]
            j = before
        if j < 0:
            out += [(a, b, r - l) for a, b, l, r, _ in held]
            held.clear()
        held.append((first, k + 1, low, high, j))
    return out + [(a, b, r - l) for a, b, l, r, _ in held]


def segments(scores: np.ndarray, of: np.ndarray) -> Iterator[list[tuple[int, int, float]]]:
    """The maximal segments of each text."""
    some = np.append(0, np.cumsum(scores > 0))
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        yield maximal_segments(scores[a:b]) if some[b] > some[a] else []


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - 1e-3 * a, (weight * (y - p)).sum()])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -3, 3))
    return a, b


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from up to ``sample`` rows of ``labels`` (which the caller has restricted to those it may learn from).

    Three quarters of them give the word scores, the rest calibrates; without toxic and clean texts in
    both parts the model's score is the share of toxic ones (0.5 without labels).
    """
    sc = docs.sparkSession.sparkContext
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sampled(labels, column, sample)), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    rows = known.where(part < 3).select("text", "y")
    n = dict(rows.groupBy("y").count().collect())
    counts = rows.mapInArrow(_counts, "piece int, bins binary, counts binary").repartition("piece").mapInArrow(_summed, "piece int, counts binary")
    odds = [np.zeros(_LEVELS * BINS, np.float32) for _ in (0, 1)]
    for k, x in counts.collect():  # two numbers a bin at most
        own = np.frombuffer(x, np.int32)
        odds[k // 1000][(k % 1000) << 13 : ((k % 1000) << 13) + len(own)] = own
    base = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        return Model(odds, 0.5, constant=base if n else 0.5)
    model = Model(odds, base)
    sent = sc.broadcast(model)
    rest = known.where(part == 3).select("text", "y")

    def spread(batches):
        """Counts of word scores on clean texts, in steps of a hundredth."""
        total = np.zeros(2001, np.int64)
        for c in chunks(batches):
            levels, of = _bins(c)
            clean = np.repeat(c.column("y").to_numpy() == 0, np.diff(of))
            s = sent.value.word_scores(levels)[clean]
            total += np.bincount(np.clip(np.rint(s * 100).astype(np.int64) + 1000, 0, 2000), minlength=2001)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["step", "n"])

    found = rest.mapInArrow(spread, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    at, times = np.array([r.step for r in found]) / 100 - 10, np.array([r.n for r in found], np.float64)
    if not times.sum():
        return Model(odds, base, constant=base)
    p = times / times.sum()
    model.shift = float((p * at).sum()) + SHIFT
    s = np.clip(at - model.shift, LOW, HIGH)
    low, high = 1e-3, 20.0  # the rate solves E[exp(rate * score)] = 1
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    model.rate = low
    sent = sc.broadcast(model)

    def measured(batches, measure):
        """Counts of a measure of each text's segments by label, in steps of a twentieth."""
        total: dict[tuple[int, int], int] = {}
        for c in chunks(batches):
            levels, of = _bins(c)
            for y, n, found in zip(c.column("y").to_pylist(), np.diff(of).tolist(), segments(sent.value.word_scores(levels), of)):
                x = measure(np.array([f[2] for f in found]), n)
                total[y, round(x * 20)] = total.get((y, round(x * 20)), 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["y", "step", "n"])

    def histogram(measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = rest.mapInArrow(lambda it: measured(it, measure), "y int, step long, n long").groupBy("y", "step").agg(F.sum("n").alias("n")).collect()
        return np.array([r.y for r in found]), np.array([r.step for r in found]) / 20, np.array([r.n for r in found], np.float64)

    y, x, w = histogram(lambda scores, n: float(sent.value.surprise(scores.max(initial=0.0), n)))
    if len(np.unique(y)) < 2:
        return Model(odds, base, constant=base)
    model.log_k = float((w[y == 0] * x[y == 0]).sum() / w[y == 0].sum()) - 0.5772  # a Gumbel variable's mean is Euler's constant
    calibrated = sc.broadcast(model)
    y, x, w = histogram(lambda scores, n: calibrated.value.evidence(scores, n))
    model.slope, model.offset = _fit_logistic(x, y, w)
    return model


PASSAGE = T.StructType([T.StructField("word_from", T.LongType()), T.StructField("word_to", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), ``predicted`` (1 from 0.5 on) and ``passages``.

    passages are the significant segments in order: first word, word after the last, score, expected number
    in clean text; words are runs of letters and digits. Null and empty texts have no passage and the score
    of a best segment of 0; a very long text is one row of a task, whose memory it needs a few times over. Repeated rows get equal results; an empty table stays empty; columns named as
    those added are replaced, others stay.
    """
    docs = docs.drop("score", "predicted", "passages")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(PASSAGE))])
    kind = pa.list_(pa.struct([("word_from", pa.int64()), ("word_to", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        m = sent.value
        for c in chunks(batches):
            levels, of = _bins(c)
            s = m.word_scores(levels)
            e, passages = np.zeros(c.n), []
            for k, (n, found) in enumerate(zip(np.diff(of).tolist(), segments(s, of))):
                scores = np.array([f[2] for f in found])
                e[k] = m.evidence(scores, n)
                often = np.exp(-np.clip(m.surprise(scores, n), -700, 700))
                passages.append([{"word_from": a, "word_to": b, "score": x, "expected": float(f)} for (a, b, x), f in zip(found, often) if f < EXPECTED])
            p = m.probability(e)
            yield pa.RecordBatch.from_arrays([*c.batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, kind)], names=[*c.batch.schema.names, "score", "predicted", "passages"])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every row of the documents, learned from labels outside the held-out fold.

    Null and empty texts have no passage and get the score of none; very long texts are scanned whole, in time
    linear in their length. Rows that repeat or share a doc_id are scored by their own texts. Rows without a
    doc_id are scored and not held out. Without usable labels the score is their mean, or 0.5. A score of
    exactly 0.5 predicts 1. An empty table gives an empty table; further columns play no part.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 0)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
