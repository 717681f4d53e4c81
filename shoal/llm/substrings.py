"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

A window's hash tells to which of P groups it goes; P grows with the text, so a group stays near
``GROUP`` windows. A task sends each hash of a chunk of texts once, with its smallest doc_id: a
passage that a third of all documents hold costs one entry a chunk, not one a document. A group
answers with the windows that another document with a smaller doc_id holds; answers go to buckets
of documents, where covered words merge into maximal intervals and leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACES, Chunk, chunks, hashes, mix

WINDOW = 50
#: Windows a group, bytes of text a bucket of documents, bytes of text a chunk; groups and buckets at least.
GROUP, BUCKET, CHUNK, LEAST = 1 << 20, 1 << 24, 1 << 22, 16

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses (odd numbers have one modulo 2^64), at least ``n`` of each."""
    if len(_power[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate(_BASES):
                back = _U(pow(int(base), -1, 1 << 64))
                for at, factor in ((2 * k, base), (2 * k + 1, back)):
                    x = np.full(n, factor, np.uint64)
                    x[0] = 1
                    _power[at] = np.multiply.accumulate(x)
    return _power


def _rolling(h: np.ndarray, window: int, which: int) -> np.ndarray:
    """The hash of each ``window`` consecutive numbers of ``h``: their polynomial in the base, from prefix sums."""
    power = _powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[2 * which][: len(h)], out=total[1:])
        return mix((total[window:] - total[:-window]) * power[2 * which + 1][: len(h) - window + 1])


def _windows(c: Chunk, window: int, both: bool = True):
    """Word bounds of a chunk; its windows' first words, texts, hashes and second hashes."""
    first, last, of = c.words()
    if len(first) < window:
        none = np.zeros(0, np.int64)
        return first, last, of, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = hashes(c.buf, first, last)
    doc = np.repeat(np.arange(c.n), np.diff(of))
    at = np.flatnonzero(doc[window - 1 :] == doc[: len(doc) - window + 1])
    return first, last, of, at, doc[at], _rolling(h, window, 0)[at], _rolling(h, window, 1)[at] if both else None


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _split(key: np.ndarray, docs: np.ndarray, hs: np.ndarray):
    """Packed docs, how many hashes each has, and hashes of each value of ``key``."""
    order = np.lexsort((docs, key))
    key, docs, hs = key[order], docs[order], hs[order]
    begin = _runs(key)
    for a, b in zip(begin, np.append(begin[1:], len(key))):
        own = _runs(docs[a:b])
        yield int(key[a]), docs[a + own].tobytes(), np.diff(np.append(own, b - a)).astype(np.int32).tobytes(), hs[a:b].tobytes()


def _joined(docs: list[bytes], runs: list[bytes]) -> np.ndarray:
    return np.repeat(np.frombuffer(b"".join(docs), np.int64), np.frombuffer(b"".join(runs), np.int32))


def _owned(docs: np.ndarray, hs: np.ndarray):
    """Sorted by hash: docs, hashes, and the smallest doc of each hash beside them and alone."""
    order = np.argsort(hs, kind="stable")
    docs, hs = docs[order], hs[order]
    begin = _runs(hs)
    least = np.minimum.reduceat(docs, begin) if len(begin) else docs
    return docs, hs, begin, least, np.repeat(least, np.diff(np.append(begin, len(hs))))


_ASKED = pa.schema([("p", pa.int32()), ("b", pa.int32()), ("docs", pa.binary()), ("runs", pa.binary()), ("hashes", pa.binary())])
_ANSWER = pa.schema([("b", pa.int32()), ("docs", pa.binary()), ("runs", pa.binary()), ("hashes", pa.binary())])


def _ask(batches: Iterable[pa.RecordBatch], window: int, groups: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches, limit=CHUNK):
        ids = c.column("doc_id")
        sound = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        _, _, _, _, doc, h, h2 = _windows(c, window)
        keep = sound[doc]
        doc, h, h2 = ids[doc[keep]], h[keep], h2[keep]
        d, s, begin, least, beside = _owned(doc, h)
        late = d > beside
        known = [(b % groups, b, *x) for b, *x in _split(d[late] % buckets, d[late], s[late])]  # repeated within the chunk
        order = np.argsort(h, kind="stable")
        group = (h2[order][begin] % _U(groups)).astype(np.int64)
        rows = known + [(p, -1, *x) for p, *x in _split(group, least, s[begin])]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _ASKED.types)] if rows else [pa.array([], t) for t in _ASKED.types], schema=_ASKED)


def _answer(table: pa.Table, buckets: int) -> pa.Table:
    b = table.column("b").to_numpy()
    docs, runs, hs = (table.column(c).to_pylist() for c in ("docs", "runs", "hashes"))
    asked = np.flatnonzero(b < 0)
    d = _joined([docs[k] for k in asked], [runs[k] for k in asked])
    s = np.frombuffer(b"".join(hs[k] for k in asked), np.uint64)
    rows = [(int(b[k]), docs[k], runs[k], hs[k]) for k in np.flatnonzero(b >= 0)]
    d, s, _, _, beside = _owned(d, s)
    late = d > beside
    rows += _split(d[late] % buckets, d[late], s[late])
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _ANSWER.types)] if rows else [pa.array([], t) for t in _ANSWER.types], schema=_ANSWER)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _remove(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    with np.errstate(over="ignore"):
        d = _joined(answers.column("docs").to_pylist(), answers.column("runs").to_pylist()).view(np.uint64)
        gone = np.sort(mix(np.frombuffer(b"".join(answers.column("hashes").to_pylist()), np.uint64) ^ mix(d)))
    out = []
    for c in chunks(docs.to_batches(), limit=CHUNK):
        ids = c.column("doc_id")
        first, last, of, at, doc, h, _ = _windows(c, window, both=False)
        covered = np.zeros(len(first), bool)
        if len(gone) and len(at):
            key = mix(h ^ mix(ids.fill_null(0).to_numpy().view(np.uint64)[doc]))
            hit = at[(gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] == key) & ids.is_valid().to_numpy(zero_copy_only=False)[doc]]
            edge = np.zeros(len(first) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
        keep = ~covered
        step = np.zeros(len(c.buf) + 1, np.int8)  # bytes of kept words, each with the blank behind it
        np.add.at(step, first[keep], 1)
        np.add.at(step, last[keep] + 1, -1)
        c.buf[:-8][SPACES[c.buf[:-8]]] = 0x20
        text = c.buf[np.cumsum(step[:-1], dtype=np.int8) > 0]
        size = np.concatenate(([0], np.cumsum(np.where(keep, last - first + 1, 0))))[of]
        raw = text.tobytes()
        texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
        removed = np.concatenate(([0], np.cumsum(covered)))[of]
        out.append(pa.record_batch([ids, pa.array(np.diff(of)), pa.array(np.diff(removed)), pa.array(texts, pa.string())], schema=_KEPT))
    return pa.Table.from_batches(out, schema=_KEPT)


def _prime(n: int) -> int:
    """The least prime from ``n`` on, so that doc_ids with a common step still spread."""
    n = max(n, 2)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``, one row per row of ``docs``: text without repeated passages.

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller doc_id, judged on the input; kept words are joined by one blank. Null and
    empty texts have no words. Rows with equal doc_id don't remove each other's words; rows with a null
    doc_id stay whole and remove nothing. An empty table gives an empty table; further columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(LEAST, size // (6 * GROUP)), _prime(max(LEAST, size // BUCKET))
    asked = docs.mapInArrow(lambda it: _ask(it, window, groups, buckets), "p int, b int, docs binary, runs binary, hashes binary")
    answers = asked.groupBy("p").applyInArrow(lambda t: _answer(t, buckets), "b int, docs binary, runs binary, hashes binary")
    dealt = docs.withColumn("b", F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(buckets)).cast("int"))  # a text without an id is asked for nothing
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(lambda x, y: _remove(x, y, window), "doc_id long, n_words long, n_removed long, text string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's kept words, as digests.

    Null and empty texts have no words; a very long text is a chunk of its own, with all its windows. Of equal
    windows those of the smallest doc_id stay; rows that share a doc_id don't remove each other's, and rows without
    one stay whole and remove nothing. Repeated rows get equal results. An empty table gives an empty table;
    further columns play no part.
    """
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
