"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over 8 consecutive words that ignores two of them. The two masks used here are
lossless: any 13 aligned words with at most two substitutions contain one of them whole (checked in the
tests by trying every pattern). Documents and benchmark items are hashed under both masks at every
position; a bitmap of the benchmark's hashes drops nearly all document positions before the shuffle, an
equi-join on the hash brings the rest together, and each pair is verified word by word around the hit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .text import FOLD, chunks, hashes, mix

#: Positions of 8 words that count, for each mask.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: Words of an overlap and the substitutions it may have; shorter items (from SPAN words on) must match whole.
OVERLAP, SUBSTITUTIONS = 13, 2
#: Bits of the bitmap (8 MB) and bytes of it in one row.
BITS, PIECE = 1 << 26, 1 << 16

_SIDE = OVERLAP - SPAN
_ROUND = SPAN + 2 * _SIDE
_U = np.uint64
#: Words are runs of ASCII letters, digits and non-ASCII bytes.
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _seeds(batches: Iterable[pa.RecordBatch], outside: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(hash, id, mark, position, number of words, words around) of each masked position, or of those in ``bitmap``.

    The words around are 31-bit hashes, ``outside`` where the text has none.
    """
    for c in chunks(batches):
        c.buf[:-8] = FOLD[c.buf[:-8]]
        first, last, of = c.words(_BREAK)
        h = hashes(c.buf, first, last)
        n = np.diff(of)
        doc = np.repeat(np.arange(c.n), n)
        at = np.flatnonzero(doc[SPAN - 1 :] == doc[: max(0, len(doc) - SPAN + 1)])
        out_hash, out_at = [], []
        with np.errstate(over="ignore"):
            for salt, mask in enumerate(MASKS):
                total = np.full(len(at), salt + 1, np.uint64)
                for k in mask:
                    total = mix(total * _U(0x9E3779B97F4A7C15) + h[at + k])
                hit = np.arange(len(at)) if bitmap is None else np.flatnonzero(_in(bitmap, total))
                out_hash.append(total[hit])
                out_at.append(at[hit])
        pos, seed = np.concatenate(out_at), np.concatenate(out_hash)
        near = pos[:, None] + np.arange(-_SIDE, SPAN + _SIDE)
        inside = (near >= of[doc[pos]][:, None]) & (near < of[doc[pos] + 1][:, None])
        around = np.where(inside, (h | _U(4)).astype(np.uint32)[np.clip(near, 0, max(0, len(h) - 1))], np.uint32(outside)) if len(pos) else np.zeros((0, _ROUND), np.uint32)
        raw = np.ascontiguousarray(around).tobytes()
        size = 4 * _ROUND
        yield pa.record_batch([
            pa.array(seed.view(np.int64)), *(c.column(x).take(pa.array(doc[pos])) for x in ("id", "mark")), pa.array(pos - of[doc[pos]]), pa.array(n[doc[pos]]),
            pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary()),
        ], ["hash", "id", "mark", "pos", "n", "around"])


_SEED = "hash long, id long, mark long, pos long, n long, around binary"


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & _U(BITS - 1)
    return ((bitmap[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool)


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmap = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) & _U(BITS - 1)
        np.bitwise_or.at(bitmap, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
    for k in range(0, BITS // 8, PIECE):
        if bitmap[k : k + PIECE].any():
            yield pa.record_batch([pa.array([k // PIECE], pa.int32()), pa.array([zlib.compress(bitmap[k : k + PIECE], 1)])], ["piece", "bits"])


def _either(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(*(c.to_pylist() for c in batch.columns)):
            held[k] = held.get(k, 0) | np.frombuffer(zlib.decompress(x), np.uint8)
    for k, x in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(x, 1)])], ["piece", "bits"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hit, the aligned windows over the seed that lie in both texts and match well enough."""
    for batch in batches:
        doc, mark, item = batch.column(0), batch.column(1), batch.column(2)
        pos, doc_n, item_pos, n = (batch.column(k).to_numpy() for k in range(3, 7))
        words = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, _ROUND) for k in (7, 8)]
        same = np.zeros((batch.num_rows, _ROUND + 1), np.int64)
        np.cumsum(words[0] == words[1], axis=1, out=same[:, 1:])
        need_len = np.minimum(n, OVERLAP)
        first, last, most = np.full(len(pos), _ROUND), np.full(len(pos), -1), np.zeros(len(pos), np.int64)
        for size in range(SPAN, OVERLAP + 1):
            own = need_len == size
            if not own.any():
                continue
            least = size - (SUBSTITUTIONS if size == OVERLAP else 0)
            for s in range(max(0, SPAN + _SIDE - size), _SIDE + 1):
                match = same[:, s + size] - same[:, s]
                inside = (np.minimum(pos, item_pos) - _SIDE + s >= 0) & (pos - _SIDE + s + size <= doc_n) & (item_pos - _SIDE + s + size <= n)
                ok = own & inside & (match >= least)
                first = np.where(ok, np.minimum(first, s), first)
                last = np.where(ok, np.maximum(last, s + size), last)
                most = np.where(ok, np.maximum(most, match), most)
        hit = np.flatnonzero(last >= 0)
        take = pa.array(hit)
        yield pa.record_batch([doc.take(take), mark.take(take), item.take(take), pa.array(pos[hit] - _SIDE + first[hit]), pa.array(pos[hit] - _SIDE + last[hit]), pa.array(most[hit])], ["doc_id", "mark", "item_id", "word_from", "word_to", "matched"])


def _windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, mark, item_id, word_from, word_to, matched)``: verified windows around each hit; mark is xxhash64 of the document's text."""
    spark = docs.sparkSession
    keyed = lambda df, c: df.select(F.col(c).cast("long").alias("id"), "text", F.xxhash64("text").alias("mark"))
    items, _ = written(keyed(benchmark, "item_id").mapInArrow(lambda it: _seeds(it, 1, None), _SEED), "seeds")  # so that joins know its size
    bitmap = np.zeros(BITS // 8, np.uint8)
    for k, x in items.select("hash").mapInArrow(_mark, "piece int, bits binary").repartition("piece").mapInArrow(_either, "piece int, bits binary").collect():  # BITS / 8 bytes at most
        bitmap[k * PIECE : (k + 1) * PIECE] = np.frombuffer(zlib.decompress(x), np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)
    hits = keyed(docs, "doc_id").mapInArrow(lambda it: _seeds(it, 2, sent.value), _SEED)
    items = items.select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("n").alias("item_n"), F.col("around").alias("item_around"))
    pairs = hits.join(items, "hash").select("id", "mark", "item_id", "pos", "n", "item_pos", "item_n", "around", "item_around")
    return pairs.mapInArrow(_verify, "doc_id long, mark long, item_id long, word_from long, word_to long, matched long")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, word_from, word_to, matched)``: one row for each document and benchmark item that overlap.

    They overlap if 13 aligned words have at most two substitutions; an item of 8 to 12 words must occur
    whole, a shorter one is no evidence. word_from to word_to (exclusive) spans all such windows in the
    document, matched is the most equal words in one. Words are runs of letters and digits, A-Z
    lower-cased, compared by 31-bit hashes. Null and empty texts overlap nothing; a very long text is one
    row of a task, whose memory it needs a few times over. Rows with equal doc_id or item_id are one
    document or item, null ids are ids like others. Empty tables give an empty table; further columns
    play no part.
    """
    return _windows(docs, benchmark).groupBy("doc_id", "item_id").agg(F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to"), F.max("matched").alias("matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text overlaps an item (as ``overlaps`` has it); all columns stay.

    A row goes by its id and text together, so another row of its doc_id, or another without one, stays
    unless its text overlaps too.
    """
    bad = _windows(docs, benchmark).select("doc_id", "mark").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("at"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("mark")), "left_anti").select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that overlap, as ``overlaps`` has them.

    Null and empty texts overlap nothing; very long texts are searched whole. Rows that share a doc_id or item_id,
    null ones too, are one document or item. Of equally long matches the span covers all. Empty tables give an
    empty table; further columns play no part.
    """
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
