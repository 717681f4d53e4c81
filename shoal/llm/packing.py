"""Packing of token sequences into windows, planned by non-negative least squares.

Whole windows of a document stand alone; what is left of each (0 to window-1 tokens) is a piece whose
length counts in a histogram. Of combinations that fill a window exactly, all pairs of lengths are taken
and triples and quadruples are drawn by the histogram (48 draws a length and depth: all triples alone
plan fewer pieces of a corpus of short texts than drawn quadruples do, at several times the cost).
Non-negative least squares finds how often to use each so that together they match the histogram, and the
counts are rounded so that none asks for more pieces than there are.
Pieces find their place by their rank among those of their length. The residual is packed greedily in
bounded groups: the longest piece first, then the longest that still fits, and a cut only where
nothing fits. The rest of a group is laid out in sequences of powers of two, which take no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .tokens import token_table, width_of

SEQUENCE = 2048
#: Combinations enumerated a length; residual pieces a group.
CHOICES, GROUP = 6, 4096

#: Sequence ids: whole windows from 0 on, planned and residual sequences from these on.
PLANNED, RESIDUAL = 1 << 60, 1 << 61


def combinations_of(count: np.ndarray, size: int, choices: int = CHOICES, seed: int = 0) -> np.ndarray:
    """Rows of four lengths (0: none) that add up to ``size``, some for each length that occurs."""
    rng = np.random.default_rng(seed)
    have = np.flatnonzero(count)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    weight = count[have] / count[have].sum()
    out = [np.stack([have, size - have, 0 * have, 0 * have], axis=1)]
    for depth in (1, 2):
        for _ in range(choices * 8):
            more = rng.choice(have, (len(have), depth), p=weight)
            rest = size - have - more.sum(axis=1)
            cols = [have, rest, more[:, 0], more[:, 1] if depth == 2 else 0 * have]
            out.append(np.stack(cols, axis=1)[rest > 0])
    rows = np.concatenate(out)
    rows = rows[(rows[:, 1] > 0) & (count[np.clip(rows[:, 1], 0, size - 1)] > 0)]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def nonnegative_least_squares(rows: np.ndarray, count: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that brings the lengths used by ``rows`` close to ``count``: accelerated projected gradient on the sparse system."""
    at, goal = rows, count.astype(np.float64).copy()
    goal[0] = 0
    used = (rows > 0).astype(np.float64)

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), (used * x[:, None]).ravel(), minlength=len(count))

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = (product(v)[at] * used).sum(axis=1)
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm((product(v)[at] * used).sum(axis=1)))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * ((product(y) - goal)[at] * used).sum(axis=1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def plan(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that use no length more often than it occurs."""
    rows = combinations_of(count, size)
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    x = nonnegative_least_squares(rows, count)
    left = count.tolist()
    needs = [{n: own.count(n) for n in own if n} for own in rows.tolist()]
    times = np.zeros(len(rows), np.int64)
    for goal in (np.floor(x), np.ceil(x)):  # rounded down first, then up as far as pieces are left
        for k in np.argsort(-x, kind="stable").tolist():
            n = min(int(goal[k]) - int(times[k]), *(left[m] // c for m, c in needs[k].items()))
            if n > 0:
                times[k] += n
                for m, c in needs[k].items():
                    left[m] -= n * c
    return rows[times > 0], times[times > 0]


def slots(rows: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: pieces lo <= rank < hi of a length go to sequences first, first+1, ... at an offset."""
    out, taken, first = [], {}, 0
    for lengths, n in zip(rows.tolist(), times.tolist()):
        offset = 0
        for length in lengths:
            if length:
                lo = taken.get(length, 0)
                out.append((length, lo, lo + n, first, offset))
                taken[length] = lo + n
                offset += length
        first += n
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "hi", "first", "offset"), table.T))


def _place(batches: Iterable[pa.RecordBatch], at: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sequence and offset of planned pieces; null for the residual."""
    keys = (at["length"] << 44) + at["lo"]
    for batch in batches:
        rid, start, length, rank = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            none = pa.nulls(len(rid), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), none, none], ["rid", "start", "length", "seq", "offset"])
            continue
        k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
        ok = (k >= 0) & (at["length"][k] == length) & (rank < at["hi"][k])
        seq = PLANNED + at["first"][k] + rank - at["lo"][k]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(seq, mask=~ok), pa.array(at["offset"][k], mask=~ok)], ["rid", "start", "length", "seq", "offset"])


def pack_group(rid: list[int], start: list[int], length: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(rid, start, length, sequence, offset) of each piece; only the last sequences, powers of two long, are not full."""
    pieces = sorted(zip(length, rid, start))
    total = sum(length)
    out, seq = [], 0
    for _ in range(total // size):
        room = size
        while room:
            k = bisect_right(pieces, room, key=lambda p: p[0])
            if k:
                n, doc, at = pieces.pop(k - 1)
            else:  # the shortest piece is longer than the room: cut it
                n, doc, at = pieces.pop(0)
                insort(pieces, (n - room, doc, at + room))
                n = room
            out.append((doc, at, n, seq, size - room))
            room -= n
        seq += 1
    rest = total % size
    for power in (1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1):
        room = power
        while room:
            n, doc, at = pieces.pop()
            if n > room:
                insort(pieces, (n - room, doc, at + room))
                n = room
            out.append((doc, at, n, seq, power - room))
            room -= n
        seq += 1
    return out


_PIECE = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64())])


def _residual(table: pa.Table, size: int) -> pa.Table:
    rid, start, length, group = (table.column(c).to_pylist() for c in ("rid", "start", "length", "g"))
    rows = pack_group(rid, start, length, size)
    base = RESIDUAL + (group[0] << 16)
    return pa.table([pa.array([r[k] + (base if k == 3 else 0) for r in rows], pa.int64()) for k in range(5)], schema=_PIECE)


def _cut(batches: Iterable[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of ids with the pieces of their last part: all pieces with their ids."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, n, raw, whole, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            own = [(k * size, size, whole + k, 0) for k in range(n // size)] + [(p["start"], p["length"], p["seq"], p["offset"]) for p in pieces or ()]
            rows += [(doc, a, m, ids[a : a + m].tobytes(), n, seq, at) for a, m, seq, at in own]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SEQUENCE) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row a piece.

    Each id of each row of ``docs`` (its text's ids and the end id; null texts are empty) lies in exactly
    one piece; a sequence's pieces follow each other without gaps from offset 0. Repeated rows and rows
    with equal or null doc_id are packed each. An empty table gives an empty table; further columns play
    no part. Sequence ids are unique but not consecutive.
    """
    spark, width = docs.sparkSession, width_of(tokenizer)
    numbered = token_table(docs, tokenizer, end).withColumn("rid", F.monotonically_increasing_id())
    tokens, _ = written(numbered.select("doc_id", "part", "n_tokens", "ids", "rid"), "ids")
    # a row's place among the rows of its task, then of all tasks: counts a task first, so that no length or task gathers its rows
    lengths = tokens.select("rid", "part", "n_tokens", (F.col("n_tokens") % size).alias("length"))
    by_task = Window.partitionBy("part", "length").orderBy("rid")
    ranked = lengths.withColumn("rank", F.row_number().over(by_task) - 1)
    tasks = lengths.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.join(bases.select("part", "length", "base"), ["part", "length"])
    count = np.zeros(size, np.int64)
    for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        count[r.length] = r.n
    rows, times = plan(count, size)
    at = slots(rows, times)
    residual = int(count[1:].sum() - ((rows > 0).sum(axis=1) * times).sum())
    groups = max(1, -(-residual // GROUP))
    last = ranked.where("length > 0").select("rid", (F.col("n_tokens") - F.col("length")).alias("start"), "length", (F.col("rank") + F.col("base")).alias("rank"))
    placed, _ = written(last.mapInArrow(lambda it: _place(it, at), "rid long, start long, length long, seq long, offset long"), "pieces")
    rest = placed.where("seq IS NULL").withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    rest = rest.groupBy("g").applyInArrow(lambda t: _residual(t, size), "rid long, start long, length long, seq long, offset long")
    pieces = placed.where("seq IS NOT NULL").unionByName(rest).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "seq", "offset")).alias("pieces"))
    # whole windows: rid spaces tasks 2^33 apart, a row's windows follow from the sum before it in its task
    whole = (F.col("n_tokens") / size).cast("long")
    number = F.col("part").cast("long") * (1 << 36) + F.coalesce(F.sum("k").over(Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = lengths.withColumn("k", whole).where("k > 0").withColumn("whole", number).select("rid", "whole")
    full = tokens.join(long, "rid", "left").join(pieces, "rid", "left").select("doc_id", "n_tokens", "ids", "whole", "pieces")
    return full.mapInArrow(lambda it: _cut(it, size, width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """All documents' ids in sequences, one row a piece.

    Null and empty texts are their end id; a very long text is cut into whole sequences and a rest. Rows that repeat
    or share a doc_id, null or not, are packed each. Pieces of equal length are packed in the order of their tasks
    and rows. An empty table gives an empty table; further columns play no part.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, end)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
