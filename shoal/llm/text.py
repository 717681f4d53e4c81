"""Numpy helpers on the UTF-8 bytes of many texts at once.

A chunk is a few hundred kilobytes of texts laid end to end with a separator
between them, so every step below is a handful of array operations per chunk
and memory stays bounded by the chunk (or by one text, if it is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Target bytes of a chunk.
CHUNK = 1 << 18
#: ``[\x20\x09-\x0D]``: what separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all white space to one blank, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD_SPACE = FOLD.copy()
FOLD_SPACE[SPACES] = 0x20

_U = np.uint64


class Chunk:
    """Rows ``lo:hi`` of a batch. ``buf`` has a blank before, between and after the texts and 8 zero bytes at the end."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.n = batch.slice(lo, hi - lo), hi - lo
        sizes = np.diff(offsets[lo : hi + 1]).astype(np.int64)
        self.start = np.arange(1, self.n + 1) + np.concatenate(([0], np.cumsum(sizes)[:-1])) if self.n else np.zeros(0, np.int64)
        self.end = self.start + sizes
        self.buf = np.zeros(int(sizes.sum()) + self.n + 1 + 8, np.uint8)
        self.buf[: -8] = 0x20
        for k in range(self.n):
            self.buf[self.start[k] : self.end[k]] = data[offsets[lo + k] : offsets[lo + k + 1]]

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def words(self, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in ``buf`` of all words, and for each text the number of its first word (one more at the end)."""
        sep = separator[self.buf[:-8]]
        first = np.flatnonzero(sep[:-1] & ~sep[1:]) + 1
        last = np.flatnonzero(~sep[:-1] & sep[1:]) + 1
        return first, last, np.append(np.searchsorted(first, self.start), len(first))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[Chunk]:
    """The rows of ``batches`` in order, null texts as empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, at, data = col.buffers()
        offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        if col.null_count:
            sizes = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
            if (sizes != np.diff(offsets)).any():
                col = col.fill_null("")
                _, at, data = col.buffers()
                offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield Chunk(batch, lo, hi, data, offsets)
            lo = hi


def loads(buf: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The little-endian number that begins at each byte."""
    width = np.dtype(dtype).itemsize
    return np.ndarray((len(buf) - width + 1,), dtype, buf, 0, (1,))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``buf[first:last]``."""
    size = last - first
    x = loads(buf)
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))
        h = mix(h ^ (x[first] & _MASK[np.minimum(size, 8)]))
        live = np.flatnonzero(size > 8)
        at = 8
        while len(live):
            h[live] = mix(h[live] * _M1 ^ (x[first[live] + at] & _MASK[np.minimum(size[live] - at, 8)]))
            at += 8
            live = live[size[live] > at]
    return h


_P1, _P2, _P3, _P4, _P5 = map(_U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(buf: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each ``buf[first:last]``; those of 32 bytes and more go to the xxhash library one by one."""
    size = last - first
    x8, x4 = loads(buf), loads(buf, "<u4")
    with np.errstate(over="ignore"):
        h = _U(seed) + _P5 + size.astype(np.uint64)
        at = first.copy()
        for k in (8, 16, 24):
            i = np.flatnonzero(size >= k) if k > 8 or (size < 8).any() else slice(None)
            v = h[i] ^ _rot(x8[at[i]] * _P2, 31) * _P1
            h[i] = _rot(v, 27) * _P1 + _P4
            at[i] += 8
        i = np.flatnonzero((size & 7) >= 4)
        h[i] = _rot(h[i] ^ x4[at[i]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[i] += 4
        for k in (1, 2, 3):
            i = np.flatnonzero((size & 3) >= k)
            h[i] = _rot(h[i] ^ buf[at[i]].astype(np.uint64) * _P5, 11) * _P1
            at[i] += 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        h ^= h >> _U(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = buf.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(first[long].tolist(), last[long].tolist())]
    return h


def crc_of_id(column):
    """crc32 of an id written as text."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary"))
