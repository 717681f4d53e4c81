"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` bytes, with the cumulative numbers of units,
code points and bytes at the end of each. A cut after some number of units is found by its frame alone: a
binary search over the counts, one frame decompressed. Outputs are made by streaming prefix, suffix and
middle frame by frame into new frames, and are read back the same way: their marks are found in the
stream, and the three parts are streamed in the text's order. So a task holds one frame decompressed,
whatever a text's length, besides the text's row.

A unit is a word with the white space before it; white space at a text's end is a unit of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .text import SPACES, Chunk, chunks

#: Bytes of a frame before compression.
FRAME = 1 << 16
#: The marks of an output's parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

FRAMES = "doc_id long, n long, n_bytes long, marked boolean, units array<long>, chars array<long>, bytes array<long>, frames array<binary>"
OUTPUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, bytes array<long>, frames array<binary>"
TEXTS = "doc_id long, form string, sha256 string, bytes array<long>, frames array<binary>"


class Seekable:
    """Frames of one text with the bytes up to each one's end; the last frame that was read stays decompressed."""

    _reader = zstandard.ZstdDecompressor()

    def __init__(self, ends: list[int], frames: list[bytes]):
        self.ends, self.frames, self.size = ends, frames, ends[-1] if ends else 0
        self._at, self._data = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self._at:
            self._at, self._data = k, self._reader.decompress(self.frames[k])
        return self._data

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """Bytes ``begin:end``, in pieces of a frame at most."""
        k = bisect_right(self.ends, begin)
        while begin < end:
            base = self.ends[k] - len(self.frame(k))
            piece = self.frame(k)[begin - base : end - base]
            yield piece
            begin, k = begin + len(piece), k + 1

    def find(self, mark: bytes, begin: int) -> int:
        """Where ``mark`` first is from ``begin`` on; it may lie over the edge of two frames."""
        tail, at = b"", begin
        for piece in self.stream(begin, self.size):
            k = (tail + piece).find(mark)
            if k >= 0:
                return at - len(tail) + k
            at, tail = at + len(piece), (tail + piece)[1 - len(mark) :]
        raise ValueError(f"no {mark.decode()} in an output")


class Framing:
    """Takes pieces, makes frames of ``size`` bytes, and digests what it takes."""

    _writer = zstandard.ZstdCompressor(level=3)

    def __init__(self, size: int = FRAME):
        self.ends: list[int] = []
        self.frames: list[bytes] = []
        self.digest, self._held, self._room, self._size, self._whole = hashlib.sha256(), [], size, 0, size

    def take(self, pieces: Iterable[bytes]) -> None:
        for piece in pieces:
            self.digest.update(piece)
            while piece:
                part, piece = piece[: self._room], piece[self._room :]
                self._held.append(part)
                self._room -= len(part)
                if not self._room:
                    self.close()

    def close(self) -> None:
        if self._held:
            data = b"".join(self._held)
            self._size += len(data)
            self.ends.append(self._size)
            self.frames.append(self._writer.compress(data))
            self._held, self._room = [], self._whole


def _frame_rows(c: Chunk, size: int) -> dict[str, pa.Array]:
    """The frames of a chunk's texts."""
    body = c.buf[:-8]
    _, last, _ = c.words()
    chars = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
    raw = c.buf.tobytes()
    marked = np.zeros(c.n, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = raw.find(mark)
        while at >= 0:
            marked[np.searchsorted(c.start, at, "right") - 1] = True
            at = raw.find(mark, at + 1)
    owner, ends = np.arange(c.n), c.end
    if (c.end - c.start > size).any():
        cuts = [[*range(a + size, b, size), b] for a, b in zip(c.start.tolist(), c.end.tolist())]
        owner, ends = np.repeat(owner, [len(x) for x in cuts]), np.array([x for own in cuts for x in own], np.int64)
        while (split := (ends < c.end[owner]) & ((c.buf[ends] & 0xC0) == 0x80)).any():  # no frame ends inside a code point
            ends = ends - split
    begin = np.where(np.append(-1, owner[:-1]) == owner, np.append(0, ends[:-1]), c.start[owner])
    some = begin < ends  # an empty text has no frame
    owner, begin, ends = owner[some], begin[some], ends[some]
    base = np.searchsorted(last, c.start, "right")
    units = np.searchsorted(last, ends, "right") - base[owner]
    words = np.searchsorted(last, c.end, "right") - base
    trailing = (c.end > c.start) & SPACES[c.buf[np.maximum(c.end - 1, 0)]]
    frames = [Framing._writer.compress(raw[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
    lists = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=c.n)))), pa.int32())
    each = lambda x, t: pa.ListArray.from_arrays(lists, pa.array(x, t))
    return {
        "doc_id": c.column("doc_id"),
        "n": pa.array(words + trailing),
        "n_bytes": pa.array(c.end - c.start),
        "marked": pa.array(marked),
        "units": each(units, pa.int64()),
        "chars": each(chars[ends] - chars[c.start[owner]], pa.int64()),
        "bytes": each(ends - c.start[owner], pa.int64()),
        "frames": each(frames, pa.binary()),
    }


def framed(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """Every text as frames, one row per row of ``docs``: ``n`` units, bytes, whether a mark is in it, and cumulative counts a frame.

    Null and empty texts have no frame. A frame ends between code points; a unit may go on in the next one
    and counts where it ends.
    """

    def run(batches):
        for c in chunks(batches):
            yield pa.RecordBatch.from_pydict(_frame_rows(c, size))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FRAMES)


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:doc_id``; without a doc_id, of ``seed:``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(frames: DataFrame, seed: int = 42, moved: int = 50, suffix_first: int = 80) -> DataFrame:
    """``frames`` with ``form`` and the units before the middle (``first``) and before the suffix (``second``)."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n_bytes") == 0) | F.col("marked") | (h3 % 100 >= moved)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    return frames.select("*", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def _cut(text: Seekable, units: list[int], chars: list[int], n: int, unit: int) -> tuple[int, int]:
    """Bytes and code points of the first ``unit`` of ``n`` units."""
    if unit == 0:
        return 0, 0
    if unit == n:
        return text.size, chars[-1]
    k = bisect_left(units, unit)
    data = np.frombuffer(text.frame(k), np.uint8)
    space = SPACES[data]
    before = (units[k - 1], chars[k - 1]) if k else (0, 0)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    nth = unit - before[0] - 1
    at = int(ends[nth]) if nth < len(ends) else len(data)  # a unit that ends with its frame
    return text.ends[k] - len(data) + at, before[1] + int(np.count_nonzero((data[:at] & 0xC0) != 0x80))


def _hexdigest(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def _outputs(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "bytes", "frames"]
    for batch in batches:
        rows = []
        for doc, n, form, first, second, units, chars, ends, frames in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "form", "first", "second", "units", "chars", "bytes", "frames"))):
            text = Seekable(ends, frames)
            if form == "plain":
                rows.append((doc, n, form, None, None, _hexdigest(text.stream(0, text.size)), ends, frames))
                continue
            (a, before), (b, upto) = _cut(text, units, chars, n, first), _cut(text, units, chars, n, second)
            prefix, middle, suffix = (0, a), (a, b), (b, text.size)
            out = Framing(size)
            for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)):
                out.take([mark])
                out.take(text.stream(*part))
            out.close()
            rows.append((doc, n, form, before, upto - before, out.digest.hexdigest(), out.ends, out.frames))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def fill_in_middle(frames: DataFrame, seed: int = 42, moved: int = 50, suffix_first: int = 80, size: int = FRAME) -> DataFrame:
    """The outputs of ``framed`` texts, as frames: ``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, bytes, frames)``.

    A text is cut after two drawn numbers of units, the smaller first. ``moved`` of a hundred texts change
    their form, ``suffix_first`` of a hundred of these to suffix, prefix, middle (spm), others to prefix,
    suffix, middle (psm); each part follows its mark. Empty and null texts and texts that hold a mark stay
    plain and have null chars. Equal cuts give an empty middle. Rows that share a doc_id are cut by the same
    draws; rows without one too, those of an empty id.
    """
    rows = planned(frames, seed, moved, suffix_first).select("doc_id", "n", "form", "first", "second", "units", "chars", "bytes", "frames")
    return rows.mapInArrow(lambda it: _outputs(it, size), OUTPUTS)


def _parts(out: Seekable, form: str) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix lie in an output; its text holds no mark, so the first of each is the mark."""
    if form == "plain":
        return [(0, out.size)]
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at = [0]
    for mark in order[1:]:
        at.append(out.find(mark, at[-1] + len(mark)))
    parts = dict(zip(order, [(a + len(m), b) for m, a, b in zip(order, at, [*at[1:], out.size])]))
    return [parts[PREFIX], parts[MIDDLE], parts[SUFFIX]]


def _restored(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    for batch in batches:
        rows = []
        for doc, form, ends, frames in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "form", "bytes", "frames"))):
            out, text = Seekable(ends, frames), Framing(size)
            for part in _parts(out, form):
                text.take(out.stream(*part))
            text.close()
            rows.append((doc, form, text.digest.hexdigest(), text.ends, text.frames))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["doc_id", "form", "sha256", "bytes", "frames"])


def restored(outputs: DataFrame, size: int = FRAME) -> DataFrame:
    """The texts again, from outputs and their forms alone: ``(doc_id, form, sha256, bytes, frames)``."""
    return outputs.select("doc_id", "form", "bytes", "frames").mapInArrow(lambda it: _restored(it, size), TEXTS)


def as_text(frames: DataFrame) -> DataFrame:
    """``frames`` with their ``text``, whole, in place of the frames: for texts that fit a row."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("frames")
            text = [b"".join(map(Seekable._reader.decompress, x)).decode() for x in batch.column(k).to_pylist()]
            rest = [n for n in batch.schema.names if n not in ("frames", "bytes")]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in rest), pa.array(text, pa.string())], [*rest, "text"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name not in ("frames", "bytes")]
    return frames.mapInArrow(run, ", ".join([*rest, "text string"]))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outputs without their frames, with the digest of what they give back."""
    for batch in batches:
        back = []
        for form, ends, frames in zip(*(batch.column(c).to_pylist() for c in ("form", "bytes", "frames"))):
            out = Seekable(ends, frames)
            back.append(_hexdigest(piece for part in _parts(out, form) for piece in out.stream(*part)))
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
        yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(back, pa.string())], [*names, "restored_sha256"])


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents: frames are written once, outputs are made from them and read back.

    Nulls, empty texts, marks in texts and repeated ids: as ``fill_in_middle`` has them. Very long texts are
    many frames; repeated rows get the same result each; there are no ties. An empty table gives an empty
    table; further columns play no part.
    """
    frames, _ = written(framed(spark.read.parquet(f"{sf_dir}/documents.parquet")), "frames", "none")
    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return fill_in_middle(frames).mapInArrow(_digests, columns)


ORACLE_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
