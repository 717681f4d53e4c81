"""Line dedup with two Bloom filters: lines seen once and lines seen twice.

Each task fills both filters from its own lines; merging two tasks' filters marks as seen twice
what both have seen once. Only lines that the merged twice-filter suspects are shuffled, as
themselves, for an exact count of their documents and the choice of the one that keeps them. The
filters' size follows the text up to ``MOST_BITS``; a fuller filter suspects more, but never loses
a repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .text import FOLD, Chunk, chunks

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Largest filter (32 MB); bytes of a filter that travel in one row.
MOST_BITS, PIECE = 1 << 28, 1 << 16
#: Rows of one line that a task may join, at least.
HOT_ROWS = 1000

_NL = 0x0A


def _keys(c: Chunk, least_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Of the lines whose key is long enough: text, number in the text, key and the key's hash."""
    buf = FOLD[c.buf]
    buf[np.concatenate(([0], c.end))] = _NL
    nl = np.flatnonzero(buf[:-8] == _NL)
    begin, end = nl[:-1] + 1, nl[1:]
    first, last, _ = c.words()
    a = first[np.minimum(np.searchsorted(first, begin), len(first) - 1)] if len(first) else end
    b = np.append(0, last)[np.searchsorted(last, end, "right")]
    chars = np.concatenate(([0], np.cumsum((buf[:-8] & 0xC0) != 0x80)))
    long = np.flatnonzero((a < b) & (a < end) & (chars[np.maximum(a, b)] - chars[a] >= least_chars))
    doc = np.searchsorted(c.start, begin[long], "right") - 1
    raw = buf.tobytes()
    keys = [raw[x:y] for x, y in zip(a[long].tolist(), b[long].tolist())]
    line = long - np.searchsorted(begin, c.start)[doc]
    return doc, line, keys, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions a hash."""
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at.ravel() >> 3, np.uint8(1) << (at.ravel() & 7).astype(np.uint8))


def _fill(batches: Iterable[pa.RecordBatch], bits: int, least_chars: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for c in chunks(batches):
        doc, _, _, h = _keys(c, least_chars)
        own = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)[0] if len(h) else h  # a text counts once
        h, n = np.unique(own, return_counts=True)
        at = _probes(h, bits)
        again = (n > 1) | _has(once, at)
        _set(twice, at[:, again])
        _set(once, at)
    for k in range(0, bits // 8, PIECE):
        a, b = once[k : k + PIECE], twice[k : k + PIECE]
        if a.any():
            yield pa.record_batch([pa.array([k // PIECE], pa.int32()), pa.array([zlib.compress(a, 1)]), pa.array([zlib.compress(b, 1)])], ["piece", "once", "twice"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, a, b in zip(*(x.to_pylist() for x in batch.columns)):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = held.get(k, (0, 0))
            held[k] = (once | a, twice | b | (once & a))
    for k, (_, twice) in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(twice), 1)])], ["piece", "twice"])


def _suspects(batches: Iterable[pa.RecordBatch], twice: np.ndarray, least_chars: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        doc, line, keys, h = _keys(c, least_chars)
        rows: dict[tuple[int, bytes], list[int]] = {}
        for k in np.flatnonzero(_has(twice, _probes(h, 8 * len(twice)))).tolist():
            rows.setdefault((int(doc[k]), keys[k]), []).append(int(line[k]))
        own = np.array([d for d, _ in rows], np.int64)
        yield pa.record_batch([c.column("doc_id").take(pa.array(own)), c.column("mark").take(pa.array(own)), pa.array([k for _, k in rows], pa.binary()), pa.array(list(rows.values()), pa.list_(pa.int32()))], ["doc_id", "mark", "key", "lines"])


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, mark, drop)``: for texts that lose lines, the numbers of those lines from 0, ascending. mark is xxhash64 of the text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 20, 1 << (size // 16).bit_length()))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    pieces = rows.select("text").mapInArrow(lambda it: _fill(it, bits, least_chars), "piece int, once binary, twice binary")
    merged = pieces.repartition("piece").mapInArrow(_merge, "piece int, twice binary").collect()  # bits / 8 bytes at most
    twice = np.zeros(bits // 8, np.uint8)
    for k, x in merged:
        twice[k * PIECE : (k + 1) * PIECE] = np.frombuffer(zlib.decompress(x), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(twice)
    found = rows.mapInArrow(lambda it: _suspects(it, sent.value, least_chars), "doc_id long, mark long, key binary, lines array<int>")
    found, _ = written(found, "lines")
    # rows that share a doc_id are one document: the few that do count once a line
    twice_named, _ = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    own = found.join(twice_named, "doc_id", "left_anti").select("key", "doc_id")
    own = own.unionByName(found.join(twice_named, "doc_id", "left_semi").select("key", "doc_id").distinct())
    sure = own.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs)
    sure, _ = written(sure, "repeated-lines")
    # a line that makes up more than a thousandth of all suspects is dealt over several tasks; there are fewer than a thousand
    share = max(HOT_ROWS, found.count() // 1000)
    hot = F.broadcast(sure.where(F.col("n") > share).select(F.xxhash64("key").alias("h"), F.ceil(F.col("n") / share).alias("parts")).groupBy("h").agg(F.max("parts").alias("parts")))
    dealt = found.withColumn("h", F.xxhash64("key")).join(hot, "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "mark"), "parts"), F.lit(0)))
    keys = sure.withColumn("h", F.xxhash64("key")).join(hot, "h", "left").select("key", "keeper", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    gone = dealt.join(keys, ["key", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("drop"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the kept lines as ``kept``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    ``least_chars`` code points in at least ``least_docs`` documents lose all their lines except in rows
    of the largest doc_id that holds them. Rows that share a doc_id are one document; a row without
    doc_id is one of its own and never the largest while another holds the line. Null and empty texts are
    one empty line; a very long text is one row of a task, whose memory it needs a few times over. Repeated
    rows get the same result. An empty table gives an empty table; further columns stay, those of the
    names added here are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    gone = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least_chars, least_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("at"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("at")), "left")
    body = F.coalesce("row.text", F.lit(""))  # the text travels once, within its row
    out = out.select("row", "drop", F.split(body, "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")  # by hash, so a long text costs its length
    kept = F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n")
    out = out.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), body).otherwise(kept).alias("kept"),
    )
    return out.select("row.*", "n_lines", "n_dropped", "kept")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's kept lines, as digests.

    Null and empty texts are one empty line; very long texts are split whole, in one task's row. Rows that share a
    doc_id are one document for a line's count and each keep or lose their lines; a row without a doc_id is a
    document of its own. Of equal lines the largest doc_id keeps its own, so there are no other ties. An empty
    table gives an empty table; further columns play no part.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP4 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k, ls[k] AS line,
  translate(regexp_replace(ls[k], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, (SELECT unnest(generate_series(1, (SELECT max(len(ls)) FROM d))) AS k) WHERE k <= len(ls)),
g AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL AND l.doc_id <> g.keeper) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.key IS NULL OR l.doc_id = g.keeper), '')) AS kept_sha256
FROM l LEFT JOIN g USING (key) GROUP BY l.doc_id
"""
