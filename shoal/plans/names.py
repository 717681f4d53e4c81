"""A stored index of the three-sign pieces of names and paths: which rows contain a text, without reading the others.

Texts are numbered where they lie, and ``BLOCK`` neighbours are a block. A posting ``(gram, chunk, blocks)`` tells
by 64 bits which blocks of a chunk hold a gram, so postings follow the blocks' distinct grams and not the signs of
all texts, and only they are shuffled. A search reads the postings of the pattern's grams, keeps the
blocks that have all of them, and reads the pages of these; the pattern itself decides on each text. A hit has
all grams of the pattern, so none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_path
from ..sources.generations import Generations
from ..sources.views import query

#: Signs of a gram; signs of text that a bucket is made for; fewest and most buckets; rows a page.
SIGNS, BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS, PAGE = 3, 1 << 26, 16, 4096, 1 << 10
#: Bits of the rows of a block; bits of the blocks of a chunk.
BLOCK, CHUNK = 9, 6
#: Chunks that a search asks for by ranges of places, and ranges at most; beyond, chunks are joined.
CHUNKS, RANGES = 1 << 12, 64

TEXTS, POSTINGS = "place long, id long, text string", "gram string, chunk long, blocks long, bucket int"


def grams(text: Column) -> Column:
    """The distinct pieces of ``SIGNS`` signs of a lower-cased text."""
    folded = F.lower(text)
    starts = F.sequence(F.lit(1), F.char_length(folded) - (SIGNS - 1))
    return F.when(F.char_length(folded) >= SIGNS, F.array_distinct(F.transform(starts, lambda k: F.substring(folded, k, SIGNS)))).otherwise(F.array().cast("array<string>"))


def pieces(pattern: str) -> list[str]:
    r"""The literal parts of a LIKE pattern between its wildcards ``%`` and ``_``; ``\`` makes the next sign literal."""
    out = [""]
    for sign in re.findall(r"\\.|.", pattern, re.DOTALL):
        if sign in ("%", "_"):
            out.append("")
        else:
            out[-1] += sign[-1]
    return [x for x in out if x]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of folded texts as a number of 63 bits, and its text's place."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(texts)), n)
    whole = own[: max(0, len(own) - 2)] == own[2:]
    return ((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:])[whole], own[2:][whole]


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _posted(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """``(gram, chunk, blocks)`` of batches of ``(place, folded)`` in blocks of ``bits``: a row a gram and chunk of a batch."""
    for batch in batches:
        place = batch.column(0).to_numpy()
        code, at = _codes([x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
        block = place[at] >> bits
        for chunk in np.unique(block >> CHUNK):
            here = block >> CHUNK == chunk
            found, which = np.unique(code[here], return_inverse=True)
            held = np.zeros((len(found), 1 << CHUNK), bool)
            held[which, block[here] & (1 << CHUNK) - 1] = True
            blocks = np.packbits(held, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.record_batch([pa.array([_gram(c) for c in found.tolist()]), pa.array(np.full(len(found), chunk)), pa.array(blocks)], ["gram", "chunk", "blocks"])


def _ranges(blocks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(seq, first, last)`` of runs of ``(seq, block)``; of more than ``RANGES`` the nearest ones of a generation are one."""
    runs: list[list[int]] = []
    for seq, block in sorted(blocks):
        if runs and runs[-1][0] == seq and runs[-1][2] + 1 >= block:
            runs[-1][2] = block
        else:
            runs.append([seq, block, block])
    gaps = sorted(b[1] - a[2] for a, b in zip(runs, runs[1:]) if a[0] == b[0])
    least = gaps[min(len(runs) - RANGES, len(gaps)) - 1] if len(runs) > RANGES and gaps else 0
    out: list[list[int]] = []
    for run in runs:
        if out and out[-1][0] == run[0] and run[1] - out[-1][2] <= least:
            out[-1][2] = run[2]
        else:
            out.append(run)
    return [tuple(r) for r in out]


class NameIndex(Generations):
    """A stored index of rows ``(id, text)``; one writer at a time. An id with several rows is each of them; nulls are left out."""

    @classmethod
    def create(cls, rows: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> NameIndex:
        index = cls(rows.sparkSession, path)
        n = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
        index._log(0, "buckets", min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (n // bucket_rows).bit_length())))
        index.append(rows)
        return index

    def append(self, rows: DataFrame) -> None:
        """Index further rows as a generation of their own."""
        _, known, seq = self._state()
        rows = rows.where("id IS NOT NULL AND text IS NOT NULL").select(F.monotonically_increasing_id().alias("place"), F.col("id").cast("long").alias("id"), "text")
        rows.write.option("parquet.page.row.count.limit", PAGE).mode("overwrite").parquet(f"{self.path}/texts/seq={seq}")
        stored = self._read("texts", [seq], TEXTS)
        posted = stored.select("place", F.lower("text").cast("binary").alias("folded")).mapInArrow(lambda it: _posted(it, BLOCK), "gram string, chunk long, blocks long")
        posted = posted.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(known["buckets"])).cast("int"))
        placed = posted.repartition("bucket").sortWithinPartitions("bucket", "gram", "chunk")  # a gram has a row or two a chunk, so no bucket is large for its gram
        placed.write.option("parquet.page.row.count.limit", PAGE).partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/seq={seq}")
        self._log(seq, "rows")

    def contains(self, text: str) -> DataFrame:
        """``(id, text)`` of rows whose text is ``ILIKE %text%``; wildcards in ``text`` are live.

        A text without three signs in a row between wildcards has no gram; it scans the stored texts.
        """
        seqs = self._state()[0]["rows"]
        hit = F.col("text").ilike(f"%{text}%")
        # the engine folds the pieces, as it folded the texts
        asked = self.spark.sql("SELECT * FROM VALUES (0) AS one(x)").select(F.flatten(F.array(*[grams(F.lit(p)) for p in pieces(text)], F.array().cast("array<string>")))).first()[0]
        if not asked:
            return self._live(self._read("texts", seqs, TEXTS).where(hit), "id").select("id", "text")
        buckets = [r.b for r in self.spark.createDataFrame([(g,) for g in set(asked)], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(self._state()[1]["buckets"])).alias("b")).distinct().collect()]  # a row a gram of the pattern
        posted = self._read("postings", seqs, POSTINGS).where(F.col("bucket").isin(buckets) & F.col("gram").isin(asked))
        of_gram = posted.groupBy("seq", "chunk", "gram").agg(F.bit_or("blocks").alias("blocks"))
        common = of_gram.groupBy("seq", "chunk").agg(F.count("*").alias("n"), F.bit_and("blocks").alias("blocks")).where((F.col("n") == len(set(asked))) & (F.col("blocks") != 0)).select("seq", "chunk", "blocks")
        some = common.limit(CHUNKS + 1).collect()
        if not some:
            return self.spark.createDataFrame([], "id long, text string")
        texts = self._read("texts", seqs, TEXTS)
        if len(some) > CHUNKS:
            rows = texts.withColumn("chunk", F.shiftright("place", BLOCK + CHUNK)).join(common.select("seq", "chunk"), ["seq", "chunk"], "left_semi")
        else:
            blocks = [(r.seq, (r.chunk << CHUNK) + k) for r in some for k in range(1 << CHUNK) if r.blocks >> k & 1]
            within = lambda s, a, b: (F.col("seq") == s) & (F.col("place") >= a << BLOCK) & (F.col("place") < (b + 1) << BLOCK)
            rows = texts.where(reduce(Column.__or__, [within(*r) for r in _ranges(blocks)]))
        return self._live(rows.where(hit).select("id", "text", "seq"), "id").select("id", "text")


@query("filename_index", "SELECT id FROM assets WHERE path ILIKE '%lust\\_1000%4' ESCAPE '\\' OR path ILIKE '%lust\\_1000%4%' ESCAPE '\\'", "assets")
def _filename_index(t):
    """File names that contain a text with a wildcard, from an index that grew by an append and lost and regained rows."""
    rows = t.assets.select("id", F.col("path").alias("text"))
    early = F.col("id") % 3 > 0
    index = NameIndex.create(rows.where(early), fresh_path(t.spark, "name-index"))
    index.append(rows.where(~early))
    index.remove(rows.where("id % 5 = 0").select("id"))
    index.append(rows.where("id % 5 = 0"))
    return index.contains(r"lust\_1000%4").select("id")


@query("suggest_index", "SELECT id, name FROM tags WHERE category = 'character' AND name ILIKE '%idge%' ORDER BY name, id LIMIT 30", "tags")
def _suggest_index(t):
    """Tag suggestions while one types: the index holds the names of one category."""
    index = NameIndex.create(t.tags.where("category = 'character'").select("id", F.col("name").alias("text")), fresh_path(t.spark, "name-index"))
    return index.contains("idge").orderBy("text", "id").limit(30).select("id", F.col("text").alias("name"))
