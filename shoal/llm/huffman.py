"""Token ids in files of canonical, length-limited Huffman codes.

A file holds blocks. A block has whole documents, its own payload and the bit offset of every
``STRIDE``-th id, so blocks decode independently and a block's strides decode side by side, one table
look-up an id. The code's lengths come from counts of all ids and are stored beside the blocks;
canonical codes follow from the lengths. Files are Parquet, one block a row, so Spark's readers and
writers place them on any shared store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import drop, fresh_path, written
from .text import loads
from .tokens import packed, token_table, width_of

#: Longest code in bits; ids between two checkpoints; ids a block.
LONGEST, STRIDE, BLOCK = 18, 256, 1 << 19

BLOCKS = "part int, block int, before long, doc_ids array<long>, sizes array<long>, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each id's code (0: the id doesn't occur), by the package-merge method."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    items, is_coin = coins, [np.ones(len(coins), bool)]
    for _ in range(longest - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((coins, pairs))
        order = np.argsort(both, kind="stable")
        items = both[order]
        is_coin.append(order < len(coins))
    take = 2 * len(coins) - 2
    for level in reversed(is_coin):
        chosen = int(level[:take].sum())
        out[used[:chosen]] += 1
        take = 2 * (take - chosen)
    return out


def canonical_codes(length: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(length), np.uint64)
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    code, last = 0, 0
    for size in np.unique(length[order]).tolist():
        own = order[length[order] == size]
        code <<= size - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), size
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[bytes, bytes]:
    """Bit offsets of every STRIDE-th id, and the bits, most significant first."""
    if not len(ids):
        return b"", b""
    size = length[ids]
    end = np.cumsum(size)
    at = end - size
    value, word, room = codes[ids], at >> 6, 64 - (at & 63) - size
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    fits = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[begin]] = np.add.reduceat(fits, begin)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    return at[::STRIDE].astype("<u8").tobytes(), out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8]


def decode_table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each next ``longest`` bits: the id and its code's bits."""
    longest = max(1, int(length.max(initial=0)))
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    times = 1 << (longest - length[order])
    ids, bits = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    ids[: times.sum()], bits[: times.sum()] = np.repeat(order, times), np.repeat(length[order], times)
    return ids, bits, longest


def decode_block(n: int, offsets: bytes, bits: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block: all strides advance by one id a step."""
    ids, size, longest = table
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    window = loads(np.concatenate((np.frombuffer(bits, np.uint8), np.zeros(16, np.uint8))), ">u8")
    out = np.zeros((len(at), STRIDE), np.uint32)
    rest = n - STRIDE * (len(at) - 1) if n else 0
    for step in range(STRIDE if len(at) > 1 else rest):
        if step == rest:
            at = at[:-1]
        peek = (window[at >> 3] >> (64 - longest - (at & 7)).astype(np.uint64)).astype(np.int64) & ((1 << longest) - 1)
        out[: len(at), step] = ids[peek]
        at = at + size[peek]
    return out.ravel()[:n]


def _count(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"))
        if len(own) > len(total):
            own[: len(total)] += total
            total = own
        else:
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])


def _blocks(batches: Iterable[pa.RecordBatch], codes: np.ndarray, length: np.ndarray, width: int, most: int) -> Iterator[pa.RecordBatch]:
    part, block, before = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    raws: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        sizes = [len(x) // width for x in raws]
        offsets, bits = encode_block(np.frombuffer(b"".join(raws), f"<u{width}"), codes, length)
        row = [part, block, before, docs, sizes, offsets, bits]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, types)], ["part", "block", "before", "doc_ids", "sizes", "offsets", "bits"])

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc)
            raws.append(raw)
            held += len(raw) // width
            if held >= most:
                yield flush()
                block, before, held, docs, raws = block + 1, before + held, 0, [], []
    if docs:
        yield flush()


def write_ids(docs: DataFrame, tokenizer: str, end: int, path: str, longest: int = LONGEST, block: int = BLOCK) -> None:
    """Encode all texts and write their ids under ``path`` (blocks, codebook) in ascending doc_id order.

    A block ends with the document that brings it to ``block`` ids, so a very long text is one block.
    Null and empty texts have the end id alone. Rows with equal doc_id follow each other in order of their
    text's hash, null doc_ids come first; repeated rows are written each. An empty table writes no
    blocks; further columns play no part.
    """
    spark, width = docs.sparkSession, width_of(tokenizer)
    tokens, made = written(token_table(docs, tokenizer, end), "ids")
    found = tokens.select("ids").mapInArrow(lambda it: _count(it, width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row an id of the vocabulary
    counts = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
    counts[[r.id for r in found]] = [r.n for r in found]
    length = code_lengths(counts, longest)
    codes = canonical_codes(length)
    used = np.flatnonzero(length)
    spark.createDataFrame([(int(i), int(length[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() // (8 * block)))
    ordered = tokens.select("doc_id", "ids", "mark").repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "ids")
    sent = spark.sparkContext.broadcast((codes, length))
    ordered.mapInArrow(lambda it: _blocks(it, *sent.value, width, block), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, made)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document, from the files alone; ids are little-endian unsigned 32-bit numbers.

    start counts the ids of all documents before. Files without blocks give an empty table.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row an id of the vocabulary
    length = np.zeros(max((r.id for r in book), default=-1) + 1, np.int64)
    length[[r.id for r in book]] = [r.bits for r in book]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # ids before each file: sums of runs of files, then within a run, so that no task has all files
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)
    files = blocks.groupBy("part").agg(F.sum(size).alias("n")).withColumn("run", F.shiftright("part", 10))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("base"))  # a row a thousand files
    starts = files.withColumn("own", before(Window.partitionBy("run").orderBy("part"))).join(runs, "run").select("part", (F.col("base") + F.col("own")).alias("start"))
    starts, _ = written(starts, "starts")  # Spark sees its size, and sends it to all tasks only while it is small
    sent = spark.sparkContext.broadcast(length)

    def run(batches):
        table = decode_table(sent.value)
        for batch in batches:
            for first, docs, sizes, offsets, bits in zip(*(x.to_pylist() for x in batch.columns)):
                count = np.array(sizes, np.int64)
                ids = decode_block(int(count.sum()), offsets, bits, table)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(first + np.cumsum(count) - count), pa.array(count), packed(ids.astype("<u4"), count)], ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(starts, "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "sizes", "offsets", "bits")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_ids(spark, sf_dir: str, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """All documents' ids written to Huffman files and read back from them.

    Null and empty texts have the end id alone; a very long text is one block. Rows that share a doc_id, null or
    not, follow each other by their text's hash, so equal texts tie and are alike; null ids come first.
    Repeated rows are written each. An empty table gives an empty table; further columns play no part.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = fresh_path(spark, "huffman")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, end, path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
