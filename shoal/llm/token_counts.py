"""Token counts from a digest cache.

The cache is a Parquet table, one folder for each version of a tokenizer (the digest of its file and of
its library's version), with a row for each content ever counted: the sha256 of the normalised text, and
its count. A run digests all texts, joins the distinct digests to the cache, encodes what it lacks, each
content once, and appends that. A second run over the same texts, or over copies of them, encodes nothing.

Digests travel, texts stay: Bloom filters of the missing digests and of those that several rows share go
to the tasks that read the texts. A row that no filter suspects is a hit, or the only row of its content
and is encoded where it lies; only texts that rows may share are shuffled, by digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop, fresh_path, written
from .text import chunks
from .tokens import encoder

#: Largest filter in bits (32 MB), bits a digest, bytes of a filter that travel in one row.
MOST_BITS, BITS_EACH, PIECE = 1 << 28, 10, 1 << 16
#: Digests that a task remembers having sent on.
REMEMBERED = 1 << 17
#: Texts that go to sentencepiece in one call.
AT_ONCE = 64

CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it: another file or library, another cache."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(library.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """A form of the text that has the same tokens: null as empty, and A-Z lower-cased where the tokenizer itself does so.

    A text with the string of an added token, in any case, stays as it is: such strings are looked up
    before the tokenizer lower-cases.
    """
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".model"):
        return text
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if t.encode("A b", add_special_tokens=False).ids != t.encode("a b", add_special_tokens=False).ids:
        return text
    special = F.lit(False)
    for x in t.get_added_tokens_decoder().values():
        special |= F.lower(text).contains(x.content.lower())
    return F.when(special, text).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


_pieces: dict[str, object] = {}


def _count(batch: pa.RecordBatch, path: str) -> np.ndarray:
    """Tokens of each text, as the library gives them."""
    if not path.endswith(".model"):
        enc = encoder(path, 0)
        return np.concatenate([enc.encode(c)[1] - 1 for c in chunks([batch])] or [np.zeros(0, np.int64)])  # without the end id
    if path not in _pieces:
        import sentencepiece

        _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    found = [len(x) for k in range(0, len(texts), AT_ONCE) for x in _pieces[path].encode(texts[k : k + AT_ONCE], num_threads=1)]
    return np.array(found, np.int64)


# Bloom filters of digests; a digest's own bytes are its hashes
def _places(digests: pa.Array, bits: int) -> np.ndarray:
    """Three bit positions of each digest."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    return (raw[:, :3] & np.uint64(bits - 1)).T.astype(np.int64)


def _fill(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        at = _places(batch.column(0), bits).ravel()
        np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    for k in range(0, len(held), PIECE):
        part = held[k : k + PIECE]
        if part.any():
            yield pa.record_batch([pa.array([k // PIECE], pa.int32()), pa.array([zlib.compress(part, 1)])], ["piece", "bits"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(*(x.to_pylist() for x in batch.columns)):
            held[k] = held.get(k, np.uint8(0)) | np.frombuffer(zlib.decompress(raw), np.uint8)
    for k, part in held.items():
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(part), 1)])], ["piece", "bits"])


def _filter(digests: DataFrame, n: int) -> np.ndarray:
    """A filter of ``n`` digests: one task a part of it, and ``MOST_BITS`` / 8 bytes at most to the driver."""
    bits = min(MOST_BITS, max(1 << 13, 1 << (BITS_EACH * n).bit_length()))
    pieces = digests.select("digest").mapInArrow(lambda it: _fill(it, bits), "piece int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for k, raw in pieces.repartition("piece").mapInArrow(_merge, "piece int, bits binary").collect():
        part = np.frombuffer(zlib.decompress(raw), np.uint8)
        out[k * PIECE : k * PIECE + len(part)] = part
    return out


def _suspected(held: np.ndarray, digests: pa.Array) -> np.ndarray:
    at = _places(digests, 8 * len(held))
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


_SENT = "digest binary, n_tokens long, text string"


def _encode(batches: Iterable[pa.RecordBatch], path: str, missing: np.ndarray | None, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of contents that one row has; texts, without a count yet, of contents that rows may share."""
    sent: set[bytes] = set()
    for batch in batches:
        wanted = _suspected(missing, batch.column(0)) if missing is not None else np.ones(batch.num_rows, bool)
        several = wanted & _suspected(shared, batch.column(0))
        own = batch.filter(pa.array(wanted & ~several))
        yield pa.record_batch([own.column(0), pa.array(_count(own, path), pa.int64()), pa.nulls(own.num_rows, pa.string())], ["digest", "n_tokens", "text"])
        rows = []
        for k in np.flatnonzero(several).tolist():
            key = batch.column(0)[k].as_py()
            if key not in sent:
                rows.append(k)
                if len(sent) < REMEMBERED:
                    sent.add(key)
        both = batch.take(pa.array(rows, pa.int64()))
        yield pa.record_batch([both.column(0), pa.nulls(both.num_rows, pa.int64()), both.column(1)], ["digest", "n_tokens", "text"])


def _rest(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(_count(batch, path), pa.int64())], ["digest", "n_tokens"])


def cached(spark, cache: str, tokenizer: str) -> DataFrame:
    """The cache's rows ``(digest, n_tokens)`` for this version of the tokenizer."""
    path = f"{cache}/tokenizer={tokenizer_version(tokenizer)}"
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(path)  # so that there is a table to read
    return spark.read.schema(CACHE).parquet(path)


def fill_cache(contents: DataFrame, seen: DataFrame, cache: str, tokenizer: str) -> int:
    """Encode the contents that the cache lacks, append their counts, and return how many there were.

    ``contents(digest, text)`` has all rows, ``seen(digest, rows)`` each digest once with its number of rows.
    """
    spark = contents.sparkSession
    before = cached(spark, cache, tokenizer)
    missing, made = written(seen.join(before, "digest", "left_anti"), "missing")
    n, several = missing.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    if not n:
        drop(spark, made)
        return 0
    filters = (None if n == seen.count() else _filter(missing, n), _filter(missing.where("rows > 1"), several))
    sent = spark.sparkContext.broadcast(filters)
    first, sent_on = written(contents.mapInArrow(lambda it: _encode(it, tokenizer, *sent.value), _SENT), "counted")
    texts = first.where("text IS NOT NULL").select("digest", "text").dropDuplicates(["digest"])
    rest = texts.mapInArrow(lambda it: _rest(it, tokenizer), CACHE)
    fresh = first.where("text IS NULL").select("digest", "n_tokens").unionByName(rest)
    if filters[0] is not None:  # a filter also lets some hits through
        fresh = fresh.join(missing, "digest", "left_semi")
    fresh.write.mode("append").option("compression", "zstd").parquet(f"{cache}/tokenizer={tokenizer_version(tokenizer)}")
    drop(spark, made, sent_on)
    return n


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row per row of ``docs``, by way of the cache under ``cache``.

    Null texts are empty: no bytes, and as many tokens as the library gives an empty text (none). Very
    long texts are counted whole, in one task each. Repeated rows get a row each and are encoded once; rows
    without a doc_id keep none. An empty table gives an empty table and leaves the cache as it was; further
    columns play no part. The tokens are the library's (tokenizers for .json, sentencepiece for .model)
    without begin, end or added special tokens, without limits; strings of special tokens inside a text
    are what the library makes of them by default.
    """
    text = normalised(F.col("text"), tokenizer)
    digest = F.unhex(F.sha2(text, 256))
    keyed, _ = written(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    seen, made = written(keyed.groupBy("digest").agg(F.count("*").alias("rows")), "seen")
    fill_cache(docs.select(digest.alias("digest"), text.alias("text")), seen, cache, tokenizer)
    # writers at the same time may have appended one content twice
    known, _ = written(cached(docs.sparkSession, cache, tokenizer).join(seen, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    drop(docs.sparkSession, made)
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def op12_token_counts(spark, sf_dir: str, tokenizer: str | None = None, cache: str | None = None, limit: int = 512) -> DataFrame:
    """All documents through the cache: a new one in the shared folder unless one is named.

    Nulls, empty and very long texts, repeated rows and empty tables: as ``count_tokens`` has them; there
    are no ties.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, cache or fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
