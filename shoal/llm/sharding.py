"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. A bucket is a prefix of those bits; buckets of the
starting depth that hold more than the byte limit split on their next bit, again and again, and only
they do. The directory maps prefixes of different depth to shards; a row finds its shard by an
equi-join on each depth that occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


BITS = 60
#: Bytes of text a shard.
LIMIT = 1 << 20


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``(depth, prefix, bytes, docs)`` of each shard for ``rows(h, size)``.

    Starts from one bucket; a bucket that is too large and has more than one hash splits. Rows of one
    hash can't be told apart by further bits and stay together, however large.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    sums = (F.sum("size").alias("bytes"), F.count("*").alias("docs"))
    # all depths of interest at once would shuffle each row once a depth; sums of a depth come from those of a deeper one
    deep = min(BITS, max(1, math.ceil(math.log2(max(2, total / limit)))) + 6)
    done, left = None, rows
    start = 0
    while True:
        level, _ = written(left.groupBy(F.shiftright("h", BITS - deep).alias("prefix")).agg(*sums, F.min("h").alias("lo"), F.max("h").alias("hi")), "buckets")
        each = level.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(deep))))
        at = each.groupBy("depth", F.expr(f"shiftright(prefix, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        at = at.withColumn("fits", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == BITS))
        done = at if done is None else done.unionByName(at)
        tree, _ = written(done, "directory")
        # a bucket is a shard if it fits and its parent doesn't
        big = tree.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fit = tree.where("fits").withColumn("parent", F.shiftright("prefix", 1))
        shards = fit.join(big, ["depth", "parent"], "left_semi").unionByName(fit.where("depth = 0"))
        over = tree.where((F.col("depth") == deep) & ~F.col("fits")).select(F.col("prefix").alias("over"))
        if deep == BITS or over.isEmpty():
            return shards.select("depth", "prefix", "bytes", "docs")
        left = rows.join(over, F.shiftright("h", BITS - deep) == F.col("over"), "left_semi")
        done, start, deep = tree, deep + 1, min(BITS, deep + 8)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, depth, shard, shard_bytes, shard_docs)``, one row per row of ``docs``.

    shard is the hash prefix of ``depth`` bits, as text of 0 and 1 (empty for a single shard). Every shard
    holds at most ``limit`` bytes of text, except one whose rows all have the same id (or a single text
    above the limit), which no bit can split. Null and empty texts count 0 bytes; rows with a null id
    share one hash. An empty table gives an empty table; further columns play no part.
    """
    rows, _ = written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), id_hash().alias("h")), "sizes")
    found, _ = written(directory(rows, limit), "shards")
    return _located(rows, found).select("doc_id", F.col("size").alias("n_bytes"), "depth", "shard", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


def id_hash() -> Column:
    """The bits that name a row's bucket; a null id has those of an empty one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _located(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows``, which have a hash ``h``, with the shard of the directory ``found`` that has its prefix."""
    depths = [r.depth for r in found.select("depth").distinct().collect()]  # at most one a bit
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths or [0]]))
    looked = rows.withColumn("b", at).select(*rows.columns, "b.depth", "b.prefix")
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return looked.join(found, ["depth", "prefix"]).withColumn("shard", name)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as Parquet under ``path``, one folder a shard: every row once, rows with null or repeated ids too.

    A row's hash is computed in the row, and the shards of the distinct hashes are looked up, so no row is
    lost or multiplied. A column named shard is replaced by the folder's; an empty table writes no folder.
    """
    sizes, _ = written(docs.select(id_hash().alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "sizes")
    of = _located(sizes.select("h").distinct(), directory(sizes, limit)).select("h", "shard")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("row"), id_hash().alias("h"))
    rows.join(of, "h").select("row.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard, as ``shards`` has it.

    Null and empty texts count no bytes; a very long text above the limit is a shard that no bit can split, as are
    rows that share a doc_id, null or not. Equal ids have equal hashes, so there are no ties. Repeated rows get a
    row each. An empty table gives an empty table; further columns play no part.
    """
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_OP6 = """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
b AS (SELECT depth, h >> CAST(60 - depth AS INT) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS single
  FROM d, (SELECT unnest(generate_series(0, 40)) AS depth) GROUP BY ALL),
s AS (SELECT doc_id, n_bytes, b.depth, b.prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY b.depth) AS k
  FROM d JOIN b ON d.h >> CAST(60 - b.depth AS INT) = b.prefix WHERE shard_bytes <= 1048576 OR single)
SELECT doc_id, n_bytes, CAST(depth AS INT) AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard, shard_bytes, shard_docs FROM s WHERE k = 1
"""
