"""All pairs of 64-bit hashes within a Hamming distance, exactly, by keys that follow the data.

The 64 bits are dealt to four bands of sixteen so that each band tells a sample's hashes apart as well as it
can: bits that hardly change, or that change together, don't end up in one band. Two hashes within ``d``
bits differ in at most d // 4 of some band, so probes with every such mask meet the other side by equality. A key that
very many hashes have is keyed again by another band: what is left of the distance allows d' // 3 bits in one of the
other three, and so on, until the rest of the hash has few values. Every pair is found by some key, and each
is verified.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

BANDS, WIDTH, SAMPLE = 4, 16, 4096
#: Hashes of a key, by how many bands it fixes, above which it is keyed again: about what the next band's probes cost.
CROWDED = {1: 4096, 2: 32768}
_LOW = (1 << WIDTH) - 1


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_order(sample: np.ndarray) -> list[int]:
    """Which bit comes to each place: bands take turns, each takes the bit after which its keys collide least in the sample."""
    left, bands = list(range(64)), [[] for _ in range(BANDS)]
    bits = ((sample[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.int64)
    keys = [np.zeros(len(sample), np.int64) for _ in range(BANDS)]
    for turn in range(64):
        k = turn % BANDS
        collide = []
        for b in left:
            _, n = np.unique(keys[k] * 2 + bits[b], return_counts=True)
            collide.append(int((n * n).sum()))
        best = left.pop(int(np.argmin(collide)))
        bands[k].append(best)
        keys[k] = np.unique(keys[k] * 2 + bits[best], return_inverse=True)[1]
    return [b for band in bands for b in band]


def _permuted(h: Column, order: list[int]) -> Column:
    """The hash with bit ``order[k]`` at place k; equal places stay one shift and one mask."""
    moves: dict[int, int] = {}
    for to, at in enumerate(order):
        moves[to - at] = moves.get(to - at, 0) | 1 << at
    out = F.lit(0).cast("long")
    for by, mask in moves.items():
        part = h.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        out = out.bitwiseOR(F.shiftleft(part, by) if by > 0 else F.shiftrightunsigned(part, -by) if by < 0 else part)
    return out


def _masks(spark, most: int) -> DataFrame:
    """``(r, mask, bits)``: for each radius up to ``most`` all masks of a band with at most so many bits."""
    rows = [(r, m, m.bit_count()) for r in range(most + 1) for m in range(1 << WIDTH) if m.bit_count() <= r]
    return spark.createDataFrame(rows, "r int, mask long, bits int")


def _shifted(value: Column, band: Column) -> Column:
    return F.call_function("shiftleft", value, (band * WIDTH).cast("int"))


def _part(value: Column, band: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (band * WIDTH).cast("int")).bitwiseAND(F.lit(_LOW))


def candidates(hashes: DataFrame, distance: int = 10, crowded: dict[int, int] | None = None) -> DataFrame:
    """``(a, b)``: pairs of ``hashes(hash)`` that share a key, every pair a < b within ``distance`` among them; not distinct.

    ``crowded`` gives the bound of a key's hashes by the number of bands that it fixes.
    """
    crowded = CROWDED if crowded is None else crowded
    spark = hashes.sparkSession
    n = hashes.count()
    some = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))).limit(2 * SAMPLE).collect()
    order = bit_order(np.array([r.hash for r in some], np.int64).view(np.uint64)) if some else list(range(64))
    p = _permuted(F.col("hash"), order)
    zero = F.lit(0).cast("long")
    start = hashes.select("hash", p.alias("p"), F.lit(0).alias("used"), zero.alias("fixed"))
    index, probes, out = start, start.withColumn("e", F.lit(0)), []
    for level in range(1, BANDS):
        free = BANDS - level + 1
        band = F.explode(F.filter(F.array(*map(F.lit, range(BANDS))), lambda k: F.call_function("shiftright", F.col("used"), k).bitwiseAND(F.lit(1)) == 0))
        now = F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("band")))
        held = index.withColumn("band", band).select("hash", "p", now.alias("used"), F.col("fixed").bitwiseOR(_shifted(_part(F.col("p"), F.col("band")), F.col("band"))).alias("fixed"))
        masks = F.broadcast(_masks(spark, distance // free))  # at most 10 000 rows
        asks = probes.withColumn("band", band).withColumn("r", F.floor((F.lit(distance) - F.col("e")) / free).cast("int")).join(masks, "r")
        value = _part(F.col("p"), F.col("band")).bitwiseXOR(F.col("mask"))
        asks = asks.select("hash", "p", now.alias("used"), F.col("fixed").bitwiseOR(_shifted(value, F.col("band"))).alias("fixed"), (F.col("e") + F.col("bits")).alias("e"))
        key = ["used", "fixed"]
        bound = crowded.get(level)
        last = bound is None
        if not last:
            many, _ = written(held.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > bound).select(*key), "crowded")
            last = many.isEmpty()
        met_asks, met_held = asks, held
        if not last:
            met_asks, met_held = asks.join(many, key, "left_anti"), held.join(many, key, "left_anti")
        out.append(met_asks.select(*key, F.col("hash").alias("a")).join(met_held.select(*key, F.col("hash").alias("b")), key).where("a < b").select("a", "b"))
        if last:
            break
        index, _ = written(held.join(many, key, "left_semi"), "index")
        probes, _ = written(asks.join(many, key, "left_semi"), "probes")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def hash_pairs(hashes: DataFrame, distance: int = 10, crowded: dict[int, int] | None = None) -> DataFrame:
    """``(a, b, distance)`` of distinct hashes a < b of ``hashes(hash)`` that differ in at most ``distance`` (up to 11) bits; null hashes have no pair."""
    if not 0 <= distance <= 11:
        raise ValueError("masks are made for up to 11 differing bits")
    one, _ = written(hashes.where("hash IS NOT NULL").select("hash").distinct(), "hashes")
    d = hamming(F.col("a"), F.col("b"))
    return candidates(one, distance, crowded).where(d <= distance).select("a", "b", d.alias("distance")).distinct()
