"""Queries without SQL against plain Python over the same tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import xxhash
from paths import SF

from shoal.queries import QUERIES
from shoal.sources.views import VIEWS


def plain(view):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    return con.sql(f"SELECT id FROM ({VIEWS[view]}) WHERE NOT is_deleted AND NOT is_missing").fetchall()


def test_media_scan(spark):
    want = sorted((f.name, f.stat().st_size) for f in Path(SF).rglob("*.parquet"))
    assert sorted(map(tuple, QUERIES["media_scan"](spark, SF).collect())) == want


def test_random_sample(spark):
    def order(i):
        first = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), first)
        return (h - (1 << 64) if h >> 63 else h, i)

    want = sorted((i for (i,) in plain("assets")), key=order)[:100]
    assert [r.id for r in QUERIES["random_sample"](spark, SF).collect()] == want


def test_vector_checksums(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = {i: hashlib.sha256(np.array(v, "<f4").tobytes()).hexdigest() if v is not None else None for i, v in rows}
    got = QUERIES["vector_checksum"](spark, SF)
    assert {r[0]: r[1] for r in got.collect()} == want


def test_streamed_index(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    gone = {i for (i,) in con.sql(f"SELECT id FROM ({VIEWS['assets']}) WHERE is_deleted").fetchall()}
    want = {}
    for i, v in rows:
        if i in gone:
            continue
        if i % 10 == 0:
            want[i] = ("failed", None, None)
            continue
        five = np.array(v[:5], np.float64)
        share = np.exp(five - five.max()) / np.exp(five - five.max()).sum()
        want[i] = ("ready", hashlib.sha256(np.array(v, "<f4").tobytes()).hexdigest(), int(share.argmax()))
    got = QUERIES["stream_index"](spark, SF).collect()
    assert {r.image_id: (r.state, r.checksum, r.label) for r in got} == want and len(got) == len(want)
