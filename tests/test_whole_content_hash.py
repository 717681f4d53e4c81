"""Content hashes of all documents, and of heads."""

from __future__ import annotations

import hashlib

from paths import SF
from pyspark.sql import functions as F

from shoal.queries import QUERIES
from shoal.sources.files import content_hash


def test_content_hash_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.sha for r in QUERIES["content_hash_all"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_head_of_unreadable_content(spark):
    rows = [(b"\xff" * 70_000, True), (b"\xff" * 70_000, False), (b"\x00\x80", False)]
    got = [r.h for r in spark.createDataFrame(rows, "c binary, ok boolean").select(content_hash(F.col("c"), F.col("ok")).alias("h")).collect()]
    assert got == [hashlib.sha256(c if ok else c[:65536]).hexdigest() for c, ok in rows]
