"""Token counts against the libraries, and the cache's own work."""

from __future__ import annotations

from functools import cache

import public_tokenizers
import pytest
import sentencepiece
from llm_corpus import SCHEMA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoal.llm import token_counts
from shoal.shared import fresh_path

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@cache
def loaded(path):
    if path.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=path)
    return Tokenizer.from_file(path)


def library(path, text):
    return len(loaded(path).encode(text)) if path.endswith(".model") else len(loaded(path).encode(text, add_special_tokens=False).ids)


SPECIAL = [(900, "end <|endoftext|> go"), (901, "END <|EndOfText|> GO"), (902, "end <|endoftext|> go"), (903, "İstanbul ÀÉ Ǆ K"), (904, "<s> a </s>")]


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_counts_are_the_librarys(spark, docs, rows, path):
    every = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in SPECIAL], SCHEMA))
    got = token_counts.count_tokens(every.withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit(1)), path, fresh_path(spark, "cache"))
    want = sorted(((i, len((t or "").encode()), library(path, t or "")) for i, t in [*rows, *SPECIAL]), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_only_distinct_misses_are_encoded(spark, docs, rows, monkeypatch):
    at = fresh_path(spark, "cache")
    distinct = len({t or "" for _, t in rows})
    found = []
    plain = token_counts.fill_cache
    monkeypatch.setattr(token_counts, "fill_cache", lambda *a: found.append(plain(*a)) or found[-1])
    first = sorted(map(tuple, token_counts.count_tokens(docs, BYTE, at).collect()), key=repr)
    held = token_counts.cached(spark, at, BYTE)
    assert held.count() == held.select("digest").distinct().count() == distinct
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTE, at).collect()), key=repr) == first
    new = spark.createDataFrame([(1, rows[3][1]), (2, "never seen"), (3, "never seen"), (4, None), (5, "nor this")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(new, BYTE, at).collect()} == {1: library(BYTE, rows[3][1]), 2: library(BYTE, "never seen"), 3: library(BYTE, "never seen"), 4: 0, 5: library(BYTE, "nor this")}
    assert found == [distinct, 0, 2]
    assert token_counts.cached(spark, at, BYTE).count() == distinct + 2
    assert token_counts.cached(spark, at, WORD).count() == 0  # another version, another cache


def test_a_folding_tokenizer_shares_counts_over_case(spark):
    at = fresh_path(spark, "cache")
    docs = spark.createDataFrame([(1, "Some Words"), (2, "some words"), (3, "SOME WORDS")], "doc_id long, text string")
    assert {r.n_tokens for r in token_counts.count_tokens(docs, WORD, at).collect()} == {library(WORD, "some words")}
    assert token_counts.cached(spark, at, WORD).count() == 1


def test_empty_table(spark, empty):
    at = fresh_path(spark, "cache")
    assert token_counts.count_tokens(empty, BYTE, at).count() == 0
    assert token_counts.cached(spark, at, BYTE).count() == 0


def test_query(spark):
    import duckdb
    from shoal.llm.queries import QUERIES

    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    for i, t in duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        n = library(BYTE, t)
        assert got.pop(i) == (len(t.encode()), n, n > 512)
    assert not got
