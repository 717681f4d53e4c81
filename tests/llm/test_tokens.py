"""Tokenizing, Huffman files and packing: against the library, by round trip, and by what packing must keep."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoal.llm import huffman, packing, tokens
from shoal.shared import fresh_path
from shoal.llm.text import chunks

FILES = [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)]


def reference(name: str, texts: list[str | None], end: int) -> list[list[int]]:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [x.ids + [end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,end", FILES)
@pytest.mark.parametrize("kept", [1 << 20, 300])
def test_encoder_equals_the_library(name, end, kept, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", kept)
    rng = random.Random(3)
    signs = ["a", "B", "é", "É", "×", " ", "  ", "\n", "\t", "'", "'s", ".", ",", "1", "23", "日", "“", " ", "́", "ll", "'ll", "x", "\r", "!", "_", "ß", "İ", "　", " ", "\x1c", "<|endoftext|>"]
    texts = [None, "", " ", "\n\n", "a", "It's  fine's", "x" * 5000] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    enc = tokens.Encoder(public_tokenizers.path(name), end)
    for _ in range(2):
        got: list[list[int]] = []
        for c in chunks([pa.record_batch([pa.array(texts)], ["text"])], limit=4000):
            ids, count = enc.encode(c)
            got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
        assert got == reference(name, texts, end)


@pytest.mark.parametrize("name,end", FILES)
def test_added_tokens_in_texts(name, end):
    """The operators' encoder keeps the library's default: an added token's string is that token."""
    library = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["end <|endoftext|> go", "plain words", "<|endoftext|>", "a<|startoftext|>b  c", "<|ENDOFTEXT|> <|endof text|>", None, "x<|endoftext|><|endoftext|>\n", "the end"]
    ids, count = tokens.encoder(public_tokenizers.path(name), end).encode(next(chunks([pa.record_batch([pa.array(texts)], ["text"])])))
    got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [library.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 200):
        counts = rng.integers(1, 1000, n) ** 2
        length = huffman.code_lengths(counts, 40)
        assert (2.0 ** -length).sum() == 1
        heap = sorted(counts.tolist())  # the cost of an unlimited Huffman code
        cost = 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert int((length * counts).sum()) == cost
    steep = np.array([1 << k for k in range(40)], dtype=object).astype(float)
    assert huffman.code_lengths(steep, 8).max() == 8
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 900) if n else np.zeros(0, np.int64)
        length = huffman.code_lengths(np.bincount(ids, minlength=901))
        codes = huffman.canonical_codes(length)
        offsets, bits = huffman.encode_block(ids, codes, length)
        assert huffman.decode_block(n, offsets, bits, huffman.decode_table(length)).tolist() == ids.tolist()


def test_files_round_trip(spark, docs, clashing, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Counter((i, tuple(x)) for (i, _), x in zip(rows, reference("byte_bpe_50k.json", [t for _, t in rows], 0)))
    for table, block in ((docs, huffman.BLOCK), (clashing, 5000)):  # one block a file, or several
        huffman.write_ids(table, path, 0, to := fresh_path(spark, "test"), block=block)
        assert (spark.read.parquet(f"{to}/blocks").where("block > 0").count() > 0) == (block == 5000)
        got = huffman.read_ids(spark, to).orderBy("start").collect()
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) // 4
            at += r.n_tokens
        order = [r.doc_id for r in got if r.doc_id is not None]
        assert order == sorted(order)
    huffman.write_ids(empty, path, 0, to := fresh_path(spark, "test"))
    assert huffman.read_ids(spark, to).count() == 0


def test_packing_keeps_every_id(docs, clashing, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Counter(tuple(x) for x in reference("word_bpe_49k.json", [t for _, t in rows], 1))
    for table, size in ((docs, 2048), (clashing, 256)):
        got = packing.pack(table, path, 1, size).collect()
        of = defaultdict(list)
        for r in got:
            of[r.sequence_id].append(r)
        padding = 0
        for own in of.values():
            own.sort(key=lambda r: r.offset)
            at = 0
            for r in own:
                assert r.offset == at and len(r.ids) == 4 * r.length > 0
                at += r.length
            assert at <= size
            padding += 0 if at & (at - 1) == 0 else size - at
        assert padding == 0
        # pieces of equal documents can't be told apart by id, so all ids of a doc_id are counted together
        ids, expect = defaultdict(Counter), defaultdict(Counter)
        for r in got:
            ids[r.doc_id].update(np.frombuffer(r.ids, "<u4").tolist())
        for (i, _), x in zip(rows, reference("word_bpe_49k.json", [t for _, t in rows], 1)):
            expect[i].update(x)
        assert ids == expect
        once = [i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None]
        by = {i: sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id == i) for i in once}
        assert all(tuple(x for _, p in by[i] for x in p) in want for i in once)
    assert packing.pack(empty, path, 1).count() == 0


def test_least_squares_meets_a_histogram_that_fits():
    count = np.zeros(101, np.int64)
    count[[60, 40, 30, 70, 20, 10]] = [50, 50, 40, 40, 30, 30]
    rows, times = packing.plan(count[:100], 100)
    used = np.bincount(rows.ravel(), np.repeat(times, 4), minlength=100)
    assert (rows.sum(axis=1) == 100).all() and (used[1:] <= count[1:100]).all()
    assert times.sum() >= 90


def test_group_packing_leaves_only_powers_of_two():
    rng = random.Random(5)
    for n in (1, 2, 50, 400):
        length = [rng.randint(1, 2047) for _ in range(n)]
        out = packing.pack_group(list(range(n)), [0] * n, length, 2048)
        total, cover = Counter(), defaultdict(int)
        for rid, start, m, seq, offset in sorted(out, key=lambda r: (r[3], r[4])):
            assert offset == total[seq]
            total[seq] += m
            cover[rid] += m
        assert [cover[k] for k in range(n)] == length
        assert all(t == 2048 or t & (t - 1) == 0 for t in total.values())


def test_rows_of_one_id_are_several_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for value in ("CAST(NULL AS LONG)", "7L"):
        rows = spark.range(400).selectExpr(f"{value} AS doc_id", "concat('text ', id) AS text")
        huffman.write_ids(rows, path, 0, to := fresh_path(spark, "test"))
        sizes = [r.n for r in spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum(F.size("sizes")).alias("n")).collect()]
        assert sum(sizes) == 400 and len(sizes) == 4 and max(sizes) < 200
        assert huffman.read_ids(spark, to).count() == 400
