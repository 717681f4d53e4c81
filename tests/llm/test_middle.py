"""Fill-in-middle against plain Python, at several frame sizes."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from llm_corpus import SCHEMA
from pyspark.sql import functions as F

from shoal.llm import middle
from shoal.llm.queries import ORACLE_SQL, QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc, text):
    """The row that the contract asks for, and the output."""
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = sha(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc, len(units), "plain", None, None, sha(text), sha(text)), text
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc, len(units), form, len(p), len(m), sha(out), sha(text)), out


def hard(seed=3):
    """Texts at the edges of frames and marks."""
    rng = random.Random(seed)
    some = ["é", "日本", "a", "<", ">", "<S", "S>", "P>", "\n", " ", "\t \x0b", "𝄞", "word"]
    rows = [(1000 + k, "".join(rng.choice(some) for _ in range(rng.randint(0, 300)))) for k in range(150)]
    return [*rows, (2001, "x<P>y"), (2002, "<M>"), (2003, " <"), (2004, "< <<S" * 40), (2005, "\n" * 500), (2006, "a" * 999 + "é" * 999), (None, "no id"), (None, "")]


@pytest.mark.parametrize("size", [4, 64, 1 << 16])
def test_outputs_and_texts_again(spark, docs, rows, size):
    own = hard()[:60] if size == 4 else hard()
    every = own if size == 4 else [*rows, *own]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in own], SCHEMA)
    frames = middle.framed(table if size == 4 else docs.unionByName(table), size).cache()
    assert size > 64 or max(len(r.frames) for r in frames.collect()) > 10
    outputs = middle.fill_in_middle(frames, size=size)
    want = sorted((plain(i, t) for i, t in every), key=repr)
    got = sorted(((tuple(r)[:6], r.text) for r in middle.as_text(outputs).collect()), key=repr)
    assert got == [(row[:6], out) for row, out in want]
    back = middle.as_text(middle.restored(outputs, size)).collect()
    assert sorted(((r.doc_id, r.text, r.sha256) for r in back), key=repr) == sorted(((i, t or "", sha(t or "")) for i, t in every), key=repr)
    assert sorted({row[2] for row, _ in want}) == ["plain", "psm", "spm"]


def test_a_cut_reads_one_frame():
    text = b"one two three four five six seven eight nine ten"
    frames = [text[k : k + 8] for k in range(0, len(text), 8)]
    ends = [min(k + 8, len(text)) for k in range(0, len(text), 8)]
    units = [len([m for m in UNIT.finditer(text.decode()) if m.end() <= e]) for e in ends]
    held = middle.Seekable(ends, [middle.Framing._writer.compress(x) for x in frames])
    read = []
    plain_frame = held.frame
    held.frame = lambda k: read.append(k) or plain_frame(k)
    for unit in range(11):
        read.clear()
        at, chars = middle._cut(held, units, ends, 10, unit)
        assert text[:at].decode() == "".join(UNIT.findall(text.decode())[:unit]) and chars == at
        assert len(set(read)) <= 1


def test_clashing_columns_and_empty_table(spark, clashing, empty):
    names = ["n", "form", "first", "second", "frames", "units", "bytes"]
    rows = middle.fill_in_middle(middle.framed(clashing.withColumns({c: F.lit("clash") for c in names})))
    assert rows.count() == clashing.count()
    assert middle.fill_in_middle(middle.framed(empty)).count() == 0


def test_query_and_its_sql(spark):
    got = QUERIES["op11_fill_in_middle"](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op11_fill_in_middle"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(want.columns).collect()))
    assert rows == sorted(want.fetchall())
    texts = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert rows == sorted(plain(i, t)[0] for i, t in texts)
