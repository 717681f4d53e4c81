"""How the sources of a language differ in their terms, from run-length columns of counts.

Terms are counted in tasks and summed by Spark. A language's kept vocabulary is put into an order that
clusters equal counts: by the counts in its eight largest sources, then by a hash of all counts, so terms
that occur alike everywhere lie side by side. The order is cut into segments, and in each segment every
group's column of counts is run-length encoded. Two groups meet by their runs: the boundaries of both
are intersected, and the term of the divergence is computed once a run and multiplied by its length. Any
order gives the same sums; a good one makes the runs long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop, written
from .text import FOLD, Chunk, chunks

LEAST_DOCS, TOP = 10, 10
#: Probabilities are whole numbers of this part.
SCALE = 1_000_000_000
#: Terms a segment, groups a block, counts that a task holds, sources whose counts order the vocabulary.
SEGMENT, BLOCK, HELD, LEADING = 1 << 14, 32, 1 << 18, 8

#: ``[\x00-\x40\x5B-\x60\x7B-\x7F]``: what separates terms.
BREAK = np.ones(256, bool)
BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

COUNTS = "lang string, source string, term string, n long, docs long"
_HELD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _chunk_counts(c: Chunk) -> pa.Table:
    """Occurrences and documents of each term a (lang, source), and the group's documents under a null term."""
    names: dict[tuple[str, str], int] = {}
    group = np.array([names.setdefault(k, len(names)) for k in zip(c.column("lang").to_pylist(), c.column("source").to_pylist())], np.int64)
    first, last, of = c.words(BREAK)
    body = FOLD[c.buf[:-8]]
    letters = body[~BREAK[body]]  # terms end to end
    ends = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    size = max(1, len(terms.dictionary))
    doc = np.repeat(np.arange(c.n), np.diff(of))
    key, n = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)  # a document's terms
    key, at = np.unique(group[key // size] * size + key % size, return_inverse=True)
    g, code = np.concatenate((key // size, np.arange(len(names)))), key % size
    label = pa.chunked_array([terms.dictionary.take(pa.array(code)), pa.nulls(len(names), pa.string())])
    lang, source = (pa.array([k[x] for k in names], pa.string()).take(pa.array(g)) for x in (0, 1))
    count = np.concatenate((np.bincount(at, n, len(key)).astype(np.int64), np.zeros(len(names), np.int64)))
    docs = np.concatenate((np.bincount(at, minlength=len(key)), np.bincount(group, minlength=len(names))))
    return pa.table([lang, source, label, pa.array(count), pa.array(docs)], schema=_HELD)


def _summed(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_HELD.names)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for c in chunks(batches):
        held.append(_chunk_counts(c))
        rows += held[-1].num_rows
        if rows > HELD:
            held = [_summed(held)]
            rows = held[0].num_rows
            if 2 * rows > HELD:  # more distinct terms than a task holds: Spark sums the rest
                yield from held[0].combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from _summed(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term a group; a null term counts the group's documents."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _smoothed(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in decimals: counts may be of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + F.lit(2)), wide(total) + F.lit(2) * wide(terms))
    return F.when(terms > 0, share + 1)


def _placed(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in order get a segment and a place in it; a segment is of one language."""
    part, lang, n, segment = TaskContext.get().partitionId() << 32, None, 0, -1
    for batch in batches:
        segments, places = [], []
        for own in batch.column(0).to_pylist():
            if own != lang or n == size:
                lang, n, segment = own, 0, segment + 1
            segments.append(part + segment)
            places.append(n)
            n += 1
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(segments, pa.int64()), pa.array(places, pa.int32())], ["lang", "term", "total", "segment", "place"])


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS, segment: int = SEGMENT) -> DataFrame:
    """``(lang, term, total, segment, place)`` of kept terms of ``counts(lang, source, no, term, n, docs)``, equal counts clustered."""
    leading = [F.sum(F.when(F.col("no") == k, F.col("n"))).alias(f"c{k}") for k in range(LEADING)]
    alike = F.bit_xor(F.xxhash64("no", "n")).alias("alike")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), *leading, alike).where(F.col("docs") >= least_docs)
    kept, made = written(kept, "kept-terms")
    order = ["lang", *(f"c{k}" for k in range(LEADING)), "alike", "term"]
    parts = max(1, kept.count() // segment)
    placed = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("lang", "term", "total").mapInArrow(lambda it: _placed(it, segment), "lang string, term string, total long, segment long, place int")
    placed, _ = written(placed, "vocabulary")
    drop(counts.sparkSession, made)
    return placed


def runs(places: np.ndarray, values: np.ndarray, rest: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Run-length column of ``length`` places: ``values`` at ``places`` (ascending), ``rest`` elsewhere; starts and values of its runs."""
    column = np.full(length, rest, np.int64)
    column[places] = values
    start = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
    return start, column[start]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of floor((p - q)^2 / (p + q)) over two columns: once a run between the boundaries of both."""
    start = np.union1d(a[0], b[0])
    p, q = (values[np.searchsorted(begin, start, "right") - 1] for begin, values in (a, b))
    return int(((p - q) ** 2 // (p + q) * np.diff(np.append(start, length))).sum())


_COLUMNS = "lang string, segment long, no int, length int, starts array<int>, values array<long>"


def _encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, values = [], []
        for rest, length, places, own in zip(*(batch.column(c).to_pylist() for c in ("rest", "length", "places", "shares"))):
            at, value = runs(np.array(places or [], np.int64), np.array(own or [], np.int64), rest, length)
            starts.append(at.astype(np.int32))
            values.append(value)
        yield pa.record_batch([*(batch.column(c) for c in ("lang", "segment", "no", "length")), pa.array(starts, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], ["lang", "segment", "no", "length", "starts", "values"])


def run_columns(kept: DataFrame, groups: DataFrame, segments: DataFrame) -> DataFrame:
    """``(lang, segment, no, length, starts, values)``: every group's column in every segment of its language, as runs of shares.

    ``kept(lang, segment, no, place, share)`` has what isn't ``groups(lang, no, rest)``'s own share of a term
    that it lacks.
    """
    lists = kept.groupBy("lang", "segment", "no").agg(F.array_sort(F.collect_list(F.struct("place", "share"))).alias("l"))  # a segment's places at most
    every = groups.join(segments, "lang").join(lists, ["lang", "segment", "no"], "left")
    return every.select("lang", "segment", "no", "length", "rest", F.col("l.place").alias("places"), F.col("l.share").alias("shares")).mapInArrow(_encoded, _COLUMNS)


def _block_pairs(table: pa.Table, block: int) -> pa.Table:
    """Sums of all pairs of two blocks of groups in a segment."""
    low, high = (table.column(c)[0].as_py() if table.num_rows else 0 for c in ("low", "high"))
    no = table.column("no").to_pylist()
    length = table.column("length")[0].as_py() if table.num_rows else 0
    columns = {k: (np.array(s, np.int64), np.array(v, np.int64)) for k, s, v in zip(no, table.column("starts").to_pylist(), table.column("values").to_pylist())}
    mine = sorted(k for k in columns if k // block == low)
    theirs = sorted(k for k in columns if k // block == high)
    found = [(a, b, divergence(columns[a], columns[b], length)) for a in mine for b in theirs if a < b]
    lang = [table.column("lang")[0].as_py()] * len(found)
    return pa.table([pa.array(lang, pa.string()), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64())))], ["lang", "a", "b", "value"])


def pair_sums(columns: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(lang, a, b, value)`` for groups a < b of a language, from their run-length columns.

    A task gets one segment of two blocks of groups, so its memory doesn't grow with vocabulary or groups.
    """
    blocks = groups.groupBy("lang").agg(F.floor(F.max("no") / block).cast("int").alias("last"))
    own, other = F.floor(F.col("no") / block).cast("int"), F.col("other")
    dealt = columns.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("lang", "segment", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "no", "length", "starts", "values")
    parts = dealt.groupBy("lang", "segment", "low", "high").applyInArrow(lambda t: _block_pairs(t, block), "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from the others of its language, and its own terms.

    Part ``pair`` has a row for each other source, part ``term`` the ``top`` kept terms that are likelier in
    the source than in the language. Null texts, languages and sources are empty ones, and an empty
    language or source is a name as any other. A source without a kept term counts with equal shares; a
    language without kept terms has pairs of value 0 and no terms. Very long texts are counted chunk by
    chunk with the rest of their task. Repeated rows count each. Ties go to the smaller item by UTF-8 bytes. An
    empty table gives an empty table; further columns play no part.
    """
    counts, _ = written(term_counts(docs), "term-counts")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), "source")) - 1  # a row a source
    named, _ = written(counts.where("term IS NULL").select("lang", "source", order.alias("no")), "groups")
    own = counts.where("term IS NOT NULL").join(named, ["lang", "source"])
    placed = vocabulary(own, least_docs, segment)
    kept, _ = written(own.drop("docs").join(placed, ["lang", "term"]), "kept-counts")
    terms = placed.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = kept.groupBy("lang", "no").agg(F.sum("n").alias("size"))
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("whole"))
    sized = named.join(sizes, ["lang", "no"], "left").join(terms, "lang", "left").join(whole, "lang", "left").na.fill(0, ["size", "terms", "whole"])
    groups, _ = written(sized.withColumn("rest", _smoothed(F.lit(0), F.col("size"), F.col("terms"))), "sized-groups")
    shares, _ = written(kept.join(groups.drop("source"), ["lang", "no"]).withColumn("share", _smoothed(F.col("n"), F.col("size"), F.col("terms"))), "shares")

    p, q = F.col("share"), F.col("q")
    likelier = shares.withColumn("q", _smoothed(F.col("total"), F.col("whole"), F.col("terms"))).where(p > q)
    value = F.call_function("div", (p - q) * (p - q), p + q)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own_terms = likelier.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    own_terms = own_terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    segments = placed.groupBy("lang", "segment").agg(F.count("*").cast("int").alias("length"))
    columns, _ = written(run_columns(shares.select("lang", "segment", "no", "place", "share"), groups.where("terms > 0").select("lang", "no", "rest"), segments), "run-columns")
    sums = pair_sums(columns, groups.select("lang", "no"), block)
    a, b = (groups.select("lang", F.col("no").alias(x), F.col("source").alias(s)) for x, s in (("a", "source"), ("b", "item")))
    both = a.join(b, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    each = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = both.select("lang", each.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(own_terms)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty and very long texts, ties, repeated rows and empty tables as ``audit`` has them."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.total FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS size, sum(total) AS whole, count(*) AS terms FROM e GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (size + 2 * terms) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (whole + 2 * terms) AS q FROM e JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
