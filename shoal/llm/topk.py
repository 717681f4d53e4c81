"""Exact top-k by inner product with Fagin's threshold algorithm.

Rows are dealt into blocks, and a block's rows are sorted once: every dimension has a list of them by
that component. All queries are sent to each block and pass by its lists in a stream, so a task holds a
block and one batch of queries. A query walks all lists from the end its sign favours, in growing steps,
scores each row on first sight, and stops when the bound on unseen rows (the sum over dimensions of its
component times the list's current value) cannot beat its k-th score. The k best of each row block merge
into the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a block at most, and at least where there are more tasks than blocks; list entries read at first.
ROWS, FEWEST, STRIDE = 1 << 15, 1 << 11, 64
SCALE = 1024


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with v = floor(scale * component) as integers; without vectors that are null, or hold a null or non-finite component."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def threshold_search(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, own: int, k: int, stride: int = STRIDE) -> np.ndarray:
    """Row numbers of the k best for ``q`` among ``rows`` (ids ascending, so that the smaller number wins ties); ``order``: each dimension's rows, ascending.

    The lists are read in steps that double, so a query reads at most twice as deep as it must.
    """
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    n = len(rows)
    seen = ids == own  # the query's own row takes no part
    if not len(up) + len(down):  # every score is 0
        return np.flatnonzero(~seen)[:k]
    best, score = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    lo, hi = 0, min(n, stride)
    while True:
        met = np.zeros(n, bool)
        met[order[up, n - hi : n - lo]] = True
        met[order[down, lo:hi]] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        best, score = np.concatenate((best, new)), np.concatenate((score, rows[new] @ q))
        if len(best) > k:
            good = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            best, score = best[good], score[good]
        top = np.lexsort((best, -score))[:k]
        best, score = best[top], score[top]
        if hi == n:
            break
        bound = (q[up] * rows[order[up, n - hi], up]).sum() + (q[down] * rows[order[down, hi - 1], down]).sum()
        if len(best) == k and bound < score[-1]:  # a tie could still bring a smaller id
            break
        lo, hi = hi, min(n, 2 * hi)
    return best


class _Block:
    """A block's rows in ascending order of id, and for each dimension their numbers in ascending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.most = self.rows.shape[1] * max(1, int(np.abs(self.rows).max(initial=0)))
        self.floats = self.rows.astype(np.float64)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        small = self.most * max(1, int(np.abs(q).max(initial=0))) < 1 << 53  # whole numbers this small stay exact
        rows, q = (self.floats, q.astype(np.float64)) if small else (self.rows, q)
        best = threshold_search(q, rows, self.ids, self.order, own, k)
        return self.ids[best], (rows[best] @ q).astype(np.int64)


def _search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by block, dimensions and asking: a block's rows first, then the queries."""
    at, ids, rows, block = None, [], [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
        id_, (v, of) = batch.column(3).to_numpy(), (batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy())
        begin = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if batch.num_rows else ()
        found: list[tuple] = []
        for a, b in zip(begin, np.append(begin[1:], batch.num_rows)):
            own, dim, asking = key[:, a].tolist()
            if at != (own, dim):
                at, ids, rows, block = (own, dim), [], [], None
            values = v[of[a] - of[0] : of[b] - of[0]].reshape(b - a, dim).astype(np.int64)
            if not asking:
                ids.append(id_[a:b])
                rows.append(values)
            elif ids:
                block = block or _Block(np.concatenate(ids), np.concatenate(rows))
                rows = []
                for q, x in zip(id_[a:b].tolist(), values):
                    best, score = block.search(q, x, k)
                    found.append((np.full(len(best), q), best, score))
        cols = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        yield pa.record_batch([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query over ``rows``, ties to the smaller id.

    Both tables are ``(id, v)`` as ``quantized`` gives them; a row with the query's id is not its
    candidate. Repeated ids among the rows are candidates each; repeated queries count once. Vectors of
    another length than the query's are no candidates. Fewer than k candidates give fewer rows, an empty
    table none. A row with a null id takes no part; further columns play none.
    """
    spark = rows.sparkSession
    queries, rows = (x.where("id IS NOT NULL").select("id", "v", F.size("v").alias("dim")) for x in (queries, rows))
    queries = queries.dropDuplicates(["id"])
    n, parts = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(parts, n // FEWEST), -(-n // ROWS))
    sent = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "dim", F.lit(0).alias("asking"), "id", "v")
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dim", F.lit(1).alias("asking"), "id", "v")
    dealt = sent.unionByName(every).repartitionById(blocks, "block").sortWithinPartitions("block", "dim", "asking")
    found = dealt.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; candidates: every other row.

    Vectors that are null, or hold a null or non-finite component, and rows without a vec_id take no part; empty
    vectors score 0 with each other. Ties go to the smaller vec_id. Rows that share a vec_id are candidates
    each, as a query they count once, and they are no candidates of that query. An empty table gives none.
    """
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where("id % 100 = 0"), rows)


ORACLE_OP1 = """
WITH e AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e WHERE vec_id % 100 = 0),
r AS (SELECT vec_id AS id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e),
s AS (SELECT q.id AS query_id, r.id AS vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score FROM q JOIN r USING (k) WHERE q.id <> r.id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
