"""Similarity joins: perceptual hashes, vectors, identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalized
from ..shared import kept
from ..sources.views import query
from .hamming import hamming, hash_pairs
from .metric import _vectors, cosine_radius, in_balls

#: Rows and queries of one block of a vector search.
ROWS, QUERIES = 8192, 1024
#: Scores that a task holds at once.
SCORES = 1 << 19


def hash_neighbours(hashes: DataFrame, wanted: int, distance: int = 10) -> DataFrame:
    """``(id, score)`` of rows whose 64-bit hash differs from ``wanted`` in at most ``distance`` bits: one scan."""
    d = hamming(F.col("hash"), F.lit(wanted))
    return hashes.where(d <= distance).select("id", (1 - d / 64).alias("score"))


def in_blocks(queries: DataFrame, rows: DataFrame, found, schema: str) -> DataFrame:
    """Apply ``found(queries, rows)`` to every pair of a block of ``queries(id, v)`` and a block of ``rows(id, v)``.

    Neither side is broadcast or gathered whole; blocks keep a task's memory bounded, and their number
    follows counted rows.
    """
    n, m = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    to = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    rows = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("rb"), to(query_blocks).alias("qb"))
    queries = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"), to(row_blocks).alias("rb"))
    return queries.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(found, schema)


def _best(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a block by cosine, ties to the smaller id; only vectors of one length compare."""
    out, length, lengths = [], q["v"].map(len), r["v"].map(len)
    for n in np.intersect1d(length.unique(), lengths.unique()):
        same = q[length == n]
        near = r[lengths == n].sort_values("id", kind="stable")
        out.append(_best_of_one_length(same, near, k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` highest scores, highest first, ties to the earlier place."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k]
    out = np.empty((len(scores), k), np.int64)
    for own, (s, low) in enumerate(zip(scores, least)):
        at = np.flatnonzero(s >= low)
        out[own] = at[np.argsort(-s[at], kind="stable")[:k]]
    return out


def _best_of_one_length(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(q) and len(r):
        ids, asked, rows = r["id"].to_numpy(), np.stack(q["v"]), np.stack(r["v"]).T
        together = max(1, SCORES // len(ids))
        for start in range(0, len(q), together):
            scores, own = asked[start : start + together] @ rows, q["id"].to_numpy()[start : start + together]
            top = _top(scores, k + 1)
            query, found, score = np.repeat(own, top.shape[1]), ids[top].ravel(), np.take_along_axis(scores, top, axis=1).ravel()
            other = (found != query).reshape(top.shape)
            other &= np.cumsum(other, axis=1) <= k
            other = other.ravel()
            out.append(pd.DataFrame({"query_id": query[other], "id": found[other], "score": score[other]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def unit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), l2_normalized(F.col(vector_col)).alias("v"))


def knn_exact(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, id, score)``: the k nearest rows of each query by cosine, the query's own row left out."""
    return _ranked(in_blocks(queries, rows, lambda q, r: _best(q, r, k), "query_id long, id long, score double"), k)


def _centroids(rows: DataFrame, n: int, k: int, lists: int | None, recall: float, sample: int, seed: int = 0) -> tuple[np.ndarray, int]:
    """K-means of up to about ``sample`` rows, on the driver, and how many lists hold enough of the sample's true neighbours."""
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / n))
    x = np.stack([r.v for r in some.select("id", "v").orderBy("id").collect()])
    rng = np.random.default_rng(seed)
    lists = lists or max(1, min(int(n**0.5), sample // 40))
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(10):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    own = np.argmax(x @ c.T, axis=1)
    asked = rng.permutation(len(x))[:200]
    near = np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    at = np.take_along_axis(place, own[near], axis=1)[near != asked[:, None]]
    return c, int(np.quantile(at, recall, method="higher")) + 1 if len(at) else len(c)


def _near_lists(batches: Iterable[pa.RecordBatch], lists: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows with the numbers of their ``probes`` nearest lists; a piece has ``SCORES`` scores at most, however large its batch."""
    step = max(1, SCORES // len(lists))
    for batch in batches:
        for some in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
            scores = _vectors(some) @ lists.T
            near = np.argmax(scores, axis=1)[:, None] if probes == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.record_batch([some.column(0), some.column(1), pa.ListArray.from_arrays(ends, pa.array(near.astype(np.int32).ravel()))], ["id", "v", "lists"])


def knn_lists(queries: DataFrame, rows: DataFrame, k: int = 10, lists: int | None = None, recall: float = 0.95, sample: int = 20_000) -> DataFrame:
    """As ``knn_exact``, by lists: centroids of a bounded sample, every row in its nearest list, queries in their nearest ones.

    There are about sqrt(rows) lists (at most sample / 40). How many of them a query visits is the number that
    holds ``recall`` of the true neighbours of 200 sampled rows among the sample; at least nine of ten
    are then found over all rows (tests). A list is cut into parts of at most about ``ROWS`` rows, so a
    list that holds most of the rows is no larger task.
    """
    rows, queries = (kept(df.select("id", F.col("v").cast("array<double>").alias("v")), "vectors") for df in (rows, queries))  # they are read several times
    n = rows.count()
    if not n:
        return knn_exact(queries, rows, k)
    found_lists, probes = _centroids(rows, n, k, lists, recall, sample)
    sent = rows.sparkSession.sparkContext.broadcast(found_lists)  # at most sample / 40 vectors

    near = lambda df, some: df.mapInArrow(lambda it: _near_lists(it, sent.value, some), "id long, v array<double>, lists array<int>")
    held = near(rows, 1).select("id", "v", F.get("lists", F.lit(0)).alias("list"))
    parts = held.groupBy("list").agg(F.ceil(F.count("*") / ROWS).alias("parts"))  # a row a list
    held = held.join(F.broadcast(parts), "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    asked = near(queries, probes).select("id", "v", F.explode("lists").alias("list")).join(F.broadcast(parts), "list")
    asked = asked.select("id", "v", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // QUERIES)))).alias("qb"))
    blocks = asked.select(F.col("list").alias("l"), F.col("part").alias("p"), F.col("qb").alias("b")).distinct()
    held = held.join(blocks, (F.col("list") == F.col("l")) & (F.col("part") == F.col("p")))
    held = held.select(F.col("l").alias("list"), F.col("p").alias("part"), F.col("b").alias("qb"), F.col("id").alias("id"), F.col("v").alias("v"))
    found = asked.groupBy("list", "part", "qb").cogroup(held.groupBy("list", "part", "qb")).applyInPandas(lambda q, r: _best(q, r, k), "query_id long, id long, score double")
    return _ranked(found, k)


def centroids(references: DataFrame) -> DataFrame:
    """``(id, v)``: mean of the unit vectors of each identity, not normalised again."""
    parts = references.where("identity_id IS NOT NULL").select("identity_id", F.posexplode(l2_normalized(F.col("vector"))).alias("k", "x"))
    mean = parts.groupBy("identity_id", "k").agg(F.avg("x").alias("x"))
    lists = mean.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("l"))
    return lists.select(F.col("identity_id").cast("long").alias("id"), F.col("l.x").alias("v"))


def identity_match(detections: DataFrame, references: DataFrame, threshold: float = 0.178, mode: str = "best") -> DataFrame:
    """``(detection_id, identity_id, distance)`` of detections within ``threshold`` of an identity.

    The mean distance to an identity's unit vectors is one minus the product with their mean, and a mean of
    unit vectors is no longer than one, so detections meet the balls of means that they may match. ``best`` takes
    the smallest distance (ties to the smaller id), ``first`` the smallest id within the threshold.
    """
    asked = detections.where("vector IS NOT NULL").select("id", l2_normalized(F.col("vector")).alias("v"))

    def found(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"detection_id": [], "identity_id": [], "distance": []}).astype({"detection_id": "int64", "identity_id": "int64", "distance": "float64"})
        if not len(q) or not len(r):
            return empty
        r = r.sort_values("id")
        d = 1 - np.stack(q["v"]) @ np.stack(r["v"]).T
        at = np.argmin(d, axis=1) if mode == "best" else np.argmax(d <= threshold, axis=1)
        d = d[np.arange(len(q)), at]
        ok = d <= threshold
        return pd.DataFrame({"detection_id": q["id"].to_numpy()[ok], "identity_id": r["id"].to_numpy()[at][ok], "distance": d[ok]})

    near = in_balls(asked, centroids(references), cosine_radius(threshold), found, "detection_id long, identity_id long, distance double")
    order = F.struct("distance", "identity_id") if mode == "best" else F.struct("identity_id", "distance")
    return near.groupBy("detection_id").agg(F.min(order).alias("m")).select("detection_id", "m.identity_id", "m.distance")


def reidentified(detections: DataFrame, threshold: float = 0.178) -> DataFrame:
    """``(detection_id, identity_id)`` of all detections with a vector, null where no identity is near."""
    best = identity_match(detections, detections, threshold)
    return detections.where("vector IS NOT NULL").select(F.col("id").alias("detection_id")).join(best.select("detection_id", "identity_id"), "detection_id", "left")


PHASH = "SELECT o_orderkey AS id, xor(CAST('0x' || substr(md5(CAST(o_orderkey % 300 AS VARCHAR)), 1, 15) AS BIGINT), (CAST(1 AS BIGINT) << CAST(o_orderkey % 7 AS INT)) | (CAST(1 AS BIGINT) << CAST(o_custkey % 60 AS INT))) AS hash FROM orders"


def perceptual(t) -> DataFrame:
    """64-bit hashes of the fixture: 300 families whose members differ in a few bits."""
    family = F.conv(F.substring(F.md5((F.col("o_orderkey") % 300).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    flips = F.expr("shiftleft(1L, cast(o_orderkey % 7 as int)) | shiftleft(1L, cast(o_custkey % 60 as int))")
    return t.orders.select(F.col("o_orderkey").alias("id"), family.bitwiseXOR(flips).alias("hash"))


@query("phash_neighbors", f"WITH h AS ({PHASH}), q AS (SELECT hash FROM h ORDER BY id LIMIT 1) SELECT id, 1 - bit_count(xor(h.hash, q.hash)) / 64.0::DOUBLE AS score FROM h, q WHERE bit_count(xor(h.hash, q.hash)) <= 10")
def _phash_neighbors(t):
    h = perceptual(t)
    first = h.orderBy("id").first()
    return hash_neighbours(h, first.hash if first else 0)


PAIRS = f"WITH h AS (SELECT DISTINCT hash FROM ({PHASH})) SELECT x.hash AS a, y.hash AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INT) AS distance FROM h x JOIN h y ON x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 10"


@query("phash_pairs", PAIRS)
@query("phash_pairs_all", PAIRS)
def _phash_pairs(t):
    return hash_pairs(perceptual(t))


KNN = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.id AS query_id, r.id, list_cosine_similarity(q.v, r.v) AS score FROM e q JOIN e r ON q.id % 20 = 0 AND q.id <> r.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, id, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"""


@query("knn_exact", KNN)
def _knn_exact(t):
    rows = unit(t.embeddings)
    return knn_exact(rows.where("id % 20 = 0"), rows).select("query_id", "rank", "id", F.floor(F.col("score") * 1000000 + 0.5).alias("score"))


@query("knn_lsh")
def _knn_lsh(t):
    rows = unit(t.embeddings)
    return knn_lists(rows.where("id % 20 = 0"), rows)


@query("knn_lsh_recall", "SELECT count(*) AS asked, true AS reached FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def _knn_lsh_recall(t):
    """Whether nine of ten true neighbours are in what the lists find."""
    rows = unit(t.embeddings)
    asked = rows.where("id % 20 = 0")
    found = knn_lists(asked, rows).select("query_id", "id", F.lit(1).alias("hit"))
    both = knn_exact(asked, rows).select("query_id", "id").join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("asked"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


MATCH = """WITH n AS (SELECT id, identity_id, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN vector])) FOR x IN vector] AS v FROM detections),
p AS (SELECT id, identity_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM n), c AS (SELECT identity_id AS c, k, avg(x) AS x FROM p WHERE identity_id IS NOT NULL GROUP BY ALL),
d AS (SELECT id AS detection_id, c.c AS identity_id, 1 - sum(p.x * c.x) AS distance FROM p JOIN c USING (k) GROUP BY ALL),
b AS (SELECT detection_id, arg_min(identity_id, distance) AS identity_id, min(distance) AS distance FROM d WHERE distance <= 0.96 GROUP BY 1)"""


@query("identity_match", MATCH + " SELECT detection_id, CAST(identity_id AS BIGINT) AS identity_id, CAST(floor(distance * 1000000 + 0.5) AS BIGINT) AS distance FROM b", "detections")
def _identity_match(t):
    return identity_match(t.detections, t.detections, 0.96).select("detection_id", "identity_id", F.floor(F.col("distance") * 1000000 + 0.5).alias("distance"))


@query("reidentify_all", MATCH + " SELECT count(*) AS total, count(b.identity_id) AS matched, count(*) - count(b.identity_id) AS unmatched FROM detections LEFT JOIN b ON detection_id = id", "detections")
def _reidentify_all(t):
    rows = reidentified(t.detections, 0.96)
    return rows.agg(F.count("*").alias("total"), F.count("identity_id").alias("matched"), (F.count("*") - F.count("identity_id")).alias("unmatched"))
