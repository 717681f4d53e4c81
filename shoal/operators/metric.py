"""Exact metric joins over vectors: pivots, balls around them, and the triangle inequality.

Rows go to their nearest pivot; a pivot's rows lie in a ball whose radius is counted. A query meets only the
balls that a point within the join's distance of it could lie in, which two bounds tell:

* the point's own ball reaches it: d(query, pivot) <= ball's radius + distance;
* the point is nearer to its pivot than to the query's: d(query, pivot) <= d(query, nearest pivot) + 2 * distance.

What is left out can't match, so results are those of all pairs. Balls lie one after another on a few
shelves, queries in a few groups by their own ball; a task has one shelf and one group, and holds its blocks against
each other one by one. A row is sent once to each group that asks for its shelf, a query once to each shelf it asks
for, so where nothing can be left out that is ``SIDE`` times at most until a shelf or a group has ``HELD`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import kept

#: Rows and queries of a block; pivots at most; rows that pivots are chosen from; slack for rounding.
ROWS, QUERIES, MOST_PIVOTS, SAMPLE, SLACK = 8192, 1024, 256, 4096, 1e-6
#: Shelves, and groups of queries, of a join whose sides are small; bytes of vectors from which there are more.
SIDE, HELD = 16, 1 << 26


def hashed(n: int, most: int):
    """A condition that holds for about ``most`` of ``n`` ids, the same ones in every run."""
    return F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))


def _pivots(rows: DataFrame, n: int, wanted: int) -> np.ndarray:
    """Of a bounded sample the first row, then each time the row farthest from all pivots so far."""
    some = rows.where("v IS NOT NULL").where(hashed(n, SAMPLE)).select("id", "v").orderBy("id").limit(2 * SAMPLE).collect()
    x = np.array([r.v for r in some] if some else [rows.where("v IS NOT NULL").first().v], dtype=float)
    x = x[np.isfinite(x).all(axis=1)] if np.isfinite(x).all(axis=1).any() else np.zeros_like(x[:1])
    chosen = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(wanted, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _vectors(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64, copy=False)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class _Stretch:
    """Balls one after another, cut into ``parts`` of about as many members."""

    start: np.ndarray
    size: np.ndarray
    parts: int

    @classmethod
    def of(cls, order: np.ndarray, size: np.ndarray, parts: int) -> _Stretch:
        start = np.zeros(len(size), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return cls(start, size, parts)

    def part(self, ball: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A member's part: its ball's members are spread over the ball's stretch by their hash."""
        return (self.start[ball] + h % np.maximum(self.size[ball], 1)) * self.parts // max(1, int(self.size.sum()))

    def covered(self) -> np.ndarray:
        """Whether each ball has room in each part."""
        some, last, n = self.size > 0, self.start + self.size - 1, max(1, int(self.size.sum()))
        parts = np.arange(self.parts)
        return some[:, None] & (self.start[:, None] * self.parts // n <= parts) & (parts <= last[:, None] * self.parts // n)


@dataclass
class _Balls:
    """Pivots, the radii of their balls (below zero: no row) and the distance of the join."""

    pivots: np.ndarray
    radii: np.ndarray
    distance: float

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's own ball, and whether it asks for each ball."""
        d = _distances(x, self.pivots)
        return d.argmin(axis=1), (d <= self.radii + self.distance + SLACK) & (d <= d.min(axis=1, keepdims=True) + 2 * self.distance + SLACK)


def _sizes(batches: Iterable[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Members and radius of each ball, a batch at a time."""
    for batch in batches:
        if batch.num_rows:
            d = _distances(_vectors(batch), pivots)
            ball, far, radius = d.argmin(axis=1), np.nan_to_num(d.min(axis=1)), np.zeros(len(pivots))
            np.maximum.at(radius, ball, far)
            n = np.bincount(ball, minlength=len(pivots))
            own = np.flatnonzero(n)
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(radius[own])], ["ball", "n", "radius"])


def _ways(batches: Iterable[pa.RecordBatch], balls: _Balls, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Queries of each ball, and how many of them ask for each shelf (-1: all of them)."""
    for batch in batches:
        if batch.num_rows:
            own, near = balls.asked(_vectors(batch))
            asks = np.column_stack(((near @ covered), np.ones(len(own), bool)))
            n = np.zeros((len(balls.pivots), asks.shape[1]), np.int64)
            np.add.at(n, own, asks)
            b, s = np.nonzero(n)
            yield pa.record_batch([pa.array(b.astype(np.int32)), pa.array(np.where(s < covered.shape[1], s, -1).astype(np.int32)), pa.array(n[b, s])], ["ball", "shelf", "n"])


def _to_shelves(batches: Iterable[pa.RecordBatch], balls: _Balls, covered: np.ndarray, groups: _Stretch) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own, near = balls.asked(_vectors(batch))
            group = groups.part(own, batch.column(2).to_numpy())
            q, s = np.nonzero(near @ covered)
            yield pa.record_batch([batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(s.astype(np.int32)), pa.array(group[q].astype(np.int32))], ["id", "v", "shelf", "part"])


def _to_groups(batches: Iterable[pa.RecordBatch], pivots: np.ndarray, shelves: _Stretch, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ball = _distances(_vectors(batch), pivots).argmin(axis=1)
            shelf = shelves.part(ball, batch.column(2).to_numpy())
            r, g = np.nonzero(wanted[shelf])
            at = pa.array(r)
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(ball[r].astype(np.int32)), pa.array(shelf[r].astype(np.int32)), pa.array(g.astype(np.int32))], ["id", "v", "ball", "shelf", "part"])


def _met(q: pa.Table, r: pa.Table, balls: _Balls, found: Callable, schema: pa.Schema, block: int, together: int) -> pa.Table:
    """What ``found`` makes of each ball of a shelf and the queries of a group that ask for it."""
    out = []
    if q.num_rows and r.num_rows:
        x, y = (_vectors(t.combine_chunks().to_batches()[0]) for t in (q, r))
        q_id, r_id, ball = (c.to_numpy() for c in (q.column("id"), r.column("id"), r.column("ball")))
        near = np.concatenate([balls.asked(x[k : k + ROWS])[1] for k in range(0, len(x), ROWS)])
        frame = lambda ids, v, at: pd.DataFrame({"id": ids[at], "v": list(v[at])})
        for b in np.unique(ball):
            asks, own = np.flatnonzero(near[:, b]), np.flatnonzero(ball == b)
            for i in range(0, len(own) if len(asks) else 0, block):
                held = frame(r_id, y, own[i : i + block])
                out += [found(frame(q_id, x, asks[j : j + together]), held) for j in range(0, len(asks), together)]
    out = [pa.Table.from_pandas(f[schema.names], preserve_index=False).cast(schema) for f in out if len(f)]
    return pa.concat_tables(out) if out else schema.empty_table()


def in_balls(queries: DataFrame, rows: DataFrame, distance: float, found: Callable, schema: str, block: int = ROWS, together: int = QUERIES) -> DataFrame:
    """Apply ``found(queries, rows)`` to blocks of ``queries(id, v)`` and ``rows(id, v)`` that cover every pair within the Euclidean ``distance``.

    Only vectors of one length meet, each length by itself; those of null are left out. ``block`` and ``together`` are
    the rows and queries of a block.
    """
    some = lambda df: kept(df.where("size(v) > 0").select("id", "v"), "vectors")  # noqa: E731  they are read several times
    same = queries is rows
    rows = some(rows)
    queries = rows if same else some(queries)
    counted = lambda df: dict(df.groupBy(F.size("v")).count().collect())  # noqa: E731  a row a length
    ns = counted(rows)
    ms = ns if same else counted(queries)
    lengths = sorted(set(ns) & set(ms))
    if len(lengths) == 1:
        one = lengths[0]
        own = lambda df, of: df if set(of) == {one} else df.where(F.size("v") == one)
        return _in_balls(own(queries, ms), own(rows, ns), ns[one], ms[one], distance, found, schema, block, together)
    of_length = lambda k: (x.where(F.size("v") == k) for x in (queries, rows))
    parts = [_in_balls(*of_length(k), ns[k], ms[k], distance, found, schema, block, together) for k in lengths]
    return reduce(DataFrame.unionByName, parts, queries.sparkSession.createDataFrame([], schema))


def _parts(n: int, length: int, block: int) -> int:
    """Parts of ``n`` vectors: one a block, at most ``SIDE``, but more where a part would hold more than ``HELD`` bytes."""
    return max(1, min(SIDE, -(-n // block)), -(-n * length * 8 // HELD))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest of those that are left."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        d = np.where(left, np.linalg.norm(pivots - pivots[order[-1]], axis=1), np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return np.array(order)


def _in_balls(queries: DataFrame, rows: DataFrame, n: int, m: int, distance: float, found: Callable, schema: str, block: int, together: int) -> DataFrame:
    pivots = _pivots(rows, n, max(1, min(MOST_PIVOTS, 2 * -(-n // block))))
    send = rows.sparkSession.sparkContext.broadcast
    sent = send(pivots)  # at most MOST_PIVOTS vectors
    order, size, radii = _chain(pivots), np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    counted = rows.mapInArrow(lambda it: _sizes(it, sent.value), "ball int, n long, radius double").groupBy("ball").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    for r in counted.collect():  # a row a pivot
        size[r.ball], radii[r.ball] = r.n, r.radius
    shelves = _Stretch.of(order, size, _parts(n, pivots.shape[1], block))
    covered, balls = shelves.covered(), send(_Balls(pivots, radii, distance))
    asking, ways = np.zeros(len(pivots), np.int64), np.zeros((len(pivots), shelves.parts), bool)
    for r in queries.mapInArrow(lambda it: _ways(it, balls.value, covered), "ball int, shelf int, n long").groupBy("ball", "shelf").agg(F.sum("n").alias("n")).collect():  # a row a pivot and shelf
        if r.shelf < 0:
            asking[r.ball] = r.n
        else:
            ways[r.ball, r.shelf] = True
    groups = _Stretch.of(order, asking, _parts(m, pivots.shape[1], together))
    wanted = ways.T @ groups.covered()  # the groups that ask for each shelf
    kind = lambda df: df.schema["v"].dataType.simpleString()
    placed = lambda df: df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"))
    asked = placed(queries).mapInArrow(lambda it: _to_shelves(it, balls.value, covered, groups), f"id long, v {kind(queries)}, shelf int, part int")
    held = placed(rows).mapInArrow(lambda it: _to_groups(it, sent.value, shelves, wanted), f"id long, v {kind(rows)}, ball int, shelf int, part int")
    result = to_arrow_schema(StructType.fromDDL(schema))
    return asked.groupBy("shelf", "part").cogroup(held.groupBy("shelf", "part")).applyInArrow(lambda q, r: _met(q, r, balls.value, found, result, block, together), schema)


def cosine_radius(threshold: float) -> float:
    """The Euclidean distance within which unit vectors, or a unit vector and one no longer than it, have 1 - product <= threshold."""
    return float(np.sqrt(max(0.0, 2 * threshold)))
