"""A stored vector index: two levels of lists, product-quantised residuals, exact re-ranking.

A bounded sample gives the upper cells; each cell's own bounded sample gives its lists, in Spark, so the
number of lists grows with the rows. A row is stored in its nearest list as codes of one byte a part of
its residual, beside the vector itself; files are sorted by list and cut into small pages, so a search
reads the pages of its lists only. A row's guessed score is the product with what its codes stand
for. The best by codes are scored again by their vectors: as many as hold most true neighbours of sampled rows. Appends and
removals are generations that a log makes visible: the index isn't rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.generations import Generations
from ..sources.views import query
from .metric import QUERIES, ROWS, _vectors, hashed
from .similarity import SCORES, _top, knn_exact, unit

#: Rows that cells, and lists of a cell, are learned from; cells and lists at most; rows a list; codes of a part, numbers a part.
SAMPLE, CELL_SAMPLE, MOST_CELLS, MOST_LISTS, LIST_ROWS, CODES, WIDTH = 20_000, 4096, 256, 1 << 16, 256, 256, 4
#: Lists of a bin, whose rows meet a query together.
BIN = 64
#: Rows of a page; sampled queries that tell how many lists to visit; what part of their neighbours these hold; candidates scored again at least, for each wanted row.
PAGE, TRIED, RECALL, AGAIN = 512, 200, 0.97, 8


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """At most ``k`` centres of rows; an empty one stays where it was."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(x) > len(c) else 0):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


class Quantizer:
    """Cells, lists and codebooks; small enough for every task (at most ``MOST_LISTS`` vectors)."""

    def __init__(self, cells: np.ndarray, owner: np.ndarray, lists: np.ndarray, books: np.ndarray):
        self.cells, self.owner, self.lists, self.books = cells, owner, lists, books
        self.of = [np.flatnonzero(owner == k) for k in range(len(cells))]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each row's list: the nearest of its nearest cell."""
        cell = nearest(x, self.cells)
        out = np.zeros(len(x), np.int64)
        for k in np.unique(cell):
            own = np.flatnonzero(cell == k)
            out[own] = self.of[k][nearest(x[own], self.lists[self.of[k]])]
        return out

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = self.books.shape[0] * self.books.shape[2]
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), *self.books.shape[::2])

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self._split(x - self.lists[lists])
        return np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` lists nearest to each query, nearest first."""
        d = (self.lists * self.lists).sum(axis=1) - 2 * (q @ self.lists.T)
        most = min(most, d.shape[1])
        top = np.argpartition(d, most - 1, axis=1)[:, :most]
        return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: a list's centre and a row's coded residual."""
        rest = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)
        return self.lists[lists] + rest[:, : self.lists.shape[1]]


def _learn_lists(rows: pd.DataFrame, wanted: dict[int, int]) -> pd.DataFrame:
    cell = int(rows["cell"].iloc[0])
    found = kmeans(np.stack(rows.sort_values("id")["v"]), wanted[cell], cell)
    return pd.DataFrame({"cell": cell, "v": list(found)})


def _in_cells(batches: Iterable[pa.RecordBatch], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nearest(_vectors(batch), cells).astype(np.int32))], ["id", "v", "cell"])


def _coded(batches: Iterable[pa.RecordBatch], q: Quantizer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch)
            lists = q.place(x)
            codes = [c.tobytes() for c in q.codes(x, lists)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array(q.owner[lists].astype(np.int32)), pa.array(codes, pa.binary())], ["id", "v", "list", "cell", "code"])


def _scored(q: pd.DataFrame, r: pd.DataFrame, quantizer: Quantizer, k: int) -> pd.DataFrame:
    """The ``k`` rows of a part of a bin, in lists that a query visits, that look best to it by their codes."""
    out = [pd.DataFrame({"query_id": [], "id": [], "list": [], "seq": [], "guess": []}).astype({"query_id": "int64", "id": "int64", "list": "int32", "seq": "int32", "guess": "float64"})]
    if len(q) and len(r):
        r = r.sort_values("id")
        lists = r["list"].to_numpy()
        first = lists.min()
        rows = quantizer.decoded(lists, np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1))
        together = max(1, SCORES // len(r))
        for start in range(0, len(q), together):
            some = q.iloc[start : start + together]
            visited = np.zeros((len(some), lists.max() - first + 1), bool)
            for own, asked in zip(visited, some["lists"]):
                asked = np.asarray(asked) - first
                own[asked[(asked >= 0) & (asked < len(own))]] = True
            guess = np.where(visited[:, lists - first], np.stack(some["v"]) @ rows.T, -np.inf)
            top = _top(guess, k)
            best = np.take_along_axis(guess, top, axis=1).ravel()
            at, own = top.ravel()[best > -np.inf], np.repeat(some["id"].to_numpy(), top.shape[1])[best > -np.inf]
            part = r.iloc[at]
            out.append(pd.DataFrame({"query_id": own, "id": part["id"].to_numpy(), "list": part["list"].to_numpy(), "seq": part["seq"].to_numpy(), "guess": best[best > -np.inf]}))
    return pd.concat(out[1:] or out)


class VectorIndex(Generations):
    """A stored index of unit vectors ``(id, v)`` under ``path``; one writer at a time.

    ``create`` learns cells, lists and codes; ``append`` and ``remove`` change what is there; ``search`` gives each
    query's nearest rows. An id that comes again after its removal counts again; of an id with several rows
    the nearest counts. Null ids and null vectors are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self._known: tuple[Quantizer, int, int] | None = None

    @classmethod
    def create(cls, rows: DataFrame, path: str, sample: int = SAMPLE, list_rows: int = LIST_ROWS, k: int = 10) -> VectorIndex:
        """Learn from at most about ``sample`` rows (cells, codes, lists to visit) and ``CELL_SAMPLE`` rows a cell (lists), then index all rows."""
        spark, index = rows.sparkSession, cls(rows.sparkSession, path)
        rows = rows.where("id IS NOT NULL AND v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
        n = rows.count()
        if not n:
            raise ValueError("an index is learned from rows; there are none")
        x = np.array([r.v for r in rows.where(hashed(n, sample)).orderBy("id").limit(2 * sample).collect()] or [rows.first().v])
        total = min(MOST_LISTS, max(1, n // list_rows))
        cells = kmeans(x, max(1, min(MOST_CELLS, int(total**0.5), len(x))))
        sent = spark.sparkContext.broadcast(cells)
        placed = rows.mapInArrow(lambda it: _in_cells(it, sent.value), "id long, v array<double>, cell int")
        sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        wanted = {c: max(1, round(total * m / n)) for c, m in sizes.items()}
        share = F.element_at(F.array(*[F.lit(min(1.0, CELL_SAMPLE / sizes.get(c, 1))) for c in range(len(cells))]), F.col("cell") + 1)
        some = placed.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
        learned = some.groupBy("cell").applyInPandas(lambda g: _learn_lists(g, wanted), "cell int, v array<double>").collect()  # at most MOST_LISTS and a list a cell
        learned += [(c, cells[c].tolist()) for c in range(len(cells)) if c not in {r.cell for r in learned}]
        learned.sort(key=lambda r: (r[0], r[1]))
        owner, lists = np.array([r[0] for r in learned]), np.array([r[1] for r in learned])
        books = -(-x.shape[1] // WIDTH)
        quantizer = Quantizer(cells, owner, lists, np.zeros((books, 1, WIDTH)))
        rest = quantizer._split(x - lists[quantizer.place(x)])
        codes = min(CODES, max(1, len(x) // 8))
        quantizer.books = np.stack([kmeans(rest[:, m], codes, m) for m in range(books)])
        index._keep(quantizer, *cls._visits(quantizer, x, max(1, -(-k * len(x) // n)), n))
        index.append(rows)
        return index

    @staticmethod
    def _visits(quantizer: Quantizer, x: np.ndarray, k: int, n: int) -> tuple[int, int]:
        """How many lists, and how many of ``n`` rows that look best by codes, hold ``RECALL`` of the ``k`` neighbours of sampled rows.

        Of k among all rows the sample has its share. A row is no neighbour of its own.
        """
        rng = np.random.default_rng(0)
        asked = rng.permutation(len(x))[:TRIED]
        own = quantizer.place(x)
        seen = quantizer.decoded(own, quantizer.codes(x, own))
        order = quantizer.order(x[asked], len(quantizer.lists))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        visits, better = [0], [0]
        for row, a in enumerate(asked):
            score, guess = x @ x[a], seen @ x[a]
            score[a] = guess[a] = -np.inf
            near = np.argsort(-score, kind="stable")[:k]
            near = near[near != a]
            visits += place[row, own[near]].tolist()
            better += [int((guess > g).sum()) for g in guess[near]]
        held = lambda at: int(np.quantile(at, RECALL, method="higher")) + 1
        return held(visits), -(-held(better) * n // len(x))

    def _keep(self, q: Quantizer, visits: int, again: int) -> None:
        rows = [("cell", k, 0, v.tolist()) for k, v in enumerate(q.cells)] + [("list", k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(q.owner, q.lists))]
        rows += [("book", m, c, v.tolist()) for m, book in enumerate(q.books) for c, v in enumerate(book)] + [("visits", visits, again, [])]
        self.spark.createDataFrame(rows, "kind string, k int, c int, v array<double>").coalesce(1).write.parquet(f"{self.path}/quantizer")
        self._log(0, "learned")

    def _quantizer(self) -> tuple[Quantizer, int, int]:
        if self._known is None:
            rows = sorted(self.spark.read.parquet(f"{self.path}/quantizer").collect(), key=lambda r: (r.kind, r.k, r.c))  # bounded by MOST_LISTS
            of = lambda kind: [r for r in rows if r.kind == kind]
            books = of("book")
            shaped = np.array([r.v for r in books]).reshape(books[-1].k + 1, -1, WIDTH)
            self._known = Quantizer(np.array([r.v for r in of("cell")]), np.array([r.c for r in of("list")]), np.array([r.v for r in of("list")]), shaped), of("visits")[0].k, of("visits")[0].c
        return self._known

    def append(self, rows: DataFrame) -> None:
        """Code further rows with what was learned, as a generation of their own; a failed append is never seen."""
        sent = self.spark.sparkContext.broadcast(self._quantizer()[0])
        _, _, seq = self._state()
        rows = rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        coded = rows.mapInArrow(lambda it: _coded(it, sent.value), "id long, v array<double>, list int, cell int, code binary")
        order = ["cell", "list", "id"]  # a list of very many rows is cut by id
        placed = coded.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        placed.write.option("parquet.page.row.count.limit", PAGE).partitionBy("cell").mode("overwrite").parquet(f"{self.path}/rows/seq={seq}")
        self._log(seq, "rows")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """Stored rows ``(id, v, list, code, seq)``; with ``lists`` of these alone, from their cells' folders and their own pages."""
        table = self._read("rows", self._state()[0]["rows"], "id long, v array<double>, list int, code binary, cell int")
        if lists is not None:
            cells = sorted({int(self._quantizer()[0].owner[k]) for k in lists})
            table = table.where(F.col("cell").isin(cells) & F.col("list").isin(lists))
        return table.drop("cell")

    def search(self, queries: DataFrame, k: int = 10, visits: int | None = None) -> DataFrame:
        """``(query_id, rank, id, score)``: about the k nearest rows by cosine of each of ``queries(id, v)``, its own id left out."""
        quantizer, usual, again = self._quantizer()
        sent = self.spark.sparkContext.broadcast(quantizer)
        most = visits or usual

        @F.pandas_udf("array<int>")
        def lists_of(v: pd.Series) -> pd.Series:
            return pd.Series(list(sent.value.order(np.stack(v.to_numpy()), most).astype(np.int32)))

        queries = queries.where("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
        asked = queries.withColumn("lists", lists_of("v"))
        lists = sorted(r.list for r in asked.select(F.explode("lists").alias("list")).distinct().collect())  # at most MOST_LISTS
        if not lists:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        bin_of = lambda c: F.shiftright(c, BIN.bit_length() - 1)
        codes = self._live(self.rows(lists).select("id", "list", "code", "seq"), "id").withColumn("bin", bin_of(F.col("list")))
        parts = codes.groupBy("bin").agg(F.ceil(F.count("*") / (2 * BIN * LIST_ROWS)).alias("parts"))  # a row a bin
        codes = codes.join(F.broadcast(parts), "bin").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        blocks = max(1, -(-queries.count() // QUERIES))
        asked = asked.withColumn("bin", F.explode(F.array_distinct(F.transform("lists", bin_of))))
        asked = asked.withColumn("lists", F.filter("lists", lambda c: bin_of(c) == F.col("bin")))
        asked = asked.join(F.broadcast(parts), "bin").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        asked = asked.select("id", "v", "lists", "bin", "part", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb"))
        keys = ["bin", "part", "qb"]
        pairs = asked.select(F.col("bin").alias("l"), F.col("part").alias("p"), F.col("qb").alias("b")).distinct()
        held = codes.join(pairs, (F.col("bin") == F.col("l")) & (F.col("part") == F.col("p")))
        held = held.select("id", "list", "code", "seq", F.col("l").alias("bin"), F.col("p").alias("part"), F.col("b").alias("qb"))
        again = max(again, AGAIN * k)
        guessed = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda q, r: _scored(q, r, sent.value, again + 1), "query_id long, id long, list int, seq int, guess double")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), "id"))
        best = guessed.where("id <> query_id").withColumn("k", best).where(F.col("k") <= again).drop("k", "guess")
        # the candidates' vectors, from the pages of their lists
        vectors = self.rows(lists).select("id", "v", "list", "seq")
        exact = best.distinct().join(vectors, ["id", "list", "seq"]).join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        one = exact.groupBy("query_id", "id").agg(F.max(score).alias("score"))
        return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@query("knn_index", "SELECT count(*) AS asked, true AS reached FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def _knn_index(t):
    """Nine of ten true neighbours of the queries come from an index that grew by an append and lost and regained rows."""
    from ..shared import fresh_path

    rows = unit(t.embeddings)
    early = F.col("id") % 4 > 0
    index = VectorIndex.create(rows.where(early), fresh_path(t.spark, "vector-index"))
    index.append(rows.where(~early))
    index.remove(rows.where("id % 7 = 0"))
    index.append(rows.where("id % 7 = 0"))
    asked = rows.where("id % 20 = 0")
    exact, found = knn_exact(asked, rows).select("query_id", "id"), index.search(asked).select("query_id", "id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("asked"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))
    return recall
