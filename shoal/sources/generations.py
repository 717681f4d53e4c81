"""Stored tables that grow by generations: every append and removal is a folder of its own, a log makes it visible.

A generation's files are written before its line in the log, so a failed job's are never seen, and readers list
the folders of visible generations only. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "seq int, kind string, n long"


class Generations:
    """A log of generations under ``path``; removed keys count for the generations before their removal."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self, seq: int, kind: str, n: int = 0) -> None:
        self.spark.createDataFrame([(seq, kind, n)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _state(self) -> tuple[dict[str, list[int]], dict[str, int], int]:
        """Generations by kind, the last number logged with a kind, and the next generation."""
        rows = sorted(self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect())  # a row an append or removal
        of: dict[str, list[int]] = {}
        for r in rows:
            of.setdefault(r.kind, []).append(r.seq)
        return of, {r.kind: r.n for r in rows}, rows[-1].seq + 1

    def _read(self, table: str, generations: list[int], schema: str) -> DataFrame:
        """A table's rows of some generations, with their ``seq``."""
        reader = self.spark.read.schema(f"{schema}, seq int").option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[f"{self.path}/{table}/seq={k}" for k in generations])

    def remove(self, keys: DataFrame) -> None:
        """Take out rows by their key (the first column), of all generations so far."""
        _, _, seq = self._state()
        keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where("key IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/seq={seq}")
        self._log(seq, "gone")

    def _live(self, found: DataFrame, key: str) -> DataFrame:
        """``found``, which has its rows' ``seq``, without rows that were removed later."""
        gone = self._state()[0].get("gone")
        if not gone:
            return found
        out = self._read("gone", gone, "key long").select(F.col("key").alias("_key"), F.col("seq").alias("_at"))
        return found.join(out, (F.col(key) == F.col("_key")) & (F.col("_at") > F.col("seq")), "left_anti")
