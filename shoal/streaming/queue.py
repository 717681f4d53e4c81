"""The index queue as keyed state: each image's state, its retries and its expiry live in the stream itself.

Events ``(image_id, kind, vector, logits, at)`` add an image, or take it away at any time. Vectors are
embedded in batches of at most sixteen; Spark keeps a state for each image, with timers for what comes later
by itself: a failed image waits again after a growing delay, a ready one goes stale after its time to live.
What comes out is a log of transitions; its last row of an image is the image's state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.vectors import softmax, vector_checksum
from ..shared import fresh_path
from ..sources.views import query

#: Rows that are embedded together; tries of an image; milliseconds to the first retry, and of a ready row's life.
TOGETHER, TRIES, RETRY, LIFE = 16, 3, 60_000, 7 * 24 * 3_600_000

EVENTS = "image_id long, kind string, vector array<double>, logits array<double>, at timestamp"
LOG = StructType([StructField("image_id", LongType()), StructField("state", StringType()), StructField("checksum", StringType()), StructField("label", IntegerType()), StructField("score", DoubleType()), StructField("tries", IntegerType()), StructField("at", LongType()), StructField("step", LongType())])
_STATE = StructType([StructField("state", StringType()), StructField("tries", IntegerType()), StructField("step", LongType()), StructField("due", LongType())])

Embed = Callable[[pd.DataFrame], pd.DataFrame]


def embedded(rows: DataFrame, embed: Embed, together: int = TOGETHER) -> DataFrame:
    """``embed`` applied to at most ``together`` rows at a time; it returns rows of the same columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), together):
                yield embed(frame.iloc[k : k + together])

    return rows.mapInPandas(run, rows.schema)


class ImageQueue(StatefulProcessor):
    """The state of one image: pending after an event without a vector until it is tried again, ready, stale, failed, removed."""

    def __init__(self, tries: int = TRIES, retry: int = RETRY, life: int = LIFE):
        self.tries, self.retry, self.life = tries, retry, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _to(self, out: list, key: tuple, old: tuple | None, state: str, tries: int, at: int, due: int, row: Any = None) -> tuple:
        """Go from ``old`` to a state that lasts until ``due`` (-1: until the next event), and log it."""
        step = old[2] + 1 if old else 0
        known = (row.checksum, row.label, None if row.score is None or math.isnan(row.score) else row.score) if row is not None else (None, None, None)
        out.append(Row(*LOG.names)(key[0], state, *known, tries, at, step))
        return state, tries, step, due

    def _fail(self, out: list, key: tuple, old: tuple | None, tries: int, at: int) -> tuple:
        again = tries < self.tries
        return self._to(out, key, old, "waiting" if again else "failed", tries, at, at + (self.retry << (tries - 1)) if again else -1)

    def _hold(self, before: tuple | None, now: tuple | None) -> None:
        """Keep a state and its timer: each call goes to the state server, so a batch's events of an image make one."""
        if now is None or now == before:
            return
        due = before[3] if before else -1
        if due >= 0 and due != now[3]:
            self.handle.deleteTimer(due)
        self.held.update(now)
        if now[3] >= 0 and now[3] != due:
            self.handle.registerTimer(now[3])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        out: list = []
        before = now = self.held.get()
        every = sorted(rows, key=lambda r: (r.at, r.kind is None, r.kind or "", r.checksum is None, r.checksum or ""))  # one image's events of a batch
        for row in every:
            at = row.at
            if row.kind == "remove":
                now = self._to(out, key, now, "removed", 0, at, -1)
            elif row.checksum is not None:
                now = self._to(out, key, now, "ready", 0, at, at + self.life, row)
            else:
                now = self._fail(out, key, now, now[1] + 1 if now and now[0] in ("waiting", "pending") else 1, at)
        self._hold(before, now)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        out: list = []
        before = now = self.held.get()
        if before and before[3] == expiredTimerInfo.getExpiryTimeInMs():
            state, tries, _, due = before
            if state == "ready":
                now = self._to(out, key, before, "stale", 0, due, -1)
            elif state == "waiting":
                now = self._to(out, key, before, "pending", tries, due, due + self.retry)
            elif state == "pending":  # nobody sent it again
                now = self._fail(out, key, before, tries + 1, due)
        self._hold(before, now)
        return iter(out)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, embed: Embed | None = None, delay: str = "0 seconds", tries: int = TRIES, retry: int = RETRY, life: int = LIFE) -> DataFrame:
    """The stream ``LOG`` of an event stream; event time drives the timers, so a run over stored events gives what a live one gave.

    A null or empty vector is a failure: the image waits ``retry`` milliseconds (twice as long each time), is then
    pending for ``retry`` milliseconds, and a try that nobody answers counts as failed too; after
    ``tries`` it stays failed until an event comes. A removal ends everything, and an image may come again
    after it. Events of one image in one micro-batch count in order of time. The session needs the RocksDB
    state store (``use_state_store``).
    """
    rows = events if embed is None else embedded(events, embed)
    rows = rows.where("image_id IS NOT NULL").withWatermark("at", delay)
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.col("kind") == "add")
    classes = softmax(F.col("logits"))
    best = F.when(ok, F.array_max(classes))
    label = F.when(best.isNotNull(), F.array_position(classes, best) - 1).cast("int")
    seen = rows.select("image_id", "kind", F.when(ok, vector_checksum(F.col("vector"))).alias("checksum"), label.alias("label"), best.alias("score"), F.unix_millis("at").alias("at"), F.col("at").alias("time"))
    return seen.groupBy("image_id").transformWithState(ImageQueue(tries, retry, life), LOG, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB provider; a session that has chosen another one is left as it is."""
    key, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_queue(events: DataFrame, path: str, **options) -> DataFrame:
    """Run the stream over what is there and return the log so far; started again, it goes on where it was ended."""
    spark = events.sparkSession
    use_state_store(spark)
    log = transitions(events, **options)
    log.writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(LOG).parquet(f"{path}/log")


def current(log: DataFrame) -> DataFrame:
    """The state of each image that isn't removed, with its last known checksum and class."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c)
    since = log.groupBy("image_id").agg(F.coalesce(F.max(F.when(F.col("state") == "removed", F.col("step"))), F.lit(-1)).alias("gone"))
    rows = log.join(since, "image_id").where(F.col("step") > F.col("gone"))
    return rows.groupBy("image_id").agg(F.max_by("state", "step").alias("state"), F.max_by("tries", "step").alias("tries"), known("checksum"), known("label"), known("score"))


@query("stream_queue", """
WITH e AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 10 = 0 THEN 'failed' WHEN vec_id % 3 = 0 THEN 'stale' ELSE 'ready' END AS state, CASE WHEN vec_id % 10 = 0 THEN 3 ELSE 0 END AS tries FROM embeddings)
SELECT image_id, state, CAST(tries AS INT) AS tries, state <> 'failed' AS known FROM e WHERE image_id NOT IN (SELECT id FROM assets WHERE is_deleted)""", "assets")
def _stream_queue(t):
    """All vectors arrive, a third of them eight days before the rest; each tenth has none and nobody sends it again; deleted assets go later."""
    from .indexing import incoming

    spark, day = t.spark, F.expr("INTERVAL 1 DAY")
    start = F.lit("2024-01-01").cast("timestamp")
    k = F.col("vec_id")
    vector = F.when(k % 10 > 0, F.col("embedding").cast("array<double>"))
    added = t.embeddings.select(k.alias("image_id"), F.lit("add").alias("kind"), vector.alias("vector"), F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("logits"), F.when(k % 3 == 0, start).otherwise(start + 8 * day).alias("at"))
    none = F.lit(None).cast("array<double>")
    gone = t.assets.where("is_deleted").join(t.embeddings.select(k.alias("id")), "id", "left_semi").select(F.col("id").alias("image_id"), F.lit("remove").alias("kind"), none.alias("vector"), none.alias("logits"), (start + 9 * day).alias("at"))
    # an image beyond the others moves the clock: what waits is due in the batches after it
    clock = [t.embeddings.agg(F.lit(-1).cast("long").alias("image_id")).select("image_id", F.lit("remove").alias("kind"), none.alias("vector"), none.alias("logits"), (start + F.expr(f"INTERVAL {12 * 24 + h} HOUR")).alias("at")) for h in range(5)]
    path = fresh_path(spark, "events")
    for rows in (added, gone, *clock):
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = incoming(spark, path, spark.createDataFrame([], EVENTS).schema)
    log = run_queue(stream, fresh_path(spark, "queue"))
    return current(log).select("image_id", "state", "tries", F.col("checksum").isNotNull().alias("known"))
