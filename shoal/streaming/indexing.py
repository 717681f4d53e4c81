"""The index pipeline as a stream: new rows arrive as files, each micro-batch turns into the next version of the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import softmax, vector_checksum
from ..operators.filters import reconcile_missing
from ..shared import fresh_path, kept
from ..sources.views import query

STATE = "image_id long, state string, checksum string, label int, score double"
#: Versions after which the changes are written together again.
WHOLE = 10


def incoming(spark: SparkSession, folder: str, schema, name: str | None = None, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, ``files`` a micro-batch; with ``name`` only the file of that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def indexed(rows: DataFrame) -> DataFrame:
    """``STATE`` rows of a batch ``(image_id, vector[, logits])``: ready with the vector's checksum and best class, or failed without a vector.

    A row without logits has no class. Of several rows of an image the one with the largest vector counts.
    """
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
    if "logits" not in rows.columns:
        rows = rows.withColumn("logits", F.lit(None).cast("array<double>"))
    one = rows.groupBy("image_id").agg(F.max(F.struct("vector", "logits")).alias("r")).select("image_id", "r.*")
    classes = softmax(F.col("logits"))
    best = F.when(ok, F.array_max(classes))
    return one.select(
        "image_id", F.when(ok, "ready").otherwise("failed").alias("state"), F.when(ok, vector_checksum(F.col("vector"))).alias("checksum"),
        F.when(best.isNotNull(), F.array_position(classes, best) - 1).cast("int").alias("label"), best.alias("score"),
    )


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and folders of the versions that were written to their end, in order: ``-whole`` ones, ``-part`` ones with a batch's changes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    folders = [x.getPath().getParent().toString() for x in found or ()]
    return sorted((int(f.rsplit("/", 1)[1].split("-")[0]), f) for f in folders)


def state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state after all versions (or those before a number): the last row of each image, with its last known checksum and class."""
    held = [v for v in versions(spark, path) if before is None or v[0] < before]
    start = max((k for k, (_, f) in enumerate(held) if f.endswith("-whole")), default=0)
    rows = spark.createDataFrame([], STATE).withColumn("n", F.lit(0))
    for n, folder in held[start:]:  # at most WHOLE
        rows = rows.unionByName(spark.read.schema(STATE).parquet(folder).withColumn("n", F.lit(n)))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    return rows.groupBy("image_id").agg(F.max_by("state", "n").alias("state"), known("checksum"), known("label"), known("score"))


def run_index(stream: DataFrame, path: str, step: Callable[[DataFrame], DataFrame] = indexed, deleted: DataFrame | None = None) -> DataFrame:
    """Run the stream over what is there and return the state, also where nothing new has come.

    A micro-batch's rows first become ``preprocessing``, in a version of their own, and then what ``step``
    makes of them; rows of ``deleted(image_id)`` stay out. A version holds a batch's changes alone, so its cost
    is the batch's; every tenth is whole. A batch that is run again after a failure overwrites its own
    versions, and images that a failed run left in ``preprocessing`` wait again (``repair_states``).
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        rows = batch if deleted is None else batch.join(deleted.select("image_id"), "image_id", "left_anti")
        none = {c: F.lit(None).cast(k) for c, k in (("checksum", "string"), ("label", "int"), ("score", "double"))}
        taken = rows.select("image_id").distinct().withColumns({"state": F.lit("preprocessing"), **none})
        taken.write.mode("overwrite").parquet(f"{path}/state/{2 * n}-part")
        step(rows).write.mode("overwrite").parquet(f"{path}/state/{2 * n + 1}-part")
        if n % WHOLE == WHOLE - 1:
            state(spark, path, 2 * n + 2).write.mode("overwrite").parquet(f"{path}/state/{2 * n + 1}-whole")

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return state(spark, path)


def _arrivals(t, rows: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """The rows as files that arrive one after another."""
    path = fresh_path(t.spark, "arrivals")
    rows.repartition(parts).write.parquet(path)
    return incoming(t.spark, path, rows.schema), path


@query("stream_index")
def _stream_index(t):
    """All vectors arrive in four files; each tenth has none, deleted assets stay out, the first five components stand for class scores."""
    rows = t.embeddings.select(F.col("vec_id").alias("image_id"), F.when(F.col("vec_id") % 10 > 0, F.col("embedding")).alias("vector"), F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("logits"))
    stream, path = _arrivals(t, rows, 4)
    return run_index(stream, path + "-run", deleted=t.assets.where("is_deleted").select(F.col("id").alias("image_id")))


@query("stream_reconcile", "WITH f AS (SELECT DISTINCT path FROM assets WHERE id % 19 <> 0) SELECT id, path NOT IN (SELECT path FROM f) AS is_missing FROM assets WHERE NOT is_deleted AND (path NOT IN (SELECT path FROM f)) <> is_missing", "assets")
def _stream_reconcile(t):
    """A scheduled reconcile: one available-now run over newly listed files, its result the changed flags."""
    listing = t.assets.where("id % 19 <> 0").select("path").distinct()
    stream, path = _arrivals(t, listing, 2)
    out = path + "-seen"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept(reconcile_missing(t.assets, t.spark.read.schema("path string").parquet(out).distinct()))
