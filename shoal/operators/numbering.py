"""Consecutive numbers in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def numbered(rows: DataFrame, order: Sequence[str | Column], base: Column | int = 0, name: str = "id") -> DataFrame:
    """Consecutive numbers from ``base`` + 1 in a total order, by sorted parts and their offsets: no task sees all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = kept(placed)
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a part
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_k", own).join(F.broadcast(offsets), "_p").withColumn(name, F.lit(0).cast("long") + base + F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")
