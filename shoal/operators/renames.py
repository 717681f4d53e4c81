"""Batches of identity renames, as if they came one by one.

A rename to a free name takes it and frees the old one; a rename to a name that another identity holds at
that time merges into it. What a rename does depends on earlier ones only, so outcomes are computed for all
at once from a guess and computed again until they stay: the k-th rename is right after k rounds at the
latest, and chains, swaps and repeats need a few. Merges then form a forest, whose roots are found by
pointer jumping in rounds by the logarithm of its depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop, written


def roots(links: DataFrame) -> DataFrame:
    """``(from_id, to_id)``: where each ``from_id`` of ``links(from_id, to_id)`` ends, every step's end replaced by that end's own end."""
    at, path = written(links.select("from_id", "to_id"), "links")
    while True:
        far = at.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("far"))
        step, to = written(at.join(far, "to_id", "left").select("from_id", F.coalesce("far", "to_id").alias("to_id"), F.col("far").isNotNull().alias("moved")), "links")
        drop(links.sparkSession, path)
        at, path = step.select("from_id", "to_id"), to
        if step.where("moved").isEmpty():
            return at


def outcomes(identities: DataFrame, renames: DataFrame) -> DataFrame:
    """``(t, identity_id, name, alive, holder)`` of ``renames(t, identity_id, name)``, t from 1 in order.

    alive: the identity is there when its rename comes; holder: who has the name then, if that is another
    identity (the rename merges into it).
    """
    spark = renames.sparkSession
    start = identities.join(renames.select("name").union(identities.join(renames.select("identity_id"), "identity_id", "left_semi").select("name")).distinct(), "name", "left_semi")
    start = start.select(F.lit(0).cast("long").alias("t"), "identity_id", "name")
    guess, path = written(start.unionByName(renames).withColumns({"alive": F.lit(True), "holder": F.lit(None).cast("long")}), "renames")
    own, named = Window.partitionBy("identity_id").orderBy("t"), Window.partitionBy("name").orderBy("t", F.desc("identity_id"))
    before = named.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # a merge ends an identity, the next rename of a living one ends its hold on a name
        gone = F.coalesce(F.max(F.col("holder").isNotNull()).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        rows = guess.withColumns({"was": F.struct("alive", "holder"), "alive": ~gone, "until": F.lead("t").over(own)})
        holds = F.when(F.col("alive") & F.col("holder").isNull(), F.struct("identity_id", "until"))
        last = F.last(holds, ignorenulls=True).over(before)
        rows = rows.withColumn("last", last)
        taken = F.col("alive") & (F.col("t") > 0) & (F.col("last.identity_id") != F.col("identity_id")) & (F.col("last.until").isNull() | (F.col("last.until") > F.col("t")))
        rows = rows.withColumn("holder", F.when(taken, F.col("last.identity_id")))
        step, to = written(rows.select("t", "identity_id", "name", "alive", "holder", (~F.col("was").eqNullSafe(F.struct("alive", "holder"))).alias("moved")), "renames")
        drop(spark, path)
        guess, path = step.drop("moved"), to
        if step.where("moved").isEmpty():
            return guess.where("t > 0")


def applied(identities: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``identities(identity_id, name)`` that are left, with their names, and ``(from_id, to_id)`` of those that merged.

    ``renames(t, identity_id, name)`` have distinct t from 1. Names are one identity's each; renames of unknown
    identities, and those to no name, do nothing.
    """
    known = identities.select("identity_id")
    done, _ = written(outcomes(identities, renames.where("name IS NOT NULL").join(known, "identity_id", "left_semi")), "outcomes")
    merges = roots(done.where("alive AND holder IS NOT NULL").select(F.col("identity_id").alias("from_id"), F.col("holder").alias("to_id")))
    latest = done.where("alive AND holder IS NULL").groupBy("identity_id").agg(F.max_by("name", "t").alias("new"))
    left = identities.join(merges.select(F.col("from_id").alias("identity_id")), "identity_id", "left_anti").join(latest, "identity_id", "left")
    return left.withColumn("name", F.coalesce("new", "name")).select(identities.columns), merges
