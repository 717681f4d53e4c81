"""Connected components and closures over link tables, as loops of DataFrame steps."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, label)``: the least node that each end of ``links(u, v)`` is connected to.

    Labels pass along links and then jump to their own label's label, so rounds grow with the logarithm
    of the longest chain rather than its length on most graphs.
    """
    both, held = written(links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct(), "links")
    labels, path = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved, to = written(step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        drop(links.sparkSession, path)
        labels, path = moved.select("node", "label"), to
        if moved.where("old <> label").isEmpty():
            drop(links.sparkSession, held)
            return labels
    raise RuntimeError(f"no end after {rounds} rounds")


def _shortest(*paths: DataFrame) -> DataFrame:
    """The least distance of each (ancestor, node), loops left out."""
    rows = reduce(DataFrame.unionByName, paths).where("ancestor <> node")
    return rows.groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))


def _through(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of one of ``left`` and then one of ``right``."""
    far = right.select(F.col("ancestor").alias("at"), F.col("node").alias("far"), F.col("distance").alias("more"))
    return left.join(far, F.col("node") == F.col("at")).select("ancestor", F.col("far").alias("node"), (F.col("distance") + F.col("more")).alias("distance"))


def _steps(edges: DataFrame) -> DataFrame:
    """Edges as paths of one step."""
    rows = edges.where("parent <> child AND parent IS NOT NULL AND child IS NOT NULL")
    return rows.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``(ancestor, node, distance)``: all that is reachable over ``edges(parent, child)``, by the shortest way; cycles end.

    Paths double: when all of up to k steps are known, those of k + 1 to 2k are one of exactly k and a known
    one, so rounds follow the logarithm of the depth, and a round's work is about what it finds.
    """
    spark = edges.sparkSession
    known, path = written(_steps(edges), "closure")
    for k in (1 << i for i in count()):
        front = known.where(F.col("distance") == k)
        if front.isEmpty():
            return known
        step, to = written(_shortest(known, _through(front, known)), "closure")
        drop(spark, path)
        known, path = step, to


def _until_same(start: DataFrame, step) -> DataFrame:
    """``step`` applied to paths until no distance changes."""
    known, path = written(start, "paths")
    while True:
        new, to = written(step(known), "paths")
        old = known.select("ancestor", "node", F.col("distance").alias("old"))
        same = new.join(old, ["ancestor", "node"], "left").where("old IS NULL OR old <> distance").isEmpty()
        drop(start.sparkSession, path)
        known, path = new, to
        if same:
            return known


def closure_with(reached: DataFrame, new: DataFrame) -> DataFrame:
    """The closure ``reached(ancestor, node, distance)`` after further edges ``new(parent, child)``.

    Only paths over a new edge are made: what leads to it, the edge, and what it leads to; then such paths one
    after another, in rounds by the logarithm of how many new edges a path has.
    """
    here = written(reached.select("ancestor", "node", "distance"), "reached")[0]
    edges = _steps(new)
    before = _shortest(edges, _through(here, edges))
    over = _shortest(before, _through(before, here))
    return _shortest(here, _until_same(over, lambda p: _shortest(p, _through(p, p))))


def closure_without(reached: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """The closure ``reached`` of edges ``left(parent, child)`` and ``gone`` after the latter went.

    Pairs with no shortest way over a gone edge keep their distance. The others are found again from what
    stays: kept pairs and edges, two paths at a time, for the touched pairs alone.
    """
    here = written(reached.select("ancestor", "node", "distance"), "reached")[0]
    edges = _steps(gone).join(_steps(left), ["ancestor", "node"], "left_anti")
    before = edges.unionByName(_through(here, edges))
    over = before.unionByName(_through(before, here)).groupBy("ancestor", "node").agg(F.min("distance").alias("way"))
    touched = written(here.join(over, ["ancestor", "node"]).where("way = distance").select("ancestor", "node"), "touched")[0]
    kept_pairs = written(here.join(touched, ["ancestor", "node"], "left_anti"), "kept")[0]
    direct = _steps(left).join(touched, ["ancestor", "node"], "left_semi")

    def again(found: DataFrame) -> DataFrame:
        paths = kept_pairs.unionByName(found)
        begun = touched.select("ancestor", F.col("node").alias("wanted")).join(paths, "ancestor")
        ends = paths.select(F.col("ancestor").alias("node"), F.col("node").alias("wanted"), F.col("distance").alias("more"))
        ways = begun.join(ends, ["node", "wanted"]).select("ancestor", F.col("wanted").alias("node"), (F.col("distance") + F.col("more")).alias("distance"))
        return _shortest(found, ways)

    return kept_pairs.unionByName(_until_same(direct, again))
