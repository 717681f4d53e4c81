"""Boxes of images, joined by grid cells: which region holds a box, and which boxes overlap.

Two boxes with an overlap above a threshold are of similar width and height, and their centres are close
for their size. So boxes are keyed by size class (powers of two of width and height) and by the cell of a
grid as fine as the class; a box meets its own and neighbouring classes in the cells its centre may reach.
No image's boxes are gathered, so an image may have very many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written
from ..sources.views import query

#: Boxes of an image that are folded as one list.
FOLDED = 256
_SIDES = ("x0", "y0", "x1", "y1")


def _class(size: Column) -> Column:
    """The power of two above a size."""
    return F.floor(F.log2(size)) + 1


def _unit(cls: Column) -> Column:
    return F.pow(F.lit(2.0), cls)


def _cells(low: Column, high: Column, unit: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / unit).cast("long"), F.floor(high / unit).cast("long")))


def boxes_in_regions(boxes: DataFrame, regions: DataFrame, pad: int = 20) -> DataFrame:
    """``(image_id, box_id, region)``, one row a box: the last region that holds the box's centre, padded; null for orphans.

    A padded region has the cells it covers in a grid as wide as itself, at most two a side; a box's centre is
    in one cell of each grid that its image has.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = boxes.select("image_id", "box_id", x.alias("x"), y.alias("y"))
    a, b, c, d = F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad, F.col("y1") + pad
    areas = regions.select("image_id", "region", a.alias("rx0"), b.alias("ry0"), c.alias("rx1"), d.alias("ry1")).where("rx0 <= rx1 AND ry0 <= ry1")
    areas = areas.withColumn("grid", _class(F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"), F.lit(1.0))))
    unit = _unit(F.col("grid"))
    areas = areas.withColumn("cx", _cells(F.col("rx0"), F.col("rx1"), unit)).withColumn("cy", _cells(F.col("ry0"), F.col("ry1"), unit))
    grids = areas.select("image_id", "grid").distinct()
    placed = points.join(grids, "image_id").withColumns({"cx": F.floor(F.col("x") / unit).cast("long"), "cy": F.floor(F.col("y") / unit).cast("long")})
    inside = F.col("x").between(F.col("rx0"), F.col("rx1")) & F.col("y").between(F.col("ry0"), F.col("ry1"))
    held = placed.join(areas, ["image_id", "grid", "cx", "cy"]).where(inside).groupBy("image_id", "box_id").agg(F.max("region").alias("region"))
    return points.select("image_id", "box_id").distinct().join(held, ["image_id", "box_id"], "left")


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; null without any area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


_HOME = ["image_id", "cw", "ch", "cx", "cy"]


def _at_home(boxes: DataFrame) -> DataFrame:
    """Boxes ``(image_id, box)`` with the classes of their sides and the cell of their centre."""
    b = F.col("box")
    rows = boxes.withColumns({"cw": _class(b["x1"] - b["x0"]), "ch": _class(b["y1"] - b["y0"])})
    cell = lambda low, high, cls: F.floor((b[low] + b[high]) / 2 / _unit(F.col(cls))).cast("long")
    return rows.select("image_id", "box", "cw", "ch", cell("x0", "x1", "cw").alias("cx"), cell("y0", "y1", "ch").alias("cy"))


def _asking(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes ``(image_id, box)`` at every home that a box which overlaps them by more than ``threshold`` may have."""
    steps = 1  # sides of such boxes have a ratio above the threshold
    while 0.5**steps > threshold and steps < 64:
        steps += 1
    near = [F.lit(k) for k in range(-steps, steps + 1)]
    b = F.col("box")
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]

    def reach(side: Column, unit: Column) -> Column:
        """The most that the centres are apart, when the other side is below ``unit``."""
        inner = side * (0.5 - threshold) + F.least(side, unit) / 2
        return F.greatest(F.lit(0.0), inner, F.when(unit > side, side / 2 + unit * (0.5 - threshold)))

    rows = boxes.withColumn("cw", F.explode(F.array(*[_class(w) + k for k in near]))).withColumn("ch", F.explode(F.array(*[_class(h) + k for k in near])))
    uw, uh = _unit(F.col("cw")), _unit(F.col("ch"))
    x, y, rx, ry = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2, reach(w, uw), reach(h, uh)
    rows = rows.withColumn("cx", _cells(x - rx, x + rx, uw)).withColumn("cy", _cells(y - ry, y + ry, uh))
    return rows.select(*_HOME, F.col("box").alias("asks"))


def _in_rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """What stays of ``(image_id, box)``, in rounds of local maxima.

    The best open box of each cell meets the open boxes around it. One that no better open box overlaps stays,
    and what it overlaps goes. A round's work is about the number of open boxes, however many overlap.
    """
    b = F.col("box")
    flat = (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])  # overlaps nothing
    stays, spark = [boxes.where(flat)], boxes.sparkSession
    rest, path = written(_at_home(boxes.where(~flat)), "open")
    while not rest.isEmpty():
        best = rest.groupBy(*_HOME).agg(F.min("box").alias("box")).select("image_id", "box")
        met = _asking(best, threshold).join(rest, _HOME).where((F.col("asks") != F.col("box")) & (_overlap(F.col("asks"), F.col("box")) > threshold))
        met, to = written(met.select("image_id", "asks", "box"), "met")
        beaten = met.where("box < asks").select("image_id", F.col("asks").alias("box")).distinct()
        keeps = written(best.join(beaten, ["image_id", "box"], "left_anti"), "kept")[0]
        lost = met.join(keeps.withColumnRenamed("box", "asks"), ["image_id", "asks"], "left_semi").select("image_id", "box")
        left, further = written(rest.join(keeps.unionByName(lost).distinct(), ["image_id", "box"], "left_anti").select(rest.columns), "open")
        drop(spark, path, to)
        stays.append(keeps)
        rest, path = left, further
    return reduce(DataFrame.unionByName, stays)


def suppressed(boxes: DataFrame, threshold: float = 0.5, folded: int = FOLDED) -> DataFrame:
    """``(image_id, box_id)`` of boxes that stay: by confidence, those that overlap no box kept before them by more than ``threshold``.

    Images of at most ``folded`` boxes are one list each, folded in order; larger ones are suppressed in rounds
    over grid cells, so no list and no task grows with an image. Ties go to the smaller box_id, then by sides;
    equal rows are one box.
    """
    entry = F.struct((-F.col("confidence").cast("double")).alias("order"), "box_id", *[F.col(c).cast("double").alias(c) for c in _SIDES])
    rows = boxes.select("image_id", entry.alias("box"))
    many = rows.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > folded).select("image_id")
    many, _ = written(many, "large-images")
    lists = rows.join(many, "image_id", "left_anti").groupBy("image_id").agg(F.array_sort(F.collect_set("box")).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda held, x: F.when(F.exists(held, lambda k: _overlap(k, x) > threshold), held).otherwise(F.concat(held, F.array(x))))
    out = lists.select("image_id", F.explode(kept).alias("box"))
    if not many.isEmpty():
        out = out.unionByName(_in_rounds(rows.join(many, "image_id", "left_semi").distinct(), threshold))
    return out.select("image_id", "box.box_id")


@query("box_in_region", """
WITH r AS (SELECT *, box_id AS region FROM boxes WHERE box_id < 3000000000), b AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM boxes WHERE box_id >= 3000000000)
SELECT b.image_id, b.box_id, max(r.region) AS region FROM b LEFT JOIN r ON r.image_id = b.image_id AND x BETWEEN r.x0 - 20 AND r.x1 + 20 AND y BETWEEN r.y0 - 20 AND r.y1 + 20 GROUP BY ALL""", "boxes")
def _box_in_region(t):
    line = F.col("box_id") < 3000000000
    return boxes_in_regions(t.boxes.where(~line), t.boxes.where(line).withColumn("region", F.col("box_id")))


@query("nms", """WITH RECURSIVE b AS (SELECT image_id, box_id, {'x0': x0::DOUBLE, 'y0': y0::DOUBLE, 'x1': x1::DOUBLE, 'y1': y1::DOUBLE, 'box_id': box_id} AS s, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS k FROM (SELECT DISTINCT * FROM boxes)),
r(image_id, k, kept) AS (SELECT image_id, k, [s] FROM b WHERE k = 1 UNION ALL SELECT b.image_id, b.k, CASE WHEN len(list_filter(r.kept, lambda c: greatest(0, least(c.x1, b.s.x1) - greatest(c.x0, b.s.x0)) * greatest(0, least(c.y1, b.s.y1) - greatest(c.y0, b.s.y0))
  / ((c.x1 - c.x0) * (c.y1 - c.y0) + (b.s.x1 - b.s.x0) * (b.s.y1 - b.s.y0) - greatest(0, least(c.x1, b.s.x1) - greatest(c.x0, b.s.x0)) * greatest(0, least(c.y1, b.s.y1) - greatest(c.y0, b.s.y0))) > 0.5)) > 0 THEN r.kept ELSE list_append(r.kept, b.s) END
 FROM r JOIN b ON b.image_id = r.image_id AND b.k = r.k + 1)
SELECT image_id, unnest(arg_max(kept, k)).box_id AS box_id FROM r GROUP BY image_id""", "boxes")
def _nms(t):
    return suppressed(t.boxes)
