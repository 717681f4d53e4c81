"""Orders within groups: positions, runs, decoded sequences, reading order, eviction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import query
from .changes import numbered
from .filters import live


def gallery_position(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, position)``: how many live assets come before each wanted one, newest first.

    Places come from sorted parts and their sizes, so no task sees all assets, nor all of one moment.
    """
    rows = numbered(live(assets).select("id", "created_at"), [F.desc("created_at"), F.desc("id")], -1, "position")
    return rows.select("id", "position").join(wanted.select("id"), "id", "left_semi")


def top_tags(counts: DataFrame, k: int = 300) -> DataFrame:
    """The k most used tags of each category with their share of the category's most used one."""
    w = Window.partitionBy("category")
    own = F.when(F.col("category").isin("character", "copyright", "meta", "user"), F.col("category")).otherwise("other")
    rows = counts.withColumn("category", own)
    place = F.row_number().over(w.orderBy(F.desc("n"), "tag_id"))
    return rows.withColumns({"place": place, "share": F.col("n") / F.max("n").over(w)}).where(F.col("place") <= k)


def collapsed(history: DataFrame, keys: list[str], item: str, at: str, tie: str) -> DataFrame:
    """Runs of the same item one after another become one row with the run's last time."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    starts = ~F.col(item).eqNullSafe(F.lag(item).over(w)) | (F.row_number().over(w) == 1)
    runs = history.withColumn("run", F.sum(starts.cast("long")).over(w))
    return runs.groupBy(*keys, "run").agg(F.first(item).alias(item), F.max(at).alias(at), F.count("*").alias("n"))


def decoded(steps: DataFrame, alphabet: str, least: float = 0.5) -> DataFrame:
    """Greedy decoding of ``(line, step, class, score)``: best class a step (first on ties), no blanks (0), no repeats.

    ``(line, text, confidence)`` of lines whose mean confidence exceeds ``least``.
    """
    best = steps.groupBy("line", "step").agg(F.max(F.struct("score", (-F.col("class")).alias("c"))).alias("b")).select("line", "step", (-F.col("b.c")).alias("class"), F.col("b.score").alias("score"))
    w = Window.partitionBy("line").orderBy("step")
    kept = best.withColumn("last", F.lag("class").over(w)).where((F.col("class") != 0) & ~F.col("class").eqNullSafe(F.col("last")))
    letter = F.substring(F.lit(alphabet), F.col("class").cast("int"), F.lit(1))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("step", letter.alias("x")))), lambda s: s["x"]))
    out = kept.groupBy("line").agg(text.alias("text"), F.avg("score").alias("confidence"))
    return out.where((F.col("confidence") > least) & (F.trim("text") != ""))


def reading_order(boxes: DataFrame) -> DataFrame:
    """``(image_id, box_id, place)``: by region (its first box's height), then height, then left edge; orphans last."""
    y, x = F.col("y0") + F.col("y1"), F.col("x0") + F.col("x1")
    rows = boxes.withColumns({"y": y, "x": x, "orphan": F.col("region").isNull()})
    rows = rows.withColumn("top", F.when(~F.col("orphan"), F.min("y").over(Window.partitionBy("image_id", "region"))))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("orphan", "top", "region", "y", "x", "box_id"))
    return rows.select("image_id", "box_id", place.alias("place"))


def merge_boxes(boxes: list[tuple[float, float, float, float]], gap: float = 10) -> list[tuple[float, float, float, float]]:
    """Boxes by (y, x), same-line neighbours by x; fragments on one line within ``gap`` become one, until none do.

    Of the pairs that can be joined the first in order always is. Only the box that has grown can open new
    pairs, so after a join it alone is held against those before it and then against those behind.
    """
    rows = sorted(boxes, key=lambda b: (b[1], b[0]))
    for k in range(len(rows) - 1):
        for j in range(k, -1, -1):
            if abs(rows[j + 1][1] - rows[j][1]) < gap and rows[j + 1][0] < rows[j][0]:
                rows[j], rows[j + 1] = rows[j + 1], rows[j]
            else:
                break

    def one_line(p, q) -> bool:
        return abs(p[1] - q[1]) <= gap and abs(p[3] - q[3]) <= gap and max(p[0], q[0]) - min(p[2], q[2]) <= gap

    def join(a: int, b: int) -> None:
        p, q = rows[a], rows.pop(b)
        rows[a] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))

    a = 0
    while a < len(rows):
        b = next((b for b in range(a + 1, len(rows)) if one_line(rows[a], rows[b])), None)
        if b is None:
            a += 1
            continue
        join(a, b)
        while (before := next((k for k in range(a) if one_line(rows[k], rows[a])), None)) is not None:
            join(before, a)
            a = before
    return rows


def merged_fragments(boxes: DataFrame, gap: float = 10) -> DataFrame:
    """``(image_id, place, x0, y0, x1, y1)`` of the merged boxes of each image; an image's boxes are one small group."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda own: [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in merge_boxes([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in own], gap)])

    merge = F.pandas_udf(run, "array<struct<x0:double,y0:double,x1:double,y1:double>>")
    entry = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    lists = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("own"))
    return lists.select("image_id", F.posexplode(merge("own")).alias("place", "b")).select("image_id", "place", "b.*")


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """Rows that stay when a cache holds more than ``most``: the excess and a tenth go, oldest first, with all rows of their ids.

    Days are counted first, so that only rows up to the day on the border are sorted.
    """
    n = cache.count()
    if n <= most:
        return cache
    goal = n - most + most // 10
    dated = cache.withColumn("_day", F.to_date("created_at"))
    days = dated.groupBy("_day").agg(F.count("*").alias("n"))
    sums = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    old = dated.join(sums.where(F.col("before") < goal).select("_day"), "_day", "left_semi").select("id", "kind", "created_at")
    gone = numbered(old, ["created_at", "id", "kind"], 0, "place").where(F.col("place") <= goal).select("id").distinct()
    return cache.join(gone, "id", "left_anti")


POSITIONS = "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS position FROM assets WHERE NOT is_deleted AND NOT is_missing"


@query("gallery_position", POSITIONS, "assets")
@query("gallery_position_all", POSITIONS, "assets")
def _gallery_position(t):
    return gallery_position(t.assets, t.assets)


@query("top_tags_per_category", """
WITH c AS (SELECT tag_id, CASE WHEN category IN ('character', 'copyright', 'meta', 'user') THEN category ELSE 'other' END AS category, count(*) AS n FROM asset_tags a JOIN tags t ON a.tag_id = t.id WHERE source_id = 1 AND NOT is_deleted GROUP BY ALL)
SELECT tag_id, category, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, tag_id) AS INT) AS place, CAST(floor(n * 1000 / max(n) OVER (PARTITION BY category) + 0.5) AS BIGINT) AS share FROM c QUALIFY place <= 300""", "asset_tags tags")
def _top_tags(t):
    from .stats import tag_statistics

    return top_tags(tag_statistics(t.asset_tags, t.tags, 1)).select("tag_id", "category", "n", "place", F.floor(F.col("share") * 1000 + 0.5).alias("share"))


@query("history_collapse", """
WITH s AS (SELECT *, CASE WHEN item IS NOT DISTINCT FROM lag(item) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS s FROM history WINDOW w AS (PARTITION BY user_id ORDER BY read_at, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY read_at, event_id) AS run FROM s) SELECT user_id, CAST(run AS BIGINT) AS run, min(item) AS item, max(read_at) AS read_at, count(*) AS n FROM r GROUP BY user_id, run""", "history")
def _history_collapse(t):
    return collapsed(t.history, ["user_id"], "item", "read_at", "event_id")


STEPS = "SELECT l_orderkey AS line, l_linenumber AS step, k AS class, CAST((l_partkey * (k + 3) + l_suppkey * k * 7) % 101 AS DOUBLE) / 100 AS score FROM lineitem, (SELECT unnest(generate_series(0, 4)) AS k)"


@query("ctc_decode", f"""
WITH s AS ({STEPS}), b AS (SELECT line, step, arg_max(class, score * 1000 - class) AS class, max(score) AS score FROM s GROUP BY ALL), k AS (SELECT *, lag(class) OVER (PARTITION BY line ORDER BY step) AS last FROM b),
g AS (SELECT line, string_agg(substr('HELO', CAST(class AS INT), 1), '' ORDER BY step) AS text, avg(score) AS c FROM k WHERE class <> 0 AND class IS DISTINCT FROM last GROUP BY 1)
SELECT line, text, CAST(floor(c * 1000000 + 0.5) AS BIGINT) AS confidence FROM g WHERE c > 0.5""")
def _ctc_decode(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("step"), "l_partkey", "l_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class"))
    score = ((F.col("l_partkey") * (F.col("class") + 3) + F.col("l_suppkey") * F.col("class") * 7) % 101).cast("double") / 100
    return decoded(rows.select("line", "step", "class", score.alias("score")), "HELO").select("line", "text", F.floor(F.col("confidence") * 1000000 + 0.5).alias("confidence"))


@query("reading_order", """
WITH b AS (SELECT *, CASE WHEN box_id % 3 > 0 THEN box_id % 3 END AS region, y0 + y1 AS y, x0 + x1 AS x FROM boxes), t AS (SELECT *, CASE WHEN region IS NOT NULL THEN min(y) OVER (PARTITION BY image_id, region) END AS top FROM b)
SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY region IS NULL, top, region, y, x, box_id) AS INT) AS place FROM t""", "boxes")
def _reading_order(t):
    return reading_order(t.boxes.withColumn("region", F.when(F.col("box_id") % 3 > 0, F.col("box_id") % 3)))


@query("merge_fragments")
def _merge_fragments(t):
    return merged_fragments(t.boxes)


@query("evict_oldest", """
WITH c AS (SELECT chapter AS id, page_index AS kind, cached_at AS created_at FROM cached_pages), n AS (SELECT count(*) AS n FROM c), o AS (SELECT id, row_number() OVER (ORDER BY created_at, id, kind) AS place FROM c),
g AS (SELECT DISTINCT id FROM o, n WHERE place <= n - (n * 9) // 10 + ((n * 9) // 10) // 10) SELECT id, kind, created_at FROM c WHERE id NOT IN (SELECT id FROM g)""", "cached_pages")
def _evict_oldest(t):
    cache = t.cached_pages.select(F.col("chapter").alias("id"), F.col("page_index").alias("kind"), F.col("cached_at").alias("created_at"))
    return evicted(cache, cache.count() * 9 // 10)
