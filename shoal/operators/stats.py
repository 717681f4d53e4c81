"""Library statistics: grouped counts, overlaps and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from ..sources.views import query
from .filters import is_video, live
from .graph import connected
from .numbering import numbered

#: Which extensions a storage category has.
CATEGORIES = {"Images": ("png", "jpg", "jpeg", "webp", "bmp", "tiff"), "GIFs": ("gif",), "Videos": ("mp4", "webm")}


def tag_statistics(asset_tags: DataFrame, tags: DataFrame, source_id: int, distinct_images: bool = False) -> DataFrame:
    """Rows a tag has from one source (or distinct images), counted before the join with names."""
    rows = asset_tags.where((F.col("source_id") == source_id) & ~F.col("is_deleted"))
    count = F.countDistinct("image_id") if distinct_images else F.count("*")
    return rows.groupBy("tag_id").agg(count.alias("n")).join(tags, F.col("tag_id") == F.col("id")).select("tag_id", "name", "category", "n")


def identity_counts(identities: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of each identity, 0 included."""
    n = detections.where("identity_id IS NOT NULL").groupBy("identity_id").agg(F.count("*").alias("n"))
    return identities.join(n, "identity_id", "left").select("identity_id", F.coalesce("n", F.lit(0)).alias("n"))


def folder_summary(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of each folder's live assets by kind, vector state and classification, and of missing ones."""
    states = vectors.groupBy("image_id").agg(F.bool_or(F.col("state") == "ready").alias("ready"), F.bool_or(F.col("state").isin("pending", "preprocessing")).alias("pending"))
    rows = live(assets, missing=True).join(states.withColumnRenamed("image_id", "id"), "id", "left")
    video, here = is_video(F.col("path")), ~F.col("is_missing")
    return rows.groupBy("folder_id").agg(
        F.count_if(here & ~video).alias("image_count"), F.count_if(here & video).alias("video_count"),
        F.count_if(here & F.coalesce("ready", F.lit(False))).alias("vector_ready"), F.count_if(here & F.coalesce("pending", F.lit(False))).alias("vector_pending"),
        F.count_if(here & F.col("safe_score").isNotNull()).alias("safety_classified"), F.count_if(here & F.col("safe_score").isNull()).alias("safety_pending"),
        F.count_if(~here & ~video).alias("missing_images"), F.count_if(~here & video).alias("missing_videos"),
    )


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part, or ``unknown``."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"[^/\\.]\.([^./\\]+)$", 1)), F.lit("")), F.lit("unknown"))


def storage_stats(assets: DataFrame) -> DataFrame:
    """Live files and bytes by extension, with the category's share of all bytes."""
    ext = F.col("ext")
    category = F.lit("Other")
    for name, own in CATEGORIES.items():
        category = F.when(ext.isin(*own), name).otherwise(category)
    rows = live(assets).groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).withColumn("category", category)
    return rows.withColumn("category_bytes", F.sum("bytes").over(Window.partitionBy("category")))  # a row an extension


def status_counters(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: live assets, and vectors by state. Both sides are aggregates of one row."""
    a = live(assets).agg(F.count("*").alias("live"))
    v = vectors.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("ready", "pending", "preprocessing")])
    return a.join(F.broadcast(v), F.lit(True))


def text_of_images(lines: DataFrame) -> DataFrame:
    """An image's text lines in order of their id."""
    parts = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("lines"))
    return parts.select("image_id", F.concat_ws("\n", F.col("lines.text")).alias("text"))


def overlap_candidates(held: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """``(small, large)``: folder pairs that may share more than ``share`` of the smaller one's ``size``.

    ``held(folder, content_key)`` has distinct rows, ``sizes(folder, size)`` what a share is of. A folder's contents are
    ordered by how few folders hold them. To share ``least`` contents, two folders must meet in one of the
    first ``n - least + 1`` of each, so the smaller folder's commonest contents look for no partner, and a
    content of very many folders makes pairs only where it is among the rarest of one. Both folders' size
    and the places of the content they meet in bound what they can still share.
    """
    common = held.groupBy("content_key").agg(F.count("*").alias("folders")).where("folders > 1")
    all_of = held.groupBy("folder").agg(F.count("*").alias("n")).join(sizes, "folder")
    least = F.greatest(F.floor(F.col("size") * share - 1e-6) + 1, F.lit(1))
    # places come from one sorted numbering, so that a folder with very many contents isn't one task's
    placed, _ = written(numbered(held.join(common, "content_key").select("folder", "folders", "content_key"), ["folder", "folders", "content_key"], name="k").select("folder", "content_key", "k"), "placed")
    own = placed.groupBy("folder").agg(F.max("k").alias("last"))
    rows = placed.join(own.join(all_of, "folder"), "folder").select("folder", "content_key", "size", "n", least.alias("least"), (F.col("last") - F.col("k") + 1).alias("rest"))
    rows, _ = written(rows, "ranked")  # rest: how many contents a folder has from this one on
    small = rows.where("rest >= least").select("content_key", F.struct("size", F.col("folder").alias("id")).alias("s"), "least", F.col("rest").alias("s_rest"))
    large = rows.select("content_key", F.struct("size", F.col("folder").alias("id")).alias("l"), F.col("rest").alias("l_rest"))
    met = small.join(large, "content_key").where("s < l AND l_rest >= least")
    return met.select(F.col("s.id").alias("small"), F.col("l.id").alias("large")).distinct()


def folder_overlap(assets: DataFrame, share: float = 0.5) -> DataFrame:
    """``(a, b, shared, smaller)``: folder pairs whose distinct common contents exceed a share of the smaller one."""
    held, _ = written(live(assets).where("content_key IS NOT NULL").select(F.col("folder_id").alias("folder"), "content_key").distinct(), "held")
    sizes = live(assets).groupBy(F.col("folder_id").alias("folder")).agg(F.count("*").alias("size"))
    pairs, _ = written(overlap_candidates(held, sizes, share), "candidates")
    both = pairs.join(held.withColumnRenamed("folder", "small"), "small").join(held.withColumnRenamed("folder", "large"), ["large", "content_key"], "left_semi")
    shared = both.groupBy("small", "large").agg(F.count("*").alias("shared")).join(sizes.withColumnsRenamed({"folder": "small", "size": "smaller"}), "small")
    return shared.where(F.col("shared") / F.col("smaller") > share).select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), "shared", "smaller")


def duplicate_folder_groups(assets: DataFrame, share: float = 0.5) -> DataFrame:
    """Folders connected by overlaps: group (least folder), its most shared pair, and each folder's share of pair counts."""
    edges = folder_overlap(assets, share)
    labels = connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "shared")
    own = ends.groupBy("node").agg(F.sum("shared").alias("total"), F.max("shared").alias("most"))
    rows = labels.join(own, "node")
    group = rows.groupBy("label").agg(F.max("most").alias("group_shared"))
    return rows.join(group, "label").select(F.col("label").alias("group_id"), F.col("node").alias("folder_id"), F.floor((F.col("total") + 1) / 2).alias("overlap"), "group_shared")


def cache_overview(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.countDistinct("chapter").alias("chapters"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


def series_rollup(pages: DataFrame, progress: DataFrame, history: DataFrame) -> DataFrame:
    """Cached pages to chapters to series; a chapter's series is what progress says, else history, else itself."""
    chapters = pages.groupBy("chapter").agg(F.count("*").alias("pages"), F.sum("size_bytes").alias("bytes"), F.max("cached_at").alias("cached_at"))
    p = progress.groupBy("chapter").agg(F.max("series").alias("p_series"))
    h = history.groupBy("chapter").agg(F.max("series").alias("h_series"))
    rows = chapters.join(p, "chapter", "left").join(h, "chapter", "left")
    known = F.coalesce("p_series", "h_series")
    series = rows.withColumns({"series": F.coalesce(known, "chapter"), "standalone": known.isNull()})
    return series.groupBy("series", "standalone").agg(F.count("*").alias("chapters"), F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"), F.max("cached_at").alias("cached_at"))


def fully_cached(pages: DataFrame, metadata: DataFrame, progress: DataFrame) -> DataFrame:
    """Chapters with as many cached pages as expected: the length of their JSON page list, else the reader's total, else any."""
    n = pages.groupBy("chapter").agg(F.count("*").alias("n"))
    listed = metadata.select("chapter", F.nullif(F.size(F.from_json("pages_json", "array<string>")), F.lit(-1)).alias("listed"))
    total = progress.groupBy("chapter").agg(F.max("page_total").alias("total"))
    rows = n.join(listed, "chapter", "left").join(total, "chapter", "left")
    expected = F.coalesce(F.nullif("listed", F.lit(0)), F.nullif("total", F.lit(0)))
    return rows.withColumn("expected", expected.cast("long")).where("n >= coalesce(expected, 1)").select("chapter", "n", "expected")


def directory_sizes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes and files below each wanted directory, 0 where there are none: files meet their ancestors by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = files.where(F.size(parts) > 1).select(F.explode(above).alias("dir"), "size_bytes")
    sums = held.join(wanted.select("dir").distinct(), "dir", "left_semi").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return wanted.select("dir").distinct().join(sums, "dir", "left").select("dir", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def run_summary(wanted: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Outcome counts of a batch: processed, failed (no output), skipped (already there)."""
    rows = wanted.join(done, "image_id", "left")
    outcome = F.when(F.lit(not force) & F.col("already"), "skipped").when(F.col("n_out").isNull(), "failed").otherwise("processed")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


VECTORS = "SELECT id AS image_id, CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'preprocessing' WHEN 2 THEN 'failed' ELSE 'ready' END AS state FROM assets WHERE id % 7 <> 0"


def vectors(t) -> DataFrame:
    """Vector states derived from assets."""
    state = F.when(F.col("id") % 5 == 0, "pending").when(F.col("id") % 5 == 1, "preprocessing").when(F.col("id") % 5 == 2, "failed").otherwise("ready")
    return t.assets.where("id % 7 <> 0").select(F.col("id").alias("image_id"), state.alias("state"))


@query("tag_statistics", "SELECT tag_id, name, category, count(*) AS n FROM asset_tags a JOIN tags t ON a.tag_id = t.id WHERE source_id = 1 AND NOT is_deleted GROUP BY ALL", "asset_tags tags")
def _tag_statistics(t):
    return tag_statistics(t.asset_tags, t.tags, 1)


@query("identity_counts", "WITH i AS (SELECT DISTINCT label AS identity_id FROM embeddings UNION SELECT 999) SELECT i.identity_id, count(d.id) AS n FROM i LEFT JOIN detections d ON d.identity_id = i.identity_id GROUP BY 1", "detections")
def _identity_counts(t):
    ids = t.embeddings.select(F.col("label").alias("identity_id")).union(t.sql("SELECT 999 FROM embeddings")).distinct()
    return identity_counts(ids, t.detections)


@query("folder_summary", f"""
WITH v AS ({VECTORS}), a AS (SELECT assets.*, state, (lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.webm') AS video FROM assets LEFT JOIN v ON v.image_id = id WHERE NOT is_deleted)
SELECT folder_id, count(*) FILTER (WHERE NOT is_missing AND NOT video) AS image_count, count(*) FILTER (WHERE NOT is_missing AND video) AS video_count,
 count(*) FILTER (WHERE NOT is_missing AND state = 'ready') AS vector_ready, count(*) FILTER (WHERE NOT is_missing AND state IN ('pending', 'preprocessing')) AS vector_pending,
 count(*) FILTER (WHERE NOT is_missing AND safe_score IS NOT NULL) AS safety_classified, count(*) FILTER (WHERE NOT is_missing AND safe_score IS NULL) AS safety_pending,
 count(*) FILTER (WHERE is_missing AND NOT video) AS missing_images, count(*) FILTER (WHERE is_missing AND video) AS missing_videos FROM a GROUP BY 1""", "assets")
def _folder_summary(t):
    return folder_summary(t.assets, vectors(t))


@query("storage_stats", """
WITH e AS (SELECT coalesce(nullif(lower(regexp_extract(path, '[^/\\\\.]\\.([^./\\\\]+)$', 1)), ''), 'unknown') AS ext, size_bytes FROM assets WHERE NOT is_deleted AND NOT is_missing),
g AS (SELECT ext, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, CASE WHEN ext IN ('png','jpg','jpeg','webp','bmp','tiff') THEN 'Images' WHEN ext = 'gif' THEN 'GIFs' WHEN ext IN ('mp4','webm') THEN 'Videos' ELSE 'Other' END AS category FROM e GROUP BY 1)
SELECT *, CAST(sum(bytes) OVER (PARTITION BY category) AS BIGINT) AS category_bytes FROM g""", "assets")
def _storage_stats(t):
    return storage_stats(t.assets)


@query("status_counters", f"""
WITH v AS ({VECTORS}) SELECT (SELECT count(*) FROM assets WHERE NOT is_deleted AND NOT is_missing) AS live, count(*) FILTER (WHERE state = 'ready') AS ready,
 count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'preprocessing') AS preprocessing FROM v""", "assets")
def _status_counters(t):
    return status_counters(t.assets, vectors(t))


@query("ocr_text", "SELECT image_id, string_agg(text, chr(10) ORDER BY id) AS text FROM text_lines GROUP BY 1", "text_lines")
def _ocr_text(t):
    return text_of_images(t.text_lines)


OVERLAP = """WITH h AS (SELECT DISTINCT folder_id AS f, content_key AS c FROM assets WHERE NOT is_deleted AND NOT is_missing), s AS (SELECT folder_id AS f, count(*) AS n FROM assets WHERE NOT is_deleted AND NOT is_missing GROUP BY 1),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS shared FROM h x JOIN h y ON x.c = y.c AND x.f < y.f GROUP BY ALL),
e AS (SELECT a, b, shared, least(s1.n, s2.n) AS smaller FROM p JOIN s s1 ON s1.f = a JOIN s s2 ON s2.f = b WHERE shared / least(s1.n, s2.n) > 0.5)"""


@query("folder_overlap", OVERLAP + " SELECT * FROM e", "assets")
def _folder_overlap(t):
    return folder_overlap(t.assets)


@query("duplicate_folder_groups", OVERLAP.replace("WITH h", "WITH RECURSIVE h", 1) + """, u AS (SELECT a AS x, b AS y, shared FROM e UNION ALL SELECT b, a, shared FROM e),
r(x, y) AS (SELECT x, x FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y), l AS (SELECT x, min(y) AS label FROM r GROUP BY 1),
n AS (SELECT x, CAST(sum(shared) AS BIGINT) AS total, max(shared) AS most FROM u GROUP BY 1)
SELECT label AS group_id, l.x AS folder_id, CAST(floor((total + 1) / 2) AS BIGINT) AS overlap, max(most) OVER (PARTITION BY label) AS group_shared FROM l JOIN n USING (x)""", "assets")
def _duplicate_folder_groups(t):
    return duplicate_folder_groups(t.assets)


@query("cache_overview", "SELECT count(*) AS pages, count(DISTINCT chapter) AS chapters, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM cached_pages", "cached_pages")
def _cache_overview(t):
    return cache_overview(t.cached_pages)


@query("series_rollup", """
WITH h AS (SELECT o_orderkey AS chapter, max(-o_custkey) AS series FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), p AS (SELECT chapter, max(series) AS series FROM progress GROUP BY 1),
c AS (SELECT chapter, count(*) AS pages, sum(size_bytes) AS bytes, max(cached_at) AS cached_at FROM cached_pages GROUP BY 1)
SELECT coalesce(p.series, h.series, c.chapter) AS series, coalesce(p.series, h.series) IS NULL AS standalone, count(*) AS chapters, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes, max(cached_at) AS cached_at
FROM c LEFT JOIN p USING (chapter) LEFT JOIN h USING (chapter) GROUP BY ALL""", "cached_pages progress")
def _series_rollup(t):
    read = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("chapter"), (-F.col("o_custkey")).alias("series"))
    return series_rollup(t.cached_pages, t.progress, read)


@query("fully_cached", """
WITH n AS (SELECT chapter, count(*) AS n FROM cached_pages GROUP BY 1), m AS (SELECT o_orderkey AS chapter, o_orderkey % 4 AS listed FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT chapter, max(page_total) AS total FROM progress GROUP BY 1)
SELECT chapter, n, CAST(coalesce(nullif(listed, 0), nullif(total, 0)) AS BIGINT) AS expected FROM n LEFT JOIN m USING (chapter) LEFT JOIN p USING (chapter) WHERE n >= coalesce(nullif(listed, 0), nullif(total, 0), 1)""", "cached_pages progress")
def _fully_cached(t):
    k = (F.col("o_orderkey") % 4).cast("int")
    pages = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"p"'), k), ","), F.lit("]"))
    return fully_cached(t.cached_pages, t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("chapter"), pages.alias("pages_json")), t.progress)


@query("dir_sizes", """
WITH w AS (SELECT DISTINCT '/lib/f' || (id % 50) AS dir FROM assets UNION SELECT '/lib' FROM assets)
SELECT dir, count(path) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM w LEFT JOIN assets ON starts_with(path, dir || '/') GROUP BY 1""", "assets")
def _dir_sizes(t):
    wanted = t.assets.select(F.concat(F.lit("/lib/f"), (F.col("id") % 50).cast("string")).alias("dir")).union(t.assets.select(F.lit("/lib")))
    return directory_sizes(t.assets, wanted)


@query("run_summary", "WITH d AS (SELECT l_orderkey AS image_id, count(*) AS n_out FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1) SELECT CASE WHEN id % 4 = 0 THEN 'skipped' WHEN n_out IS NULL THEN 'failed' ELSE 'processed' END AS outcome, count(*) AS n FROM assets LEFT JOIN d ON d.image_id = id GROUP BY 1", "assets")
def _run_summary(t):
    done = t.lineitem.where("l_orderkey % 9 <> 0").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("n_out"))
    return run_summary(t.assets.select(F.col("id").alias("image_id"), (F.col("id") % 4 == 0).alias("already")), done)
