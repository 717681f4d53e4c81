"""Row filters over assets and what belongs to them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import query

#: Endings of videos, and the class scores of an asset.
VIDEO = (".mp4", ".webm")
SCORES = ("safe_score", "hentai_score", "porn_score", "sexy_score", "drawing_score")
PARSED_FIELDS = ("artist", "pixiv_id", "twitter_id", "match_type", "extracted_tags", "raw_matched")


def live(assets: DataFrame, favorites: bool = False, missing: bool = False) -> DataFrame:
    """Assets that are neither deleted nor (unless ``missing``) missing."""
    keep = ~F.col("is_deleted")
    if not missing:
        keep &= ~F.col("is_missing")
    return assets.where(keep & F.col("favorite") if favorites else keep)


def is_video(path: Column) -> Column:
    return reduce(or_, (F.lower(path).endswith(x) for x in VIDEO))


def media_kind(assets: DataFrame, kind: str) -> DataFrame:
    """``video``, ``image`` (all that is no video), or everything for another kind."""
    video = is_video(F.col("path"))
    return assets.where(video) if kind == "video" else assets.where(~video) if kind == "image" else assets


def filename_contains(assets: DataFrame, text: str) -> DataFrame:
    """Path contains ``text``, whatever its case; % and _ in it stay wildcards."""
    return assets.where(F.col("path").ilike(f"%{text}%"))


def split_terms(text: str) -> list[str]:
    """Split at blanks; double quotes keep blanks together."""
    out, word, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c == " " and not quoted:
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in (*out, word) if w]


def parsed_terms(parsed: DataFrame, text: str, match_type: str | None = None) -> DataFrame:
    """Rows that match all terms: ``field:value`` in the extracted tags, a plain term in any field."""
    tests = []
    for term in split_terms(text):
        field, colon, value = term.partition(":")
        if colon:
            if value:
                tests.append(F.col("extracted_tags").ilike(f"%{field}:{value}%"))
        else:
            tests.append(reduce(or_, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in PARSED_FIELDS)))
    if match_type:
        tests.append(F.col("match_type") == match_type)
    return parsed.where(reduce(and_, tests)) if tests else parsed


def normal_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(" "))


def with_tags(asset_tags: DataFrame, tags: DataFrame, names: list[str], source_id: int) -> DataFrame:
    """``image_id`` of assets that have all of the named tags from one source."""
    wanted = sorted({n.strip().lower().replace("_", " ") for n in names if n.strip()})
    ids = tags.withColumn("name", normal_name(F.col("name"))).where(F.col("name").isin(wanted)).select(F.col("id").alias("tag_id"), "name")
    held = asset_tags.where((F.col("source_id") == source_id) & ~F.col("is_deleted")).join(ids, "tag_id")
    return held.groupBy("image_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(wanted)).select("image_id")


def unclassified(assets: DataFrame, scores: tuple[str, ...] = SCORES, folder_id: int | None = None) -> DataFrame:
    """Live assets that lack a class score, with the path to decode; of one folder those that lack the first score."""
    if folder_id is not None:
        assets, scores = assets.where(F.col("folder_id") == folder_id), scores[:1]
    lacking = reduce(or_, (F.col(c).isNull() for c in scores))
    frame = F.col("frame_path") if "frame_path" in assets.columns else F.lit(None).cast("string")
    return live(assets).where(lacking).select("id", F.coalesce(frame, "path").alias("decode_path"))


def needs_metadata(assets: DataFrame, animations: DataFrame, videos: DataFrame) -> DataFrame:
    """Live assets without size, animated ones without animation row, videos without video row."""
    a = animations.select(F.col("image_id").alias("id"), F.lit(True).alias("has_animation"))
    v = videos.select(F.col("image_id").alias("id"), F.lit(True).alias("has_video"))
    rows = live(assets, missing=True).join(a, "id", "left").join(v, "id", "left")
    lacks = F.col("width").isNull() | (F.lower("path").endswith(".gif") & F.col("has_animation").isNull()) | (is_video(F.col("path")) & F.col("has_video").isNull())
    return rows.where(lacks).select("id", "path")


def reconcile_missing(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """``(id, is_missing)`` of live assets whose flag differs from what the file listing says."""
    found = listing.select("path").distinct().withColumn("found", F.lit(True))
    rows = assets.where(~F.col("is_deleted")).join(found, "path", "left")
    now = F.col("found").isNull()
    return rows.where(now != F.col("is_missing")).select("id", now.alias("is_missing"))


def unsafe(assets: DataFrame, scores: tuple[str, ...], required: tuple[str, ...], threshold: float = 0.91) -> DataFrame:
    """Sum of the given scores reaches the threshold, and the required ones are set."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in scores))
    return assets.where(reduce(and_, (F.col(c).isNotNull() for c in required)) & (total >= threshold))


def blocked(items: DataFrame, blacklist: DataFrame) -> DataFrame:
    """``(item, matched)`` of items that have a tag of the blacklist (name, any case, trimmed)."""
    names = blacklist.select(F.trim(F.lower("name")).alias("key")).distinct()
    hits = items.withColumn("key", F.trim(F.lower("tag"))).join(names, "key")
    return hits.groupBy("item").agg(F.concat_ws(",", F.array_sort(F.collect_set("key"))).alias("matched"))


@query("live_count", "SELECT count(*) AS n, count(*) FILTER (WHERE favorite) AS favorites FROM assets WHERE NOT is_deleted AND NOT is_missing", "assets")
def _live_count(t):
    return live(t.assets).agg(F.count("*").alias("n"), F.count_if("favorite").alias("favorites"))


@query("media_kind", "SELECT id, path FROM assets WHERE NOT is_deleted AND NOT is_missing AND (lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.webm')", "assets")
def _media_kind(t):
    return media_kind(live(t.assets), "video").select("id", "path")


@query("filename_contains", "SELECT id, path FROM assets WHERE NOT is_deleted AND NOT is_missing AND path ILIKE '%Some_Show%'", "assets")
def _filename_contains(t):
    return filename_contains(live(t.assets), "some_show").select("id", "path")


@query("has_ocr", "SELECT DISTINCT image_id FROM text_lines WHERE image_id IN (SELECT id FROM assets)", "assets text_lines")
def _has_ocr(t):
    return t.assets.select(F.col("id").alias("image_id")).join(t.text_lines, "image_id", "left_semi")


@query("tags_all", """
WITH w AS (SELECT id, replace(lower(name), '_', ' ') AS name FROM tags WHERE category IN ('meta', 'user')),
top AS (SELECT name FROM w JOIN asset_tags a ON a.tag_id = w.id AND source_id = 1 AND NOT is_deleted GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)
SELECT DISTINCT image_id FROM asset_tags a JOIN w ON a.tag_id = w.id WHERE source_id = 1 AND NOT is_deleted AND name IN (SELECT name FROM top)""", "tags asset_tags")
def _tags_all(t):
    few = t.tags.where("category IN ('meta', 'user')")
    held = t.asset_tags.where("source_id = 1 AND NOT is_deleted").join(few, F.col("tag_id") == F.col("id"))
    name = held.groupBy(normal_name(F.col("name")).alias("name")).count().orderBy(F.desc("count"), "name").first()
    return with_tags(t.asset_tags, few, [name.name if name else ""], 1)


@query("images_by_identity", "SELECT identity_id, count(*) AS n, min(image_id) AS first_image, max(image_id) AS last_image FROM (SELECT DISTINCT identity_id, image_id FROM detections WHERE identity_id IS NOT NULL) GROUP BY 1", "detections")
def _images_by_identity(t):
    held = t.detections.where("identity_id IS NOT NULL").groupBy("identity_id")
    return held.agg(F.countDistinct("image_id").alias("n"), F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"))


@query("unclassified", "SELECT id, path AS decode_path FROM assets WHERE NOT is_deleted AND NOT is_missing AND (safe_score IS NULL OR explicit_score IS NULL OR id % 23 = 0 OR id % 29 = 0 OR id % 31 = 0)", "assets")
def _unclassified(t):
    lacks = lambda k: F.when(F.col("id") % k != 0, 0.5)
    return unclassified(t.assets.withColumns({"hentai_score": F.col("explicit_score"), "porn_score": lacks(23), "sexy_score": lacks(29), "drawing_score": lacks(31)}))


@query("needs_metadata", """
SELECT id, path FROM assets WHERE NOT is_deleted AND (id % 11 = 0 OR (lower(path) LIKE '%.gif' AND id % 3 <> 0)
 OR ((lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.webm') AND id % 2 <> 0))""", "assets")
def _needs_metadata(t):
    a = t.assets.withColumn("width", F.when(F.col("id") % 11 != 0, F.lit(640)))
    return needs_metadata(a, t.assets.where("id % 3 = 0").select(F.col("id").alias("image_id")), t.assets.where("id % 2 = 0").select(F.col("id").alias("image_id")))


@query("reconcile_missing", "WITH f AS (SELECT DISTINCT path FROM assets WHERE id % 19 <> 0) SELECT id, path NOT IN (SELECT path FROM f) AS is_missing FROM assets WHERE NOT is_deleted AND (path NOT IN (SELECT path FROM f)) <> is_missing", "assets")
def _reconcile_missing(t):
    return reconcile_missing(t.assets, t.assets.where("id % 19 <> 0").select("path").distinct())


@query("nsfw_flag", "SELECT id FROM assets WHERE safe_score IS NOT NULL AND explicit_score IS NOT NULL AND explicit_score >= 0.91", "assets")
def _nsfw_flag(t):
    return unsafe(t.assets, ("explicit_score",), ("safe_score", "explicit_score")).select("id")


@query("blacklist_check", """
WITH b AS (SELECT DISTINCT trim(lower(name)) AS key FROM tags WHERE id % 50 = 0)
SELECT image_id AS item, string_agg(key, ',' ORDER BY key) AS matched FROM (SELECT DISTINCT image_id, key FROM asset_tags a JOIN tags t ON a.tag_id = t.id JOIN b ON b.key = trim(lower(t.name))) GROUP BY 1""", "tags asset_tags")
def _blacklist_check(t):
    items = t.asset_tags.join(t.tags, F.col("tag_id") == F.col("id")).select(F.col("image_id").alias("item"), F.upper("name").alias("tag"))
    return blocked(items, t.tags.where("id % 50 = 0"))


@query("history_search", "SELECT event_id, item, read_at FROM history WHERE item ILIKE '%URCH%' OR CAST(event_id AS VARCHAR) LIKE '%77%' ORDER BY read_at DESC, event_id DESC LIMIT 100", "history")
def _history_search(t):
    hit = F.col("item").ilike("%urch%") | F.col("event_id").cast("string").contains("77")
    return t.history.where(hit).orderBy(F.desc("read_at"), F.desc("event_id")).limit(100).select("event_id", "item", "read_at")
