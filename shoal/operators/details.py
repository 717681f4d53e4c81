"""Assets with everything that belongs to them: each satellite is one row an asset before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from ..sources.views import query

#: Ids of assets that are sent to all tasks.
MOST_IDS = 100_000
#: Order of tag categories in an asset's view and in a tagger's output.
VIEW_ORDER = {"character": 1, "copyright": 2, "meta": 3}
TAGGER_ORDER = {"character": 0, "copyright": 1, "meta": 2}


def resolve_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Source names to ids, null for unknown ones."""
    return rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source", "left")


def view_priority(category: Column, own: Column) -> Column:
    """Own tags first, then by category."""
    out = F.lit(4)
    for name, k in VIEW_ORDER.items():
        out = F.when(category == name, k).otherwise(out)
    return F.when(own, -1).otherwise(out)


def tagger_priority(category: Column) -> Column:
    out = F.lit(3)
    for name, k in TAGGER_ORDER.items():
        out = F.when(category == name, k).otherwise(out)
    return out


def tag_order(asset_tags: DataFrame, tags: DataFrame, own_source: int = 0) -> DataFrame:
    """Each asset's tags numbered in view order: own ones, category, confidence, name."""
    rows = asset_tags.where("NOT is_deleted").join(tags.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id")
    order = Window.partitionBy("image_id").orderBy(view_priority(F.col("category"), F.col("source_id") == own_source), F.desc("confidence"), "tag_id", "source_id", "txn")
    return rows.select("image_id", "tag_id", "source_id", "txn", F.row_number().over(order).alias("place"))


def tag_lists(asset_tags: DataFrame, tags: DataFrame, preferred: int, own: int, hidden: int, blacklisted: bool = False) -> DataFrame:
    """``(image_id, tags[, blacklisted])``: tags of the preferred and own sources in view order, without a hidden source."""
    rows = asset_tags.where(F.col("source_id").isin(preferred, own) & (F.col("source_id") != hidden))
    rows = rows.where(~F.col("is_deleted") | F.col("is_blacklisted") if blacklisted else ~F.col("is_deleted"))
    rows = rows.join(tags.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id")
    entry = F.struct(view_priority(F.col("category"), F.col("source_id") == own).alias("p"), (-F.col("confidence")).alias("c"), F.col("name"))
    lists = [F.array_sort(F.collect_list(F.when(~F.col("is_deleted"), entry))).alias("tags")]
    if blacklisted:
        lists.append(F.array_sort(F.collect_list(F.when(F.col("is_blacklisted"), entry))).alias("blacklisted"))
    out = rows.groupBy("image_id").agg(*lists)
    return out.select("image_id", *[F.col(f"{c}.name").alias(c) for c in out.columns[1:]])


def image_details(assets: DataFrame, asset_tags: DataFrame, tags: DataFrame, vectors: DataFrame, parsed: DataFrame, detections: DataFrame, lines: DataFrame, preferred: int = 1, own: int = 0, hidden: int = 3, blacklisted: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """One row an asset with its tags, vector state, parsed metadata, identities and text.

    With ``ids(id)`` of these assets only: every satellite keeps the rows of wanted assets before it is grouped,
    by a broadcast of the ids while they are at most ``MOST_IDS``, else by a join that shares the grouping's
    partitioning.
    """
    if ids is not None:
        wanted = ids.select(F.col("id").alias("image_id")).where("image_id IS NOT NULL").distinct()
        wanted = written(wanted, "wanted")[0]
        wanted = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
        own_rows = lambda df, key="image_id": df.join(wanted.withColumnRenamed("image_id", key), key, "left_semi")
        assets, asset_tags, vectors, parsed, detections, lines = own_rows(assets, "id"), *map(own_rows, (asset_tags, vectors, parsed, detections, lines))
    found = detections.where("identity_id IS NOT NULL").groupBy("image_id").agg(F.sort_array(F.collect_set("identity_id")).alias("identities"))
    text = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("lines")).select("image_id", F.concat_ws("\n", F.col("lines.text")).alias("ocr_text"))
    out = assets.withColumnRenamed("id", "image_id")
    for satellite in (tag_lists(asset_tags, tags, preferred, own, hidden, blacklisted), vectors, parsed.select("image_id", "artist", "pixiv_id"), found, text):
        out = out.join(satellite, "image_id", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("tags", "blacklisted") if c in out.columns}
    return out.withColumns({**lists, "state": F.coalesce("state", F.lit("unknown")), "identities": F.coalesce("identities", F.array().cast("array<int>"))})


def parsed_rows(t) -> DataFrame:
    """Metadata parsed from all names."""
    from ..functions.names import parsed

    rows = parsed(t.assets, "pixiv_id").withColumnRenamed("id", "image_id")
    return rows.select("image_id", "artist", "pixiv_id", "twitter_id", "match_type", F.to_json("tags").alias("extracted_tags"), F.col("stem").alias("raw_matched"))


PARSED = r"""SELECT id AS image_id, CASE WHEN i = '' THEN nullif(a, '') END AS artist, coalesce(nullif(i, ''), n) AS pixiv_id, stem FROM (SELECT id, stem, regexp_extract(stem, 'illust_(\d+)', 1) AS i,
 regexp_extract(stem, '^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$', 1) AS a, regexp_extract(stem, '^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$', 2) AS n FROM (SELECT id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM assets))
 WHERE (contains(stem, 'illust_') OR regexp_matches(stem, '_p[0-3]')) AND (i <> '' OR n <> '')"""
PRIORITY = "CASE WHEN source_id = 0 THEN -1 WHEN category = 'character' THEN 1 WHEN category = 'copyright' THEN 2 WHEN category = 'meta' THEN 3 ELSE 4 END"


def details_sql(where: str, extra: str = "") -> str:
    from .stats import VECTORS

    shown = "NOT is_deleted OR is_blacklisted" if extra else "NOT is_deleted"
    black = ", count(*) FILTER (WHERE is_blacklisted) AS n_blacklisted" if extra else ""
    return f"""
WITH v AS ({VECTORS}), p AS ({PARSED}), g AS (SELECT image_id, string_agg(name, '|' ORDER BY {PRIORITY}, -confidence, name) FILTER (WHERE NOT is_deleted) AS tags, count(*) FILTER (WHERE NOT is_deleted) AS n_tags{black}
 FROM asset_tags a JOIN tags t ON a.tag_id = t.id WHERE source_id IN (0, 1) AND ({shown}) GROUP BY 1),
d AS (SELECT image_id, string_agg(identity_id, ',' ORDER BY identity_id) AS identities FROM (SELECT DISTINCT image_id, identity_id FROM detections WHERE identity_id IS NOT NULL) GROUP BY 1),
o AS (SELECT image_id, string_agg(text, chr(10) ORDER BY id) AS ocr_text FROM text_lines GROUP BY 1)
SELECT id AS image_id, coalesce(tags, '') AS tags, coalesce(n_tags, 0) AS n_tags{extra}, coalesce(state, 'unknown') AS state, artist, pixiv_id, coalesce(identities, '') AS identities, ocr_text
FROM assets LEFT JOIN g ON g.image_id = id LEFT JOIN v ON v.image_id = id LEFT JOIN p ON p.image_id = id LEFT JOIN d ON d.image_id = id LEFT JOIN o ON o.image_id = id WHERE NOT assets.is_deleted AND {where}"""


def _flat(details: DataFrame, *more: Column) -> DataFrame:
    identities = F.concat_ws(",", F.transform("identities", lambda x: x.cast("string")))
    return details.select("image_id", F.concat_ws("|", "tags").alias("tags"), F.size("tags").cast("long").alias("n_tags"), *more, "state", "artist", "pixiv_id", identities.alias("identities"), "ocr_text")


def _all(t, rows: DataFrame, **options) -> DataFrame:
    from .stats import vectors

    return image_details(rows, t.asset_tags, t.tags, vectors(t), parsed_rows(t), t.detections, t.text_lines, **options)


@query("image_details", details_sql("true"), "assets asset_tags tags detections text_lines")
@query("image_details_all", details_sql("true"), "assets asset_tags tags detections text_lines")
def _image_details(t):
    return _flat(_all(t, t.assets.where("NOT is_deleted")))


@query("image_detail_one", details_sql("id = (SELECT min(id) FROM assets WHERE NOT is_deleted AND id > 100)", ", coalesce(n_blacklisted, 0) AS n_blacklisted"), "assets asset_tags tags detections text_lines")
def _image_detail_one(t):
    one = t.assets.where("NOT is_deleted AND id > 100").agg(F.min("id").alias("id"))
    return _flat(_all(t, t.assets, blacklisted=True, ids=one), F.size("blacklisted").cast("long").alias("n_blacklisted"))


@query("resolve_source", "WITH w AS (SELECT l_linenumber AS k, CASE l_linenumber % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'ai:tagger-a' WHEN 2 THEN 'ai:tagger-b' WHEN 3 THEN 'filename_parser' ELSE 'nobody' END AS source FROM lineitem) SELECT source, id AS source_id, count(*) AS n FROM w LEFT JOIN sources ON name = source GROUP BY ALL", "sources")
def _resolve_source(t):
    name = F.element_at(F.array(*map(F.lit, ("user", "ai:tagger-a", "ai:tagger-b", "filename_parser", "nobody"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return resolve_source(t.lineitem.select(name.alias("source")), t.sources).groupBy("source", "source_id").agg(F.count("*").alias("n"))


@query("tag_order", f"SELECT image_id, tag_id, source_id, txn, CAST(row_number() OVER (PARTITION BY image_id ORDER BY {PRIORITY}, confidence DESC, tag_id, source_id, txn) AS INT) AS place FROM asset_tags a JOIN tags t ON a.tag_id = t.id WHERE NOT is_deleted", "asset_tags tags")
def _tag_order(t):
    return tag_order(t.asset_tags, t.tags)
