"""Sorted pages, samples and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import query
from .filters import live
from .stats import identity_counts

#: A name given to an identity that nobody has named yet.
PLACEHOLDER = r"^Character (\d+)$"


def gallery_page(assets: DataFrame, limit: int, offset: int = 0, favorites: bool = False) -> DataFrame:
    """Live assets, newest first; nothing beyond the end."""
    return live(assets, favorites).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def featured(assets: DataFrame) -> DataFrame:
    """One live asset: favorites first, then the newest."""
    return live(assets).orderBy(F.desc("favorite"), F.desc("created_at"), F.desc("id")).limit(1)


def sample(assets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n live assets at random, by a hash of id and seed: the same for every partitioning."""
    return live(assets).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def suggest_tags(tags: DataFrame, text: str, category: str = "character", limit: int = 30) -> DataFrame:
    return tags.where((F.col("category") == category) & F.col("name").ilike(f"%{text}%")).orderBy("name", "id").limit(limit)


def merged_suggestions(tags: DataFrame, identities: DataFrame) -> DataFrame:
    """Tag hits and identity hits ``(name, n)`` by name, tags first; placeholders last, then by count."""
    both = tags.select("name", "n", F.lit(0).alias("kind")).unionByName(identities.select("name", "n", F.lit(1).alias("kind")))
    first = F.row_number().over(Window.partitionBy("name").orderBy("kind", F.desc("n")))
    rows = both.withColumn("k", first).where("k = 1").drop("k")
    return rows.orderBy(F.col("name").rlike(PLACEHOLDER), F.desc("n"), "name")


def identity_order(identities: DataFrame) -> DataFrame:
    """Named identities by name, then placeholders by number."""
    number = F.regexp_extract("name", PLACEHOLDER, 1)
    waits = number != ""
    return identities.orderBy(waits, F.when(waits, number.cast("long")), F.lower("name"), "identity_id")


def clamped_page(rows: DataFrame, page: int, size: int, *order) -> tuple[DataFrame, int, int, int]:
    """A page's rows, the page number within [1, number of pages], the number of pages and of rows."""
    total = rows.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), page, pages, total


def named_identities(t) -> DataFrame:
    name = F.when(F.col("identity_id") % 3 == 0, F.concat(F.lit("Character "), F.col("identity_id").cast("string"))).otherwise(F.concat(F.lit("Name"), (F.lit(100) - F.col("identity_id")).cast("string")))
    ids = t.detections.select("identity_id").where("identity_id IS NOT NULL").distinct()
    return identity_counts(ids, t.detections).withColumn("name", name)


NAMED = "SELECT identity_id, CASE WHEN identity_id % 3 = 0 THEN 'Character ' || identity_id ELSE 'Name' || (100 - identity_id) END AS name, count(*) AS n FROM detections WHERE identity_id IS NOT NULL GROUP BY 1"


@query("gallery_page", "SELECT id, created_at FROM assets WHERE NOT is_deleted AND NOT is_missing ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 1000", "assets")
def _gallery_page(t):
    return gallery_page(t.assets, 200, 1000).select("id", "created_at")


@query("featured", "SELECT id, favorite, created_at FROM assets WHERE NOT is_deleted AND NOT is_missing ORDER BY favorite DESC, created_at DESC, id DESC LIMIT 1", "assets")
def _featured(t):
    return featured(t.assets).select("id", "favorite", "created_at")


@query("random_sample")
def _random_sample(t):
    return sample(t.assets, 100).select("id")


@query("suggest_tags", "SELECT id, name FROM tags WHERE category = 'character' AND name ILIKE '%re%' ORDER BY name, id LIMIT 30", "tags")
def _suggest_tags(t):
    return suggest_tags(t.tags, "re").select("id", "name")


SUGGESTIONS = f"WITH i AS ({NAMED}), g AS (SELECT CASE WHEN tag_id % 90 < 10 THEN 'Name' || (100 - tag_id % 90) ELSE 'tag' || tag_id END AS name, count(*) AS n FROM asset_tags GROUP BY 1), u AS (SELECT name, n, 0 AS kind FROM g UNION ALL SELECT name, n, 1 FROM i) SELECT name, n, kind, CAST(row_number() OVER (ORDER BY regexp_full_match(name, 'Character \\d+'), n DESC, name) AS INT) AS place FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind, n DESC) = 1)"


@query("suggest_merged", SUGGESTIONS, "detections asset_tags")
@query("suggest_merged_all", SUGGESTIONS, "detections asset_tags")
def _suggest_merged(t):
    from .changes import numbered

    name = F.when(F.col("tag_id") % 90 < 10, F.concat(F.lit("Name"), (F.lit(100) - F.col("tag_id") % 90).cast("string"))).otherwise(F.concat(F.lit("tag"), F.col("tag_id").cast("string")))
    tags = t.asset_tags.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    rows = merged_suggestions(tags, named_identities(t)).withColumns({"waits": F.col("name").rlike(PLACEHOLDER), "less": -F.col("n")})
    return numbered(rows, ["waits", "less", "name"], name="place").select("name", "n", "kind", F.col("place").cast("int").alias("place"))


@query("identity_order", f"WITH i AS ({NAMED}) SELECT identity_id, name, n FROM i", "detections")
def _identity_order(t):
    return identity_order(named_identities(t)).select("identity_id", "name", "n")


@query("clamped_page", "WITH n AS (SELECT count(*) AS total FROM history) SELECT event_id, item, CAST(ceil(total / 300.0) AS INT) AS page, total FROM history, n ORDER BY read_at DESC, event_id DESC LIMIT 300 OFFSET (SELECT CAST((ceil(count(*) / 300.0) - 1) * 300 AS BIGINT) FROM history)", "history")
def _clamped_page(t):
    rows, page, _, total = clamped_page(t.history, 10**6, 300, F.desc("read_at"), F.desc("event_id"))
    return rows.select("event_id", "item", F.lit(page).alias("page"), F.lit(total).cast("long").alias("total"))


@query("preview_parse", r"WITH n AS (SELECT id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM assets WHERE NOT is_deleted AND NOT is_missing ORDER BY id DESC LIMIT 50) SELECT id, stem, nullif(coalesce(nullif(regexp_extract(stem, 'illust_(\d+)', 1), ''), regexp_extract(stem, '^artist_name_(\d{8})_p\d$', 1)), '') AS pixiv_id FROM n", "assets")
def _preview_parse(t):
    from ..functions.names import parse_pixiv, stem

    newest = live(t.assets).orderBy(F.desc("id")).limit(50).withColumn("stem", stem(F.col("path")))
    return newest.select("id", "stem", parse_pixiv(F.col("stem"))["pixiv_id"].alias("pixiv_id"))
