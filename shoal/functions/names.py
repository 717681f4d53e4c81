"""Metadata from file names: every rule is one set of expressions over a column of stems."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import query

STRINGS = "array<string>"

#: What the rules look for.
ILLUST = r"illust_(\d+)(?:_(\d{8})_(\d{6}))?"
PAGE = r"^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$"
SNOWFLAKE = r"([a-zA-Z0-9_-]+-\d{18,20})"
MEDIA_KEY = r"(?:media_|status_)?([A-Za-z0-9_-]{15,25})"
BRACKETED = r"^\[([^\]]+)\]\s*(.*?)(?:\s*\(([^)]+)\))?$"
EPISODE = r"(?:[-_\s](?:E(?:P)?|EP|ep)?(\d{1,4})|[-_\s](\d{1,4})[-_\s])"
RESOLUTION = r"(?i)(\d{3,4}p)"
GROUP = r"^\[([^\]]+)\]"
#: What stands before an episode without a leading group in brackets and separators at its end.
TITLE = r"^(?:[^\]]*\]|[^)]*\)|[\[(]*)(.*?)[-_ .]*$"
PAGE_MARKS = ("illust_", "_p0", "_p1", "_p2", "_p3")
#: Digits of an epoch number and how many of them make a second.
EPOCHS = {10: 1, 13: 1_000, 16: 1_000_000}
YEARS = (2003, 2030)
TRACKING = ("fbclid", "gclid", "ref", "referrer", "spm")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def group(name: Column, pattern: str, k: int) -> Column:
    """A group of the first match, null where it has none."""
    return F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))


def some(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts)).cast(STRINGS)


def tagged(key: str, value: Column) -> Column:
    return F.concat(F.lit(key + ":"), value)


def _match(kind: str, found: Column, tags: Column, artist=None, pixiv_id=None, twitter_id=None, epoch=None, iso=None, partial=None) -> Column:
    """What every rule gives; null where it doesn't match."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    row = F.struct(F.lit(kind).alias("match_type"), text(artist).alias("artist"), text(pixiv_id).alias("pixiv_id"), text(twitter_id).alias("twitter_id"), text(epoch).alias("timestamp"), text(iso).alias("datetime_iso"), tags.alias("tags"), (F.lit(False) if partial is None else partial).alias("partial"))
    return F.when(found, row)


def parse_epoch(name: Column) -> Column:
    """The first part of 10, 13 or 16 digits that is a time of plausible year."""
    def seconds(part: Column) -> Column:
        out = F.lit(None).cast("long")
        for digits, unit in EPOCHS.items():
            out = F.when(F.length(part) == digits, F.floor(part.cast("decimal(20,0)") / unit).cast("long")).otherwise(out)
        return out

    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp").cast("long") for y in (YEARS[0], YEARS[1] + 1))
    parts = F.filter(F.split(name, r"[_\- ]"), lambda p: p.rlike(r"^(\d{10}|\d{13}|\d{16})$"))
    hits = F.filter(parts, lambda p: (seconds(p) >= low) & (seconds(p) < high))
    part = F.get(hits, F.lit(0))
    time = F.timestamp_seconds(seconds(part))
    return _match("4chan_timestamp", part.isNotNull(), some(tagged("date", F.date_format(time, "yyyy-MM-dd"))), epoch=part, iso=F.date_format(time, "yyyy-MM-dd HH:mm:ss 'UTC'"))


def parse_pixiv(name: Column) -> Column:
    marked = reduce(lambda a, b: a | b, (name.contains(m) for m in PAGE_MARKS))
    illust, page = name.rlike(ILLUST), name.rlike(PAGE)
    day, time = group(name, ILLUST, 2), group(name, ILLUST, 3)
    date = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    dated = day.isNotNull()
    artist = F.trim(group(name, PAGE, 1))
    first = _match("pixiv_id", F.lit(True), some(tagged("pixiv", group(name, ILLUST, 1)), F.when(dated, tagged("date", date))), pixiv_id=group(name, ILLUST, 1), iso=F.when(dated, F.concat(date, F.lit(" "), time)))
    second = _match("pixiv_id", F.lit(True), some(tagged("pixiv", group(name, PAGE, 2)), tagged("page", group(name, PAGE, 3)), F.when(artist != "", tagged("artist", artist))), artist=artist, pixiv_id=group(name, PAGE, 2))
    return F.when(marked & illust, first).when(marked & page, second)


def parse_twitter(name: Column) -> Column:
    marked = name.contains("media_") | name.contains("status_")
    key = F.coalesce(group(name, SNOWFLAKE, 1), group(name, MEDIA_KEY, 1))
    return _match("twitter_key", marked & key.isNotNull(), some(tagged("twitter", key)), twitter_id=key)


def parse_tagged(name: Column) -> Column:
    artist = F.trim(group(name, BRACKETED, 1))
    words = F.filter(F.transform(F.split(F.coalesce(group(name, BRACKETED, 3), F.lit("")), "[ ,]"), F.trim), lambda w: w != "")
    return _match("tagged_string", name.rlike(BRACKETED), F.concat(some(tagged("artist", artist)), words), artist=artist)


def parse_episode(name: Column) -> Column:
    """Title, episode, resolution and group; partial without title or episode, no match without any of them.

    One pattern cuts the name at its first episode number; another takes the title out of what stands before.
    """
    cut = "^(.*?)" + EPISODE + "(.*)$"
    before, after = F.regexp_extract(name, cut, 1), F.regexp_extract(name, cut, 4)
    number = F.coalesce(group(name, cut, 2), group(name, cut, 3))
    title = F.trim(F.translate(F.regexp_extract(before, TITLE, 1), "_.", "  "))
    whole = number.isNotNull() & (title != "")
    quality = F.coalesce(group(after, RESOLUTION, 1), group(name, RESOLUTION, 1))
    tags = some(F.when(whole, tagged("anime", title)), tagged("episode", number), F.when(number.isNotNull(), tagged("resolution", F.lower(quality))), tagged("group", group(name, GROUP, 1)))
    return _match("anime_screenshot", F.size(tags) > 0, tags, partial=~whole)


#: The rules by the names that stored rules use.
RULES = {"4chan_timestamp": parse_epoch, "pixiv_id": parse_pixiv, "twitter_key": parse_twitter, "tagged_string": parse_tagged, "anime_screenshot": parse_episode}


def positional(pattern: str) -> tuple[str, list[str | None]]:
    """A pattern with named groups as one with numbered ones, and each group's name."""
    names: list[str | None] = []
    out, k = "", 0
    while k < len(pattern):
        if pattern[k] == "\\":
            out += pattern[k : k + 2]
            k += 2
            continue
        named = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern[k:])
        if named:
            names.append(named[1])
            out += "("
            k += len(named[0])
            continue
        if pattern[k] == "(" and not pattern.startswith("(?", k):
            names.append(None)
        out += pattern[k]
        k += 1
    return out, names


def parse_custom(name: Column, pattern: str) -> Column:
    """A rule from a regular expression with named groups: known names fill fields, others become tags; ``_skip_`` names don't."""
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern))
    except re.error:
        return _match("custom_regex", F.lit(False), some())
    plain, names = positional(pattern)
    at = {n: group(name, plain, k) for k, n in enumerate(names, 1) if n}
    field = lambda n: at.get(n, F.lit(None).cast("string"))
    second = F.try_to_number(field("timestamp"), F.lit("9999999999999999")).cast("long")
    time = F.timestamp_seconds(F.when(second.between(0, 253402300799), second))
    tags = [F.when(field(n).isNotNull(), tagged(k, field(n))) for n, k in (("artist", "artist"), ("pixiv_id", "pixiv"), ("twitter_id", "twitter"))]
    tags += [field("tag"), F.when(time.isNotNull(), tagged("date", F.date_format(time, "yyyy-MM-dd")))]
    tags += [F.when(v.isNotNull(), tagged(n, v)) for n, v in at.items() if n not in ("artist", "pixiv_id", "twitter_id", "timestamp", "tag") and not n.startswith("_skip_")]
    return _match("custom_regex", name.rlike(plain), some(*tags), artist=field("artist"), pixiv_id=field("pixiv_id"), twitter_id=field("twitter_id"), epoch=field("timestamp"), iso=F.date_format(time, "yyyy-MM-dd HH:mm:ss 'UTC'"))


#: The group that a block of a token rule fills, and what it matches.
BLOCKS = {
    "artist": ("artist", r"[A-Za-z0-9_\-\s]+"),
    "timestamp_4chan": ("timestamp", r"\d{10,16}"),
    "pixiv_id": ("pixiv_id", r"\d{7,10}"),
    "twitter_id": ("twitter_id", r"[A-Za-z0-9_-]{15,25}"),
    "number": ("number", r"\d+"),
    "md5_hash": ("hash", r"[0-9a-f]{32}"),
    "wildcard": ("wildcard", r".*?"),
    "tag": ("tag", r"[A-Za-z0-9_\-]+"),
    "bracketed": ("bracketed", r"[^\]]+"),
}


@dataclass
class Block:
    """A block of a token rule: one of BLOCKS, ``delimiter`` (a literal ``value``, ``_`` by default) or ``whitespace``.

    ``label`` names its group, a block that isn't ``enabled`` must match but gives nothing, ``prefix`` is a
    literal that may stand before it. Blocks of other kinds count for nothing.
    """

    kind: str
    value: str | None = None
    label: str | None = None
    enabled: bool = True
    prefix: str | None = None

    def pattern(self) -> str:
        if self.kind == "delimiter":
            own = re.escape("_" if self.value is None else self.value)
        elif self.kind == "whitespace":
            own = r"\s*"
        elif self.kind in BLOCKS:
            name, inner = BLOCKS[self.kind]
            own = f"(?P<{'' if self.enabled else '_skip_'}{self.label or name}>{inner})"
            own = rf"\[{own}\]" if self.kind == "bracketed" else own
        else:
            return ""
        return own if self.prefix is None else f"(?:{re.escape(self.prefix)})?{own}"


def token_pattern(blocks: list[Block]) -> str:
    """An anchored pattern for ``parse_custom``."""
    return "^" + "".join(b.pattern() for b in blocks) + "$"


def parsed(paths: DataFrame, rule: str, **options) -> DataFrame:
    """``(id, path, parts...)`` of the rows whose stem matches a rule of RULES."""
    row = RULES[rule](F.col("stem"), **options)
    return paths.withColumn("stem", stem(F.col("path"))).withColumn("m", row).where("m IS NOT NULL").select("id", "stem", "m.*")


def tag_category(tag: Column) -> Column:
    key = F.substring_index(tag, ":", 1)
    return F.when(~tag.contains(":"), "general").when(key == "artist", "artist").when(key == "date", "meta").when(key.isin("pixiv", "twitter"), "source").otherwise("general")


def batch_parse(assets: DataFrame, rule: str, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole matches of live assets: metadata rows, the tags they name with their category, links not yet there."""
    rows = parsed(assets.where("NOT is_deleted AND NOT is_missing"), rule).where("NOT partial")
    held = rows.select(F.col("id").alias("image_id"), F.explode(F.array_distinct("tags")).alias("name"))
    tags = held.select("name").distinct().withColumn("category", tag_category(F.col("name")))
    return rows, tags, held.join(links.select("image_id", "name"), ["image_id", "name"], "left_anti")


def normalized_url(url: Column) -> Column:
    """Trimmed, lower case, without fragment and tracking parameters; what is no URL only trimmed and lower case."""
    clean = F.regexp_replace(F.trim(url), "#.*$", "")
    args = F.filter(F.split(F.regexp_extract(clean, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    base = F.regexp_extract(clean, r"^([^?]*)", 1)
    # a bare host gets its root path
    base = F.when(base.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    full = F.when(F.size(args) > 0, F.concat(base, F.lit("?"), F.array_join(args, "&"))).otherwise(base)
    return F.when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"), F.lower(full)).otherwise(F.lower(F.trim(url)))


def json_list(text: Column) -> Column:
    """A JSON array of strings, empty where it is none."""
    return F.coalesce(F.from_json(text, STRINGS), F.array().cast(STRINGS))


def frame_rate(text: Column) -> Column:
    """``a/b`` or a number; null without a positive denominator."""
    part = lambda k: F.get(F.split(text, "/"), F.lit(k)).try_cast("double")
    return F.when(text.contains("/"), F.when(part(1) > 0, part(0) / part(1))).otherwise(text.try_cast("double"))


def duration_ms(text: Column) -> Column:
    """Seconds or ``h:m:s`` as milliseconds."""
    part = lambda k: F.get(F.split(text, ":"), F.lit(k)).try_cast("double")
    seconds = F.when(text.contains(":"), part(0) * 3600 + part(1) * 60 + part(2)).otherwise(text.try_cast("double"))
    return F.floor(seconds * 1000 + 0.5)


def rescaled(boxes: DataFrame, size: float, width: Column, height: Column) -> DataFrame:
    """Centre-size boxes of a letterboxed square to whole corners in the picture, and the window padded by a twentieth."""
    scale = F.least(F.lit(size) / width, F.lit(size) / height)
    dx, dy = (size - width * scale) / 2, (size - height * scale) / 2
    at = lambda c, pad, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), F.floor((c - pad) / scale + 0.5).cast("double"))).cast("long")
    corners = {"x0": at(F.col("cx") - F.col("w") / 2, dx, width), "y0": at(F.col("cy") - F.col("h") / 2, dy, height), "x1": at(F.col("cx") + F.col("w") / 2, dx, width), "y1": at(F.col("cy") + F.col("h") / 2, dy, height)}
    out = boxes.withColumns(corners)
    pw, ph = F.floor((F.col("x1") - F.col("x0")) * 0.05), F.floor((F.col("y1") - F.col("y0")) * 0.05)
    return out.withColumns({"wx0": F.greatest(F.lit(0), F.col("x0") - pw), "wy0": F.greatest(F.lit(0), F.col("y0") - ph), "wx1": F.least(width, F.col("x1") + pw), "wy1": F.least(height, F.col("y1") + ph)})


STEM = "WITH s AS (SELECT id, is_deleted, is_missing, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem FROM assets)"


@query("parse_epoch", STEM + ", p AS (SELECT id, stem, make_timestamp(CAST(stem AS BIGINT) * 1000000) AS t FROM s WHERE regexp_full_match(stem, '\\d{10}') AND CAST(stem AS BIGINT) BETWEEN 1041379200 AND 1924991999) SELECT id, stem AS timestamp, strftime(t, '%Y-%m-%d %H:%M:%S UTC') AS datetime_iso, 'date:' || strftime(t, '%Y-%m-%d') AS tags FROM p", "assets")
def _parse_epoch(t):
    return parsed(t.assets, "4chan_timestamp").select("id", "timestamp", "datetime_iso", F.array_join("tags", "|").alias("tags"))


@query("parse_pixiv", STEM + r""", m AS (SELECT *, regexp_extract(stem, 'illust_(\d+)(?:_(\d{8})_(\d{6}))?', 1) AS i, regexp_extract(stem, 'illust_(\d+)(?:_(\d{8})_(\d{6}))?', 2) AS d,
 regexp_extract(stem, '^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$', 1) AS a, regexp_extract(stem, '^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$', 2) AS n, regexp_extract(stem, '^(?:(.+)_)?(\d{7,10})_p(\d+)(?:[\s_](.+))?$', 3) AS p FROM s)
SELECT id, CASE WHEN i = '' THEN nullif(a, '') END AS artist, coalesce(nullif(i, ''), n) AS pixiv_id, CASE WHEN i <> '' THEN 'pixiv:' || i || CASE WHEN d <> '' THEN '|date:' || d[1:4] || '-' || d[5:6] || '-' || d[7:8] ELSE '' END ELSE 'pixiv:' || n || '|page:' || p || CASE WHEN a <> '' THEN '|artist:' || a ELSE '' END END AS tags
FROM m WHERE (contains(stem, 'illust_') OR regexp_matches(stem, '_p[0-3]')) AND (i <> '' OR n <> '')""", "assets")
def _parse_pixiv(t):
    return parsed(t.assets, "pixiv_id").select("id", "artist", "pixiv_id", F.array_join("tags", "|").alias("tags"))


@query("parse_twitter", STEM + r", m AS (SELECT id, coalesce(nullif(regexp_extract(stem, '([a-zA-Z0-9_-]+-\d{18,20})', 1), ''), nullif(regexp_extract(stem, '(?:media_|status_)?([A-Za-z0-9_-]{15,25})', 1), '')) AS twitter_id FROM s WHERE contains(stem, 'media_') OR contains(stem, 'status_')) SELECT id, twitter_id, 'twitter:' || twitter_id AS tags FROM m WHERE twitter_id IS NOT NULL", "assets")
def _parse_twitter(t):
    return parsed(t.assets, "twitter_key").select("id", "twitter_id", F.array_join("tags", "|").alias("tags"))


@query("parse_tagged", STEM + r", m AS (SELECT id, trim(regexp_extract(stem, '^\[([^\]]+)\]\s*(.*?)(?:\s*\(([^)]+)\))?$', 1)) AS artist, regexp_extract(stem, '^\[([^\]]+)\]\s*(.*?)(?:\s*\(([^)]+)\))?$', 3) AS w FROM s WHERE regexp_matches(stem, '^\[([^\]]+)\]\s*(.*?)(?:\s*\(([^)]+)\))?$')) SELECT id, artist, concat_ws('|', 'artist:' || artist, nullif(array_to_string(list_filter(regexp_split_to_array(w, '[ ,]'), lambda x: x <> ''), '|'), '')) AS tags FROM m", "assets")
def _parse_tagged(t):
    return parsed(t.assets, "tagged_string").select("id", "artist", F.array_join("tags", "|").alias("tags"))


@query("parse_episode", STEM + f""", c AS (SELECT id, stem, regexp_extract(stem, '^(.*?){EPISODE}(.*)$', ['before', 'n1', 'n2', 'after']) AS c FROM s),
n AS (SELECT id, stem, coalesce(nullif(c.n1, ''), nullif(c.n2, '')) AS n, trim(translate(regexp_extract(c.before, '{TITLE}', 1), '_.', '  ')) AS title, c.after AS after FROM c),
p AS (SELECT *, n IS NOT NULL AND title <> '' AS whole, lower(coalesce(nullif(regexp_extract(after, '{RESOLUTION}', 1), ''), nullif(regexp_extract(stem, '{RESOLUTION}', 1), ''))) AS q, nullif(regexp_extract(stem, '{GROUP}', 1), '') AS g FROM n),
o AS (SELECT id, stem, concat_ws('|', CASE WHEN whole THEN 'anime:' || title END, 'episode:' || n, CASE WHEN n IS NOT NULL THEN 'resolution:' || q END, 'group:' || g) AS tags, NOT whole AS partial FROM p)
SELECT * FROM o WHERE tags <> ''""", "assets")
def _parse_episode(t):
    return parsed(t.assets, "anime_screenshot").select("id", "stem", F.array_join("tags", "|").alias("tags"), "partial")


@query("parse_custom", STEM + r" SELECT id, nullif(trim(regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 1)), '') AS artist, regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 2) AS pixiv_id, 'artist:' || regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 1) || '|pixiv:' || regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 2) || '|page_no:' || regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 3) AS tags FROM s WHERE regexp_matches(stem, '^(.+)_(\d{8})_p(\d)$')", "assets")
def _parse_custom(t):
    row = parse_custom(stem(F.col("path")), r"^(?P<artist>.+)_(?P<pixiv_id>\d{8})_p(?P<page_no>\d)$")
    return t.assets.select("id", row.alias("m")).where("m IS NOT NULL").select("id", "m.artist", "m.pixiv_id", F.array_join("m.tags", "|").alias("tags"))


@query("parse_tokens", STEM + r" SELECT id, 'no:' || regexp_extract(stem, '^([A-Za-z0-9_\-]+)_(\d+)$', 2) AS tags FROM s WHERE regexp_matches(stem, '^([A-Za-z0-9_\-]+)_(\d+)$')", "assets")
def _parse_tokens(t):
    row = parse_custom(stem(F.col("path")), token_pattern([Block("tag", enabled=False), Block("delimiter"), Block("number", label="no")]))
    return t.assets.select("id", row.alias("m")).where("m IS NOT NULL").select("id", F.array_join("m.tags", "|").alias("tags"))


@query("batch_parse", STEM + r""", m AS (SELECT id, regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 1) AS a, regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 2) AS n, regexp_extract(stem, '^(.+)_(\d{8})_p(\d)$', 3) AS p, regexp_extract(stem, 'illust_(\d+)', 1) AS i FROM s WHERE NOT is_deleted AND NOT is_missing AND (contains(stem, 'illust_') OR regexp_matches(stem, '^(.+)_(\d{8})_p(\d)$'))),
g AS (SELECT id, unnest(CASE WHEN i <> '' THEN ['pixiv:' || i, 'date:2023-05-13'] ELSE ['pixiv:' || n, 'page:' || p, 'artist:' || a] END) AS name FROM m)
SELECT CASE split_part(name, ':', 1) WHEN 'artist' THEN 'artist' WHEN 'date' THEN 'meta' WHEN 'pixiv' THEN 'source' ELSE 'general' END AS category, count(*) AS links, count(DISTINCT name) AS names FROM g WHERE id % 3 <> 0 OR name NOT LIKE 'artist:%' GROUP BY 1""", "assets")
def _batch_parse(t):
    there = t.assets.where("id % 3 = 0").select(F.col("id").alias("image_id"), F.lit("artist:artist_name").alias("name"))
    _, tags, links = batch_parse(t.assets, "pixiv_id", there)
    return links.join(tags, "name").groupBy("category").agg(F.count("*").alias("links"), F.countDistinct("name").alias("names"))


@query("path_parts", "SELECT id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem, regexp_replace(path, '/[^/]*$', '') AS parent, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM assets", "assets")
def _path_parts(t):
    from ..operators.stats import extension

    p = F.col("path")
    return t.assets.select("id", basename(p).alias("name"), stem(p).alias("stem"), parent(p).alias("parent"), extension(p).alias("ext"))


@query("normalize_url", r"""
WITH u AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '?UTM_source=x&b=2&ref=me#Top' WHEN 1 THEN '#frag' ELSE '' END AS url FROM pages),
c AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM u), b AS (SELECT page_id, regexp_extract(u, '^([^?]*)', 1) AS base, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'ref', 'referrer', 'spm')) AS args FROM c)
SELECT page_id, lower(CASE WHEN regexp_full_match(base, '[A-Za-z][A-Za-z0-9+.-]*://[^/]+') THEN base || '/' ELSE base END || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END) AS url FROM b""")
def _normalize_url(t):
    extra = F.when(F.col("page_id") % 3 == 0, "?UTM_source=x&b=2&ref=me#Top").when(F.col("page_id") % 3 == 1, "#frag").otherwise("")
    return t.pages.select("page_id", normalized_url(F.concat("url", extra)).alias("url"))


@query("json_tags", "SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN id % 3 = 0 THEN '' ELSE 'a' || id || '|b' END AS tags FROM assets", "assets")
def _json_tags(t):
    text = F.when(F.col("id") % 3 == 0, F.lit("no json")).otherwise(F.concat(F.lit('["a'), F.col("id").cast("string"), F.lit('","b"]')))
    tags = t.assets.select("id", json_list(text).alias("tags"))
    return tags.select("id", F.size("tags").alias("n"), F.array_join("tags", "|").alias("tags"))


@query("media_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN CAST(floor(CAST(l_partkey AS DOUBLE) / (l_linenumber % 3) * 1000 + 0.5) AS BIGINT) END AS fps, CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor((3600.0 + l_linenumber * 60 + l_suppkey) * 1000 + 0.5) AS BIGINT) ELSE CAST(floor((l_partkey + 0.25) * 1000 + 0.5) AS BIGINT) END AS ms FROM lineitem")
def _media_numbers(t):
    s = lambda c: F.col(c).cast("string")
    rate = F.concat(s("l_partkey"), F.lit("/"), (F.col("l_linenumber") % 3).cast("string"))
    length = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("1:"), s("l_linenumber"), F.lit(":"), s("l_suppkey"))).otherwise(F.concat(s("l_partkey"), F.lit(".25")))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.floor(frame_rate(rate) * 1000 + 0.5).alias("fps"), duration_ms(length).alias("ms"))


@query("box_rescale", """
WITH b AS (SELECT image_id, box_id, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM boxes), k AS (SELECT 640.0::DOUBLE / 1280 AS s, 0.0::DOUBLE AS dx, (640 - 720 * (640.0::DOUBLE / 1280)) / 2 AS dy),
c AS (SELECT image_id, box_id, CAST(greatest(0, least(1280, floor((cx - w / 2 - dx) / s + 0.5))) AS BIGINT) AS x0, CAST(greatest(0, least(720, floor((cy - h / 2 - dy) / s + 0.5))) AS BIGINT) AS y0, CAST(greatest(0, least(1280, floor((cx + w / 2 - dx) / s + 0.5))) AS BIGINT) AS x1, CAST(greatest(0, least(720, floor((cy + h / 2 - dy) / s + 0.5))) AS BIGINT) AS y1 FROM b, k)
SELECT *, greatest(0, x0 - CAST(floor((x1 - x0) * 0.05::DOUBLE) AS BIGINT)) AS wx0, least(720, y1 + CAST(floor((y1 - y0) * 0.05::DOUBLE) AS BIGINT)) AS wy1 FROM c""", "boxes")
def _box_rescale(t):
    d = "double"
    centred = t.boxes.select("image_id", "box_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).cast(d).alias("w"), (F.col("y1") - F.col("y0")).cast(d).alias("h"))
    return rescaled(centred, 640.0, F.lit(1280), F.lit(720)).select("image_id", "box_id", "x0", "y0", "x1", "y1", "wx0", "wy1")
