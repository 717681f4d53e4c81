"""Hybrid search: seven kinds of evidence in one ranked plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators.changes import replace_groups
from ..operators.details import PARSED, parsed_rows
from ..operators.filters import filename_contains, live, media_kind, parsed_terms, with_tags
from ..operators.similarity import PHASH, hash_neighbours, perceptual, unit
from ..operators.stats import VECTORS, vectors
from ..operators.vectorindex import VectorIndex
from ..shared import fresh_path
from ..sources.views import query
from .fulltext import TextIndex, text_matches
from .names import NameIndex

#: Rank of the kinds of evidence.
EXACT, PERCEPTUAL, SEMANTIC = 0, 1, 2


@dataclass
class Library:
    """The tables a search reads."""

    assets: DataFrame
    asset_tags: DataFrame
    tags: DataFrame
    hashes: DataFrame
    vectors: DataFrame  # (id, v), unit vectors
    parsed: DataFrame
    detections: DataFrame
    lines: DataFrame
    # stored indexes of lines, vectors and paths; what has none is scanned
    text_index: TextIndex | None = None
    vector_index: VectorIndex | None = None
    name_index: NameIndex | None = None


@dataclass
class Search:
    """What to search for; what is unset doesn't count."""

    content_key: str | None = None
    image_hash: int | None = None
    image_vector: DataFrame | None = None  # one row (id, v)
    text_vector: DataFrame | None = None
    tags: list[str] = field(default_factory=list)
    source_id: int = 1
    filename: str | None = None
    parsed: str | None = None
    match_type: str | None = None
    identity: int | None = None
    has_text: bool = False
    text: str | None = None
    media: str = "all"
    limit: int = 100


def nearest(query: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(id, score)``: the k rows nearest to one ``query(id, v)`` by cosine, its own row left out; the query's single row is sent to all tasks."""
    one = F.broadcast(query.limit(1).select(F.col("id").alias("_own"), F.col("v").alias("_q")))
    rows = vectors.join(one, F.col("id") != F.col("_own"))
    return rows.select("id", dot(F.col("v"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _leg(df: DataFrame, tier: int, score=None) -> DataFrame:
    ids = df.select(F.col(df.columns[0]).alias("id"), *([F.col("score")] if "score" in df.columns else []))
    return ids.select("id", F.lit(tier).alias("tier"), (F.lit(float(score or 0.0)) if "score" not in df.columns else F.col("score").cast("double")).alias("score"))


def search(lib: Library, ask: Search) -> DataFrame:
    """``(id, tier, score)`` in order, at most ``limit`` rows.

    The order of set operations is part of the result: identity and text-presence intersect; an image
    query, then a text query, then a text match each replace what came before; exact, perceptual, parsed
    and filename hits are added; tags intersect, unless nothing but tags (and filters that are then
    dropped) was asked for. Missing assets go before the limit. Text, vectors and file names are looked up in
    the library's stored indexes where it has them; the vector index finds about the nearest.
    """
    base: DataFrame | None = None
    if ask.identity is not None:
        base = lib.detections.where(F.col("identity_id") == ask.identity).select("image_id").distinct()
    if ask.has_text:
        held = lib.lines.select("image_id").distinct()
        base = held if base is None else base.join(held, "image_id", "left_semi")
    base = None if base is None else _leg(base, SEMANTIC)

    def near(q: DataFrame) -> DataFrame:
        k = max(ask.limit, 100)
        return _leg(nearest(q, lib.vectors, k) if lib.vector_index is None else lib.vector_index.search(q.limit(1), k).select("id", "score"), SEMANTIC)

    if ask.image_vector is not None:
        base = near(ask.image_vector)
    if ask.text_vector is not None:
        base = near(ask.text_vector)
    if ask.text:
        base = _leg(text_matches(lib.lines, ask.text) if lib.text_index is None else lib.text_index.search(ask.text), SEMANTIC, 1.0)
    exact = None if ask.content_key is None else _leg(lib.assets.where(F.col("content_key") == ask.content_key).select("id"), EXACT, 1.0)
    alike = None if ask.image_hash is None else _leg(hash_neighbours(lib.hashes, ask.image_hash), PERCEPTUAL)
    parsed = _leg(parsed_terms(lib.parsed, ask.parsed or "", ask.match_type).select("image_id"), SEMANTIC) if ask.parsed or ask.match_type else None
    paths = lambda text: (filename_contains(lib.assets, text) if lib.name_index is None else lib.name_index.contains(text)).select("id")
    named = None if not ask.filename else _leg(paths(ask.filename), SEMANTIC)
    legs = [x for x in (base, exact, alike, parsed, named) if x is not None]
    if ask.tags:
        tagged = with_tags(lib.asset_tags, lib.tags, ask.tags, ask.source_id).select(F.col("image_id").alias("id"))
        hits = [x for x in (exact, alike, parsed) if x is not None]
        legs = [x.join(tagged, "id", "left_semi") for x in (base, *hits) if x is not None]
        if ask.text_vector is None:
            # tags alone count, and the file name doesn't, where none of the other kinds has a hit: one row says whether
            some = F.broadcast(reduce(DataFrame.unionByName, hits, _leg(tagged.limit(0), SEMANTIC)).limit(1).agg((F.count("*") > 0).alias("some")))
            legs.append(_leg(tagged, SEMANTIC).join(some, ~F.col("some")).drop("some"))
            named = None if named is None else named.join(some, F.col("some")).drop("some")
        if named is not None:
            legs.append(named.join(tagged, "id", "left_semi"))
    if not legs:
        return latest(lib.assets, ask.limit)
    best = reduce(DataFrame.unionByName, legs).groupBy("id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b")).select("id", "b.tier", (-F.col("b.s")).alias("score"))
    shown = media_kind(live(lib.assets), ask.media).select("id")
    return best.join(shown, "id", "left_semi").orderBy("tier", F.desc("score"), "id").limit(ask.limit)


def latest(assets: DataFrame, limit: int) -> DataFrame:
    """Newest rows, missing ones dropped after the limit."""
    rows = live(assets, missing=True).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return rows.where("NOT is_missing").select("id", F.lit(SEMANTIC).alias("tier"), F.lit(0.0).alias("score"))


def library(t) -> Library:
    return Library(t.assets, t.asset_tags, t.tags, perceptual(t), unit(t.embeddings), parsed_rows(t), t.detections, t.text_lines)


@query("search", f"""
WITH h AS ({PHASH}), one AS (SELECT min(id) AS id FROM assets WHERE NOT is_deleted AND NOT is_missing), me AS (SELECT a.id, content_key, hash FROM assets a JOIN one USING (id) JOIN h USING (id)),
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qv AS (SELECT v FROM e ORDER BY id LIMIT 1), f AS (SELECT min(id) AS id FROM e),
legs AS (SELECT * FROM (SELECT e.id, 2 AS tier, list_cosine_similarity(e.v, qv.v) AS score FROM e, qv WHERE e.id <> (SELECT id FROM f) ORDER BY score DESC, e.id LIMIT 200)
 UNION ALL SELECT a.id, 0, 1.0 FROM assets a, me WHERE a.content_key = me.content_key
 UNION ALL SELECT h.id, 1, 1 - bit_count(xor(h.hash, me.hash)) / 64.0 FROM h, me WHERE bit_count(xor(h.hash, me.hash)) <= 10
 UNION ALL SELECT id, 2, 0.0 FROM assets WHERE path ILIKE '%illust_1000%'),
b AS (SELECT id, tier, score, row_number() OVER (PARTITION BY id ORDER BY tier, score DESC) AS k FROM legs)
SELECT b.id, CAST(tier AS INT) AS tier, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score FROM b JOIN assets USING (id) WHERE k = 1 AND NOT is_deleted AND NOT is_missing AND NOT (lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.webm')
ORDER BY tier, b.score DESC, id LIMIT 200""", "assets")
def _search(t):
    lib = library(t)
    me = live(lib.assets).join(lib.hashes, "id").orderBy("id").select("content_key", "hash").first()
    first = lib.vectors.orderBy("id").limit(1)
    ask = Search(content_key=me.content_key, image_hash=me.hash, image_vector=first, filename="illust_1000", media="image", limit=200)
    return search(lib, ask).select("id", "tier", F.floor(F.col("score") * 1000000 + 0.5).alias("score"))


@query("search_indexed", r"""
WITH w AS (SELECT image_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM text_lines),
legs AS (SELECT image_id AS id, 1.0 AS score FROM w WHERE list_contains(w, 'the') AND NOT list_contains(w, 'could') UNION ALL SELECT id, 0.0 FROM assets WHERE path ILIKE '%illust_1000%')
SELECT id, 2 AS tier, CAST(max(score) AS DOUBLE) AS score FROM legs JOIN assets USING (id) WHERE NOT is_deleted AND NOT is_missing AND NOT (lower(path) LIKE '%.mp4' OR lower(path) LIKE '%.webm') GROUP BY id ORDER BY score DESC, id LIMIT 200""", "assets text_lines")
def _search_indexed(t):
    """Text and file name from stored indexes: the search reads their hits, not the lines and paths."""
    lib = library(t)
    lib.text_index = TextIndex.create(t.text_lines, fresh_path(t.spark, "text-index"))
    lib.name_index = NameIndex.create(t.assets.select("id", F.col("path").alias("text")), fresh_path(t.spark, "name-index"))
    return search(lib, Search(text="the NOT could", filename="illust_1000", media="image", limit=200))


@query("search_latest", "WITH n AS (SELECT * FROM assets WHERE NOT is_deleted ORDER BY created_at DESC, id DESC LIMIT 500) SELECT id, 2 AS tier, 0.0::DOUBLE AS score FROM n WHERE NOT is_missing", "assets")
def _search_latest(t):
    return search(library(t), Search(limit=500))


@query("parsed_terms", f"SELECT image_id FROM ({PARSED}) WHERE pixiv_id LIKE '1%' AND (artist = 'artist_name' OR contains(stem, 'artist_name')) AND (pixiv_id LIKE '%123%' OR stem LIKE '%123%')", "assets")
def _parsed_terms(t):
    return parsed_terms(library(t).parsed, 'pixiv:1 artist: "artist_name" 123', "pixiv_id").select("image_id")


@query("candidate_union", "SELECT id FROM assets WHERE path ILIKE '%illust_1000%' UNION SELECT image_id FROM text_lines", "assets text_lines")
def _candidate_union(t):
    return filename_contains(t.assets, "illust_1000").select("id").union(t.text_lines.select("image_id")).distinct()


@query("stale_vectors", f"WITH v AS ({VECTORS}) SELECT image_id, CASE WHEN state = 'ready' AND image_id NOT IN (SELECT vec_id FROM embeddings) THEN 'pending' ELSE state END AS state FROM v", "assets")
def _stale_vectors(t):
    """Rows that are ready but not in the index wait again."""
    states = vectors(t)
    lost = states.where("state = 'ready'").join(t.embeddings.select(F.col("vec_id").alias("image_id")), "image_id", "left_anti")
    return replace_groups(states, lost.withColumn("state", F.lit("pending")), "image_id")
