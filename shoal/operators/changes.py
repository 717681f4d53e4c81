"""Change sets: a table and its edits give the next version of the table.

Every operator is a pure transform of DataFrames; writing the new version is the caller's. Edits of one
key are reduced to the last one before they meet the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalized_url, parent
from ..shared import kept
from ..sources.views import query
from .numbering import numbered
from .renames import applied


def last_of(edits: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last edit of each key."""
    rest = [c for c in edits.columns if c not in keys]
    one = edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return one.select(*keys, "e.*")


def keyed_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_when_null: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; columns in ``keep_when_null`` keep the last value that isn't null.

    Rows of ``new`` that share a key count as if they came one by one, by the column ``order`` where it is
    named and else by their values, so the result is one row a key. Null keys equal each other. Keys of
    ``old`` are taken to be distinct.
    """
    rest = [c for c in old.columns if c not in keys]
    by = F.struct(*([order] if order else []), *rest)
    last = [(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), by)) if c in keep_when_null else F.max_by(c, by)).alias(c) for c in rest]
    o = old.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("_in"), *rest).alias("_o"))
    n = new.groupBy(*keys).agg(*last).select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("_in"), *rest).alias("_n"))
    same = [F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(keys))]
    rows = o.join(n, same, "full_outer")
    there = F.col("_n").isNotNull()
    value = lambda c: F.coalesce(F.col("_n")[c], F.col("_o")[c]) if c in keep_when_null else F.when(there, F.col("_n")[c]).otherwise(F.col("_o")[c])
    return rows.select(*[F.when(there, F.col(f"_n{i}")).otherwise(F.col(f"_o{i}")).alias(k) for i, k in enumerate(keys)], *[value(c).alias(c) for c in rest]).select(old.columns)


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one a key."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(old.columns))


def register_folders(paths: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders with those of ``paths(id, path)`` added, and ``(id, folder_id)``; a path without parent gets none."""
    held = paths.withColumn("folder", parent(F.col("path"))).where("folder <> ''")
    new = held.select(F.col("folder").alias("path")).distinct().join(folders.select("path"), "path", "left_anti")
    base = (folders.agg(F.max("id")).first()[0] or 0)
    added = numbered(new, ["path"], base).select("id", "path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"))
    every = folders.unionByName(added)
    return every, held.join(every.select(F.col("id").alias("folder_id"), F.col("path").alias("folder")), "folder").select("id", "folder_id")


def library_upsert(library: DataFrame, scan: DataFrame) -> DataFrame:
    """``library(id, sha, path, mtime, folder_id, is_deleted)`` after a scan ``(seq, sha, path, mtime, folder_id)``.

    A file matches a row of its hash, deleted or not, else a live row of its path; a match updates path,
    time and hash, keeps the first folder and undeletes; the rest is inserted under new ids.
    """
    batch = last_of(last_of(scan, ["path"], "seq"), ["sha"], "seq")
    by_hash = kept(batch.join(library.select(F.col("id").alias("hit"), "sha"), "sha", "left"))
    live_paths = library.where("NOT is_deleted").join(by_hash.where("hit IS NOT NULL").select(F.col("hit").alias("id")), "id", "left_anti")
    by_path = by_hash.where("hit IS NULL").drop("hit").join(live_paths.groupBy("path").agg(F.min("id").alias("hit")), "path", "left")
    cols = ["hit", "sha", "path", "mtime", "folder_id"]
    placed = kept(by_hash.where("hit IS NOT NULL").select(cols).unionByName(by_path.select(cols)))
    one = placed.where("hit IS NOT NULL").groupBy(F.col("hit").alias("id")).agg(F.max_by(F.struct("sha", "path", "mtime", "folder_id"), F.struct("mtime", "path")).alias("n"))
    rows = library.join(one, "id", "left")
    new = F.col("n").isNotNull()
    updated = rows.select("id", *[F.when(new, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("sha", "path", "mtime")], F.coalesce("folder_id", "n.folder_id").alias("folder_id"), (F.col("is_deleted") & ~new).alias("is_deleted"))
    base = library.agg(F.max("id")).first()[0] or 0
    added = numbered(placed.where("hit IS NULL").select("sha", "path", "mtime", "folder_id"), ["path", "sha"], base).withColumn("is_deleted", F.lit(False))
    return updated.unionByName(added.select(updated.columns))


def score_writeback(assets: DataFrame, scores: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Scores by id; rows without a score stay as they are.

    Of several scores of an id the last counts, by the column ``order`` where it is named and else by value;
    assets that share an id each get it.
    """
    by = F.struct(*([order] if order else []), *columns)
    last = scores.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*columns), by).alias("_new"))
    rows = assets.join(last, F.col("id") == F.col("_id"), "left")
    new = {c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in assets.columns])


def queue_unindexed(assets: DataFrame, vectors: DataFrame, folder_id: int) -> DataFrame:
    """Vector rows after queueing a folder's assets that have none; failed ones are reset."""
    own = assets.where((F.col("folder_id") == folder_id) & ~F.col("is_deleted")).select(F.col("id").alias("image_id"))
    fresh = own.join(vectors.where("state IN ('ready', 'pending', 'preprocessing')").select("image_id"), "image_id", "left_anti").withColumn("state", F.lit("pending"))
    return vectors.join(fresh.select("image_id"), "image_id", "left_anti").unionByName(fresh)


def apply_tag_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state(image_id, tag_id, source_id, confidence, is_deleted, is_blacklisted)`` after edits ``(seq, image_id, tag_id, action)``.

    add gives an own row of confidence 1 and undeletes; remove drops concept rows (source 3), blacklists
    tagger rows (1 and 2) and deletes others; restore undoes a blacklist.
    """
    keys = ["image_id", "tag_id"]
    e = last_of(edits, keys, "seq").select(*keys, "action")
    rows = state.join(e, keys, "left")
    action, source = F.col("action"), F.col("source_id")
    removed, tagger = F.coalesce(action == "remove", F.lit(False)), source.isin(1, 2)
    back = F.coalesce(action == "restore", F.lit(False)) & F.col("is_blacklisted") | F.coalesce(action == "add", F.lit(False)) & (source == 0)
    kept = rows.where(~(removed & (source == 3))).select(
        *keys, "source_id", F.when(F.coalesce(action == "add", F.lit(False)) & (source == 0), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(removed, True).when(back, False).otherwise(F.col("is_deleted")).alias("is_deleted"),
        F.when(removed & tagger, True).when(back, False).otherwise(F.col("is_blacklisted")).alias("is_blacklisted"),
    )
    fresh = e.where("action = 'add'").join(state.where("source_id = 0").select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh.select(*keys, F.lit(0).cast("long").alias("source_id"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_blacklisted")))


def tag_dim_merge(tags: DataFrame, found: DataFrame) -> DataFrame:
    """Tags with new names of ``found(seq, name, category)`` added; a name's first category stays."""
    first = found.groupBy("name").agg(F.min_by("category", "seq").alias("category")).join(tags.select("name"), "name", "left_anti")
    base = tags.agg(F.max("id")).first()[0] or 0
    return tags.unionByName(numbered(first, ["name"], base).select("id", "name", "category"))


def autotag_merge(state: DataFrame, output: DataFrame, source_id: int, txn: int, force: bool = False) -> DataFrame:
    """Tagger output ``(image_id, tag_id, confidence)`` as rows of one transaction.

    Assets that have active rows of the source are skipped, or wiped with ``force``; blacklisted pairs
    of any source stay out.
    """
    own = F.col("source_id") == source_id
    active = state.where(own & ~F.col("is_deleted")).select("image_id").distinct()
    todo = output if force else output.join(active, "image_id", "left_anti")
    black = state.where("is_blacklisted").select("image_id", "tag_id").distinct()
    fresh = todo.join(black, ["image_id", "tag_id"], "left_anti").select("image_id", "tag_id", F.lit(source_id).cast("long").alias("source_id"), F.lit(txn).alias("txn"), "confidence", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_blacklisted"))
    if force:
        touched = todo.select("image_id").distinct().withColumn("touched", F.lit(True))
        state = state.join(touched, "image_id", "left").where(~(own & F.coalesce("touched", F.lit(False)) & ~F.col("is_blacklisted"))).drop("touched")
    return state.select(fresh.columns).unionByName(fresh)


def backfill_worklist(asset_tags: DataFrame, done: int, todo: int) -> DataFrame:
    """Assets with active tags of one source and none of another."""
    active = lambda s: asset_tags.where((F.col("source_id") == s) & ~F.col("is_deleted")).select("image_id").distinct()
    return active(done).join(active(todo), "image_id", "left_anti")


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` replaced where ``mapping(from_id, to_id)`` has it."""
    m = mapping.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(rows.columns)


def merge_folders(assets: DataFrame, folders: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Assets moved and the folder dropped; merging a folder with itself or an unknown one is an error."""
    if source == target or folders.where(F.col("id").isin(source, target)).count() != 2:
        raise ValueError("two different known folders are needed")
    one = F.when(F.col("folder_id") == source, F.lit(target)).otherwise(F.col("folder_id"))
    return assets.withColumn("folder_id", one), folders.where(F.col("id") != source)


def identity_merge(identities: DataFrame, detections: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identities and detections after renames ``(identity_id, name)``, as if these came one by one.

    They come in order of ``seq`` where there is such a column, then of identity and name. A name is trimmed;
    where another identity holds it at that time, detections move to that one and the renamed identity goes.
    An identity that went takes no more renames; detections point to where its merges end.
    """
    order = [c for c in ("seq", "identity_id", "name") if c in renames.columns]
    ops = numbered(renames.withColumn("name", F.trim("name")).select(*order), order, name="t").select("t", F.col("identity_id").cast("long").alias("identity_id"), "name")
    left, merges = applied(identities, ops)
    kind = detections.schema["identity_id"].dataType
    return left, remapped(detections, "identity_id", merges.select(*[F.col(c).cast(kind).alias(c) for c in ("from_id", "to_id")]))


def identity_prune(identities: DataFrame, detections: DataFrame) -> DataFrame:
    """Identities that have a detection."""
    return identities.join(detections.where("identity_id IS NOT NULL").select("identity_id").distinct(), "identity_id", "left_semi")


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the groups that ``new`` holds are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(gone: DataFrame, children: dict[str, DataFrame], key: str = "image_id") -> dict[str, DataFrame]:
    """Child tables without the rows of deleted parents ``gone(image_id)``."""
    return {name: child.join(gone.select(key), key, "left_anti") for name, child in children.items()}


def set_flags(assets: DataFrame, edits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flags or notes by id, last edit wins; null leaves a value."""
    e = last_of(edits, ["id"], "seq")
    rows = assets.join(e.select("id", F.struct(*columns).alias("e")), "id", "left")
    return rows.withColumns({c: F.coalesce(F.col(f"e.{c}"), F.col(c)) for c in columns}).drop("e")


def repair_states(vectors: DataFrame, indexed: DataFrame) -> DataFrame:
    """After a restart: what was in work, and what is ready but not in the index, waits again."""
    there = indexed.select("image_id", F.lit(True).alias("there"))
    rows = vectors.join(there, "image_id", "left")
    lost = (F.col("state") == "preprocessing") | (F.col("state") == "ready") & F.col("there").isNull()
    return rows.select("image_id", F.when(lost, "pending").otherwise(F.col("state")).alias("state"))


def requeue(vectors: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Failed rows wait again; with ``assets`` all live ones do."""
    if assets is None:
        return vectors.withColumn("state", F.when(F.col("state") == "failed", "pending").otherwise(F.col("state")))
    every = assets.where("NOT is_deleted AND NOT is_missing").select(F.col("id").alias("image_id"), F.lit("pending").alias("state"))
    return replace_groups(vectors, every, "image_id")


def fresh_rows(cache: DataFrame, at: Column, ttl: Column) -> DataFrame:
    """Cached rows younger than ``ttl`` at the time ``at``."""
    return cache.where(at - F.col("cached_at") < ttl)


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``tag_id`` replaced by its canonical tag."""
    return remapped(names, "tag_id", aliases)


def rollback_txn(asset_tags: DataFrame, txn: int) -> DataFrame:
    return asset_tags.withColumn("is_deleted", F.col("is_deleted") | (F.col("txn") == txn))


@query("backfill_folders", """
WITH p AS (SELECT id, path, regexp_replace(path, '/[^/]*$', '') AS folder FROM assets), k AS (SELECT 1 AS id, '/lib/f0' AS path, 'f0' AS name), n AS (SELECT DISTINCT folder FROM p WHERE folder NOT IN (SELECT path FROM k)),
e AS (SELECT id, path FROM k UNION ALL SELECT 1 + row_number() OVER (ORDER BY folder), folder FROM n) SELECT p.id, e.id AS folder_id FROM p JOIN e ON e.path = folder""", "assets")
def _backfill_folders(t):
    known = t.sql("SELECT 1L AS id, '/lib/f0' AS path, 'f0' AS name FROM region WHERE r_regionkey = 0")
    return register_folders(t.assets.select("id", "path"), known)[1]


LIBRARY = "SELECT id, content_key || '#' || id AS sha, path || '#' || id AS path, id % 100 AS mtime, CASE WHEN id % 2 = 0 THEN folder_id END AS folder_id, is_deleted FROM assets WHERE id % 3 <> 0"
SCAN = "SELECT id AS seq, content_key || '#' || CASE WHEN id % 5 = 0 THEN id + 1000000 ELSE id END AS sha, path || '#' || id AS path, id % 100 + 7 AS mtime, folder_id FROM assets WHERE id % 2 = 0"


@query("library_upsert", f"""
WITH l AS ({LIBRARY}), s AS ({SCAN}), h AS (SELECT s.*, l.id AS hit FROM s LEFT JOIN l USING (sha)), p AS (SELECT h.* EXCLUDE (hit), coalesce(h.hit, l.id) AS hit FROM h LEFT JOIN l ON h.hit IS NULL AND l.path = h.path AND NOT l.is_deleted),
n AS (SELECT * FROM p WHERE hit IS NULL)
SELECT l.id, coalesce(p.sha, l.sha) AS sha, coalesce(p.path, l.path) AS path, coalesce(p.mtime, l.mtime) AS mtime, coalesce(l.folder_id, p.folder_id) AS folder_id, l.is_deleted AND p.hit IS NULL AS is_deleted FROM l LEFT JOIN p ON p.hit = l.id
UNION ALL SELECT (SELECT max(id) FROM l) + row_number() OVER (ORDER BY path, sha), sha, path, mtime, folder_id, false FROM n""", "assets")
def _library_upsert(t):
    own = lambda c: F.concat(c, F.lit("#"), F.col("id").cast("string"))
    library = t.assets.where("id % 3 <> 0").select("id", own(F.col("content_key")).alias("sha"), own(F.col("path")).alias("path"), (F.col("id") % 100).alias("mtime"), F.when(F.col("id") % 2 == 0, F.col("folder_id")).alias("folder_id"), "is_deleted")
    moved = F.when(F.col("id") % 5 == 0, F.col("id") + 1000000).otherwise(F.col("id"))
    scan = t.assets.where("id % 2 = 0").select(F.col("id").alias("seq"), F.concat("content_key", F.lit("#"), moved.cast("string")).alias("sha"), own(F.col("path")).alias("path"), (F.col("id") % 100 + 7).alias("mtime"), "folder_id")
    return library_upsert(library, scan)


@query("keyed_upsert", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS a, o_orderpriority AS etag FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT * FROM orders, (SELECT unnest([1, 2]) AS seq) WHERE o_orderkey % 2 = 0 AND (seq = 1 OR o_orderkey % 10 = 0)),
n AS (SELECT o_orderkey AS k, arg_max(-o_custkey * seq, seq) AS a, max(CASE WHEN o_orderkey % 4 = 0 AND seq = 1 THEN 'new' END) AS etag FROM r GROUP BY 1)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.a ELSE o.a END AS a, coalesce(n.etag, o.etag) AS etag FROM o FULL JOIN n ON o.k = n.k""")
def _keyed_upsert(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("etag"))
    seq = F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))  # some keys come twice
    new = t.orders.where("o_orderkey % 2 = 0").withColumn("seq", seq).select(F.col("o_orderkey").alias("k"), (-F.col("o_custkey") * F.col("seq")).alias("a"), F.when((F.col("o_orderkey") % 4 == 0) & (F.col("seq") == 1), "new").alias("etag"), "seq")
    return keyed_upsert(old, new, ["k"], ["etag"], "seq")


@query("append_new", "WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber < 3) SELECT k, n FROM o UNION ALL SELECT * FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0) WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (k, n) FROM o)")
def _append_new(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return append_new(rows.where("n < 3"), rows.where("k % 2 = 0"), ["k", "n"])


@query("score_writeback", "SELECT id, CASE WHEN id % 12 = 0 THEN 0.125::DOUBLE WHEN id % 4 = 0 THEN 0.25::DOUBLE ELSE safe_score END AS safe_score FROM assets", "assets")
def _score_writeback(t):
    scores = t.assets.where("id % 4 = 0").select("id", F.lit(0.25).alias("safe_score"), F.lit(1).alias("seq"))
    again = t.assets.where("id % 12 = 0").select("id", F.lit(0.125).alias("safe_score"), F.lit(2).alias("seq"))  # a third of them are scored twice
    return score_writeback(t.assets.select("id", "safe_score"), scores.unionByName(again), ["safe_score"], "seq")


def _vectors(t) -> DataFrame:
    from .stats import vectors

    return vectors(t)


from .stats import VECTORS  # noqa: E402


@query("queue_unindexed", f"WITH v AS ({VECTORS}), f AS (SELECT id AS image_id FROM assets WHERE folder_id = 7 AND NOT is_deleted AND id NOT IN (SELECT image_id FROM v WHERE state <> 'failed')) SELECT image_id, state FROM v WHERE image_id NOT IN (SELECT image_id FROM f) UNION ALL SELECT image_id, 'pending' FROM f", "assets")
def _queue_unindexed(t):
    return queue_unindexed(t.assets, _vectors(t), 7)


@query("seen_urls", "SELECT page_id FROM pages WHERE page_id % 2 = 0 AND lower(url) IN (SELECT lower(url) FROM pages WHERE page_id % 3 = 0)")
def _seen_urls(t):
    key = normalized_url(F.col("url"))
    history = t.pages.where("page_id % 3 = 0").select(key.alias("u"))
    return t.pages.where("page_id % 2 = 0").withColumn("u", key).join(history, "u", "left_semi").select("page_id")


@query("seen_keys", "SELECT chapter, count(*) AS n FROM cached_pages WHERE chapter IN (SELECT chapter FROM progress) GROUP BY 1", "cached_pages progress")
def _seen_keys(t):
    return t.cached_pages.join(t.progress.select("chapter"), "chapter", "left_semi").groupBy("chapter").agg(F.count("*").alias("n"))


STATE = "SELECT DISTINCT ON (image_id, tag_id, source_id) image_id, tag_id, source_id, 0.5::DOUBLE AS confidence, is_deleted, is_blacklisted FROM (SELECT image_id, tag_id, source_id, bool_or(is_deleted) AS is_deleted, bool_or(is_blacklisted) AS is_blacklisted FROM asset_tags GROUP BY ALL)"
EDITS = "SELECT image_id * 10 + txn AS seq, image_id, tag_id, CASE (image_id + tag_id) % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'restore' ELSE 'none' END AS action FROM asset_tags WHERE image_id % 3 = 0"


def _state(t) -> DataFrame:
    return t.asset_tags.groupBy("image_id", "tag_id", "source_id").agg(F.lit(0.5).alias("confidence"), F.bool_or("is_deleted").alias("is_deleted"), F.bool_or("is_blacklisted").alias("is_blacklisted"))


@query("apply_tag_edits", f"""
WITH s AS ({STATE}), e AS (SELECT image_id, tag_id, arg_max(action, seq) AS action FROM ({EDITS}) GROUP BY ALL), j AS (SELECT s.*, coalesce(action, 'none') AS action FROM s LEFT JOIN e USING (image_id, tag_id))
SELECT image_id, tag_id, source_id, CASE WHEN action = 'add' AND source_id = 0 THEN 1.0 ELSE confidence END AS confidence,
 CASE WHEN action = 'remove' THEN true WHEN action = 'restore' AND is_blacklisted OR action = 'add' AND source_id = 0 THEN false ELSE is_deleted END AS is_deleted,
 CASE WHEN action = 'remove' AND source_id IN (1, 2) THEN true WHEN action = 'restore' AND is_blacklisted OR action = 'add' AND source_id = 0 THEN false ELSE is_blacklisted END AS is_blacklisted FROM j WHERE NOT (action = 'remove' AND source_id = 3)
UNION ALL SELECT image_id, tag_id, 0, 1.0, false, false FROM e WHERE action = 'add' AND (image_id, tag_id) NOT IN (SELECT (image_id, tag_id) FROM s WHERE source_id = 0)""", "asset_tags")
def _apply_tag_edits(t):
    kind = (F.col("image_id") + F.col("tag_id")) % 4
    action = F.when(kind == 0, "add").when(kind == 1, "remove").when(kind == 2, "restore").otherwise("none")
    edits = t.asset_tags.where("image_id % 3 = 0").select((F.col("image_id") * 10 + F.col("txn")).alias("seq"), "image_id", "tag_id", action.alias("action"))
    return apply_tag_edits(_state(t), edits)


@query("tag_dim_merge", "WITH o AS (SELECT id, name, category FROM tags WHERE id % 2 = 0), f AS (SELECT arg_min(category, seq) AS category, name FROM (SELECT id AS seq, name, category FROM tags UNION ALL SELECT id - 100000, name, 'first' FROM tags WHERE id % 3 = 0) GROUP BY name) SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name), name, category FROM f WHERE name NOT IN (SELECT name FROM o)", "tags")
def _tag_dim_merge(t):
    found = t.tags.select(F.col("id").alias("seq"), "name", "category").unionByName(t.tags.where("id % 3 = 0").select((F.col("id") - 100000).alias("seq"), "name", F.lit("first").alias("category")))
    return tag_dim_merge(t.tags.where("id % 2 = 0"), found)


@query("autotag_merge", """
WITH o AS (SELECT DISTINCT image_id, tag_id, 0.75::DOUBLE AS confidence FROM asset_tags WHERE source_id = 2), a AS (SELECT DISTINCT image_id FROM asset_tags WHERE source_id = 1 AND NOT is_deleted), b AS (SELECT DISTINCT image_id, tag_id FROM asset_tags WHERE is_blacklisted)
SELECT image_id, count(*) AS n, count(*) FILTER (WHERE txn = 99) AS fresh FROM (SELECT image_id, tag_id, txn FROM asset_tags UNION ALL SELECT image_id, tag_id, 99 FROM o WHERE image_id NOT IN (SELECT image_id FROM a) AND (image_id, tag_id) NOT IN (SELECT (image_id, tag_id) FROM b)) GROUP BY 1""", "asset_tags")
def _autotag_merge(t):
    output = t.asset_tags.where("source_id = 2").select("image_id", "tag_id", F.lit(0.75).alias("confidence")).distinct()
    return autotag_merge(t.asset_tags, output, 1, 99).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("txn") == 99).alias("fresh"))


@query("backfill_worklist", "SELECT DISTINCT image_id FROM asset_tags WHERE source_id = 1 AND NOT is_deleted AND image_id NOT IN (SELECT image_id FROM asset_tags WHERE source_id = 2 AND NOT is_deleted)", "asset_tags")
def _backfill_worklist(t):
    return backfill_worklist(t.asset_tags, 1, 2)


@query("merge_folders", "SELECT CASE WHEN folder_id = 3 THEN 0 ELSE folder_id END AS folder_id, count(*) AS n FROM assets GROUP BY 1", "assets")
def _merge_folders(t):
    folders = t.assets.select(F.col("folder_id").alias("id")).distinct()
    return merge_folders(t.assets, folders, 3, 0)[0].groupBy(F.col("folder_id").cast("long").alias("folder_id")).agg(F.count("*").alias("n"))


#: Renames in order: a chain of merges, a name given up and taken by another, a swap, an identity's own name, one that went already.
RENAMES = [(5, "n2"), (2, "n3"), (6, "fresh"), (6, "other"), (7, "fresh"), (8, "n9"), (9, "n8"), (4, " n4 "), (5, "late")]


@query("identity_merge", """
WITH d AS (SELECT CASE identity_id WHEN 5 THEN 3 WHEN 2 THEN 3 WHEN 8 THEN 9 ELSE identity_id END AS identity_id FROM detections),
i AS (SELECT DISTINCT identity_id, CASE identity_id WHEN 6 THEN 'other' WHEN 7 THEN 'fresh' WHEN 9 THEN 'n8' ELSE 'n' || identity_id END AS name FROM detections WHERE identity_id IS NOT NULL AND identity_id NOT IN (5, 2, 8))
SELECT coalesce(d.identity_id, i.identity_id) AS identity_id, any_value(name) AS name, count(*) AS n FROM d FULL JOIN i ON d.identity_id = i.identity_id GROUP BY 1""", "detections")
def _identity_merge(t):
    ids = t.detections.where("identity_id IS NOT NULL").select("identity_id", F.concat(F.lit("n"), F.col("identity_id").cast("string")).alias("name")).distinct()
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(i).alias("identity_id"), F.lit(n).alias("name")) for k, (i, n) in enumerate(RENAMES)]))
    renames = ids.agg(F.count("*")).select(one.alias("r")).select("r.*")
    left, moved = identity_merge(ids, t.detections, renames)
    counts = moved.groupBy("identity_id").agg(F.count("*").alias("n"))
    return counts.join(left, "identity_id", "full_outer").select("identity_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("identity_prune", "SELECT DISTINCT label AS identity_id FROM embeddings WHERE label IN (SELECT identity_id FROM detections WHERE id % 50 = 7)", "detections")
def _identity_prune(t):
    return identity_prune(t.embeddings.select(F.col("label").alias("identity_id")).distinct(), t.detections.where("id % 50 = 7"))


@query("replace_group", "SELECT image_id, count(*) AS n, min(text) AS first_text FROM (SELECT image_id, text FROM text_lines WHERE image_id % 3 <> 0 UNION ALL SELECT image_id, 'new' FROM text_lines WHERE image_id % 3 = 0) GROUP BY 1", "text_lines")
def _replace_group(t):
    new = t.text_lines.where("image_id % 3 = 0").withColumn("text", F.lit("new"))
    return replace_groups(t.text_lines, new, "image_id").groupBy("image_id").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query("cascade_delete", "SELECT 'boxes' AS child, count(*) AS n FROM boxes WHERE image_id NOT IN (SELECT id FROM assets WHERE is_deleted) UNION ALL SELECT 'tags', count(*) FROM asset_tags WHERE image_id NOT IN (SELECT id FROM assets WHERE is_deleted) UNION ALL SELECT 'lines', count(*) FROM text_lines WHERE image_id NOT IN (SELECT id FROM assets WHERE is_deleted)", "assets boxes asset_tags text_lines")
def _cascade_delete(t):
    gone = t.assets.where("is_deleted").select(F.col("id").alias("image_id"))
    left = cascade_delete(gone, {"boxes": t.boxes, "tags": t.asset_tags, "lines": t.text_lines})
    counts = [df.agg(F.lit(name).alias("child"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("set_flags", "SELECT id, CASE WHEN id % 5 = 0 THEN id % 2 = 0 ELSE favorite END AS favorite FROM assets", "assets")
def _set_flags(t):
    edits = t.assets.where("id % 5 = 0").select(F.col("id"), F.lit(1).alias("seq"), (F.col("id") % 2 == 1).alias("favorite")).unionByName(t.assets.where("id % 5 = 0").select("id", F.lit(2).alias("seq"), (F.col("id") % 2 == 0).alias("favorite")))
    return set_flags(t.assets.select("id", "favorite"), edits, ["favorite"])


@query("repair_states", f"WITH v AS ({VECTORS}) SELECT image_id, CASE WHEN state = 'preprocessing' OR state = 'ready' AND image_id NOT IN (SELECT vec_id FROM embeddings) THEN 'pending' ELSE state END AS state FROM v", "assets")
def _repair_states(t):
    return repair_states(_vectors(t), t.embeddings.select(F.col("vec_id").alias("image_id")))


@query("requeue", f"WITH v AS ({VECTORS}) SELECT image_id, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state FROM v", "assets")
def _requeue(t):
    return requeue(_vectors(t))


@query("fresh_rows", "WITH m AS (SELECT max(cached_at) AS t FROM cached_pages) SELECT chapter, page_index, cached_at FROM cached_pages, m WHERE cached_at > t - INTERVAL 90 DAY", "cached_pages")
def _fresh_rows(t):
    newest = t.cached_pages.agg(F.max("cached_at").alias("newest"))
    rows = t.cached_pages.join(F.broadcast(newest), F.lit(True))  # one row
    return fresh_rows(rows, F.col("newest"), F.expr("INTERVAL '90' DAY")).select("chapter", "page_index", "cached_at")


@query("resolve_aliases", "SELECT CASE WHEN tag_id % 7 = 0 THEN tag_id + 1 ELSE tag_id END AS tag_id, count(*) AS n FROM asset_tags GROUP BY 1", "asset_tags")
def _resolve_aliases(t):
    aliases = t.asset_tags.where("tag_id % 7 = 0").select(F.col("tag_id").alias("from_id"), (F.col("tag_id") + 1).alias("to_id")).distinct()
    return resolve_aliases(t.asset_tags, aliases).groupBy("tag_id").agg(F.count("*").alias("n"))


@query("expand_hierarchy", "WITH RECURSIVE e AS (SELECT CAST(id / 2 AS BIGINT) AS parent, id AS child FROM (SELECT id - id % 2 AS i, id FROM tags) WHERE false UNION ALL SELECT id // 3, id FROM tags WHERE id >= 3), r(ancestor, node, distance) AS (SELECT parent, child, 1 FROM e UNION ALL SELECT r.ancestor, e.child, r.distance + 1 FROM r JOIN e ON e.parent = r.node) SELECT ancestor, node, CAST(distance AS INT) AS distance FROM r", "tags")
def _expand_hierarchy(t):
    from .graph import closure

    return closure(t.tags.where("id >= 3").select(F.floor(F.col("id") / 3).alias("parent"), F.col("id").alias("child")))


@query("rollback_txn", "SELECT txn, count(*) FILTER (WHERE is_deleted OR txn = 2) AS deleted, count(*) AS n FROM asset_tags GROUP BY 1", "asset_tags")
def _rollback_txn(t):
    return rollback_txn(t.asset_tags, 2).groupBy("txn").agg(F.count_if("is_deleted").alias("deleted"), F.count("*").alias("n"))


@query("image_paths", "SELECT id, path FROM assets UNION SELECT id, '/old' || path FROM assets WHERE id % 4 = 0", "assets")
def _image_paths(t):
    seen = t.assets.where("id % 4 = 0").select("id", F.concat(F.lit("/old"), "path").alias("path"))
    return append_new(t.assets.select("id", "path"), seen.unionByName(t.assets.select("id", "path")), ["id", "path"])
