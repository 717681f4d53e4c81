"""Small cases with known answers, and operators beyond SQL against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F

from shoal.functions import names
from shoal.functions.vectors import cosine_distance, vector_checksum
from shoal.operators import boxes, changes, details, filters, groups, ranking, similarity, stats, windows
from shoal.operators.graph import closure, connected
from shoal.plans.search import Library, Search, search, text_matches
from shoal.sources import files
from shoal.sources.views import Tables
from shoal.streaming import indexing


def parse(spark, name, rule, **options):
    row = spark.createDataFrame([(name,)], "s string").select(rule(F.col("s"), **options).alias("m")).first().m
    return row


@pytest.mark.parametrize("name,rule,field,value,tags", [
    ("1652448237000", names.parse_epoch, "datetime_iso", "2022-05-13 13:23:57 UTC", ["date:2022-05-13"]),
    ("illust_108521179_20230513_212357", names.parse_pixiv, "pixiv_id", "108521179", ["pixiv:108521179", "date:2023-05-13"]),
    ("gwitch_suletta_Mineori_108521179_p0", names.parse_pixiv, "artist", "gwitch_suletta_Mineori", ["pixiv:108521179", "page:0", "artist:gwitch_suletta_Mineori"]),
    ("media_FR49d0XWUAImXfA", names.parse_twitter, "twitter_id", "FR49d0XWUAImXfA", None),
    ("status_artist_handle-165244823700012345", names.parse_twitter, "twitter_id", "status_artist_handle-165244823700012345", None),
    ("[Kantoku] Shizuku (1girl solo blue_eyes)", names.parse_tagged, "artist", "Kantoku", ["artist:Kantoku", "1girl", "solo", "blue_eyes"]),
    ("[Grp] Some_Show - 12 [1080p]", names.parse_episode, "partial", False, ["anime:Some Show", "episode:12", "resolution:1080p", "group:Grp"]),
    ("[Grp] - 07 [720P]", names.parse_episode, "partial", True, ["episode:07", "resolution:720p", "group:Grp"]),
    ("(Rip) A.Show_EP3", names.parse_episode, "match_type", "anime_screenshot", ["anime:A Show", "episode:3"]),
    ("1652448237000", names.parse_epoch, "match_type", "4chan_timestamp", None),
])
def test_names(spark, name, rule, field, value, tags):
    got = parse(spark, name, rule)
    assert got[field] == value
    assert tags is None or got.tags == tags


def test_names_without_match(spark):
    for rule in (names.parse_epoch, names.parse_pixiv, names.parse_twitter, names.parse_tagged):
        assert parse(spark, "just_a_random_filename", rule) is None
    assert parse(spark, "9999999999", names.parse_epoch) is None  # a year beyond what is plausible
    assert parse(spark, "artist_123_p9", names.parse_pixiv) is None


def test_token_rule(spark):
    B = names.Block
    pattern = names.token_pattern([B("artist"), B("delimiter", "_"), B("pixiv_id")])
    assert pattern == r"^(?P<artist>[A-Za-z0-9_\-\s]+)_(?P<pixiv_id>\d{7,10})$"
    got = parse(spark, "Mineori_108521179", names.parse_custom, pattern=pattern)
    assert (got.artist, got.pixiv_id) == ("Mineori", "108521179")
    hidden = names.token_pattern([B("artist", enabled=False), B("delimiter"), B("pixiv_id")])
    assert parse(spark, "Mineori_108521179", names.parse_custom, pattern=hidden).artist is None
    assert parse(spark, "x", names.parse_custom, pattern="(") is None


@pytest.mark.parametrize("blocks,name,tags", [
    ([("timestamp_4chan", {}), ("delimiter", {"value": "-"}), ("number", {})], "1652448237-12", ["date:2022-05-13", "number:12"]),
    ([("md5_hash", {}), ("whitespace", {}), ("bracketed", {"label": "by"})], "0123456789abcdef0123456789abcdef [me]", ["hash:0123456789abcdef0123456789abcdef", "by:me"]),
    ([("wildcard", {}), ("delimiter", {}), ("twitter_id", {"prefix": "id="})], "any thing_id=FR49d0XWUAImXfA", ["twitter:FR49d0XWUAImXfA", "wildcard:any thing"]),
    ([("wildcard", {}), ("delimiter", {}), ("twitter_id", {"prefix": "id="})], "_FR49d0XWUAImXfA", ["twitter:FR49d0XWUAImXfA"]),
    ([("tag", {}), ("no such kind", {"prefix": "x"}), ("delimiter", {"value": "."}), ("number", {"enabled": False})], "blue_eyes.5", ["blue_eyes"]),
    ([("tag", {}), ("tag", {})], "ab", None),  # two groups of one name are no pattern
    ([("md5_hash", {})], "0123", None),
])
def test_token_blocks(spark, blocks, name, tags):
    got = parse(spark, name, names.parse_custom, pattern=names.token_pattern([names.Block(k, **o) for k, o in blocks]))
    assert (got and got.tags) == tags


def test_sequence_decoding(spark):
    best = [1, 1, 0, 2, 3, 3, 0, 4]  # H H - E L L - O
    rows = [(0, k, c, 0.9 if c == b else 0.02) for k, b in enumerate(best) for c in range(5)]
    got = windows.decoded(spark.createDataFrame(rows, "line long, step int, class int, score double"), "HELO").first()
    assert got.text == "HELO" and abs(got.confidence - 0.9) < 1e-9


def test_tag_orders(spark):
    rows = spark.createDataFrame([("user", 0.9), ("character", 0.1), ("meta", 0.8), ("copyright", 0.7)], "category string, confidence double")
    order = [r.category for r in rows.orderBy(details.tagger_priority(F.col("category")), F.desc("confidence")).collect()]
    assert order == ["character", "copyright", "meta", "user"]


def test_vector_order_and_lists(spark):
    rows = spark.createDataFrame([(101, [1.0, 0.0, 0.0, 0.0]), (102, [0.0, 1.0, 0.0, 0.0]), (103, [0.7071, 0.7071, 0.0, 0.0])], "vec_id long, embedding array<double>")
    v = similarity.unit(rows)
    assert [r.id for r in similarity.knn_exact(v.where("id = 101"), v, 10).orderBy("rank").collect()] == [103, 102]
    d = rows.select(cosine_distance(F.col("embedding"), F.col("embedding")).alias("d")).collect()
    assert all(abs(r.d) < 1e-9 for r in d)
    t = Tables(spark, "/root/testdata/sf0.01")
    every = similarity.unit(t.embeddings)
    asked = every.where("id % 20 = 0")
    exact = {(r.query_id, r.id) for r in similarity.knn_exact(asked, every).collect()}
    found = {(r.query_id, r.id) for r in similarity.knn_lists(asked, every).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert similarity.knn_lists(asked, every.limit(0)).count() == 0


def test_hash_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    h = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 13))) for b in base for _ in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    table = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    got = {(r.a, r.b, r.distance) for r in similarity.hash_pairs(table).collect()}
    want = {(min(a, b), max(a, b), ((a ^ b) & (1 << 64) - 1).bit_count()) for a, b in itertools.combinations(set(signed), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 10}
    assert got == want and len(want) > 50


def test_suppression_against_plain_loop(spark):
    t = Tables(spark, SF)
    got = Counter((r.image_id, r.box_id) for r in boxes.suppressed(t.boxes).collect())
    want = Counter()
    for image, rows in itertools.groupby(sorted(t.boxes.collect(), key=lambda r: (r.image_id, -float(r.confidence), r.box_id)), key=lambda r: r.image_id):
        kept = []
        for r in rows:
            def iou(a, b):
                w, h = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)), max(0, min(a.y1, b.y1) - max(a.y0, b.y0))
                area = lambda x: (x.x1 - x.x0) * (x.y1 - x.y0)
                return w * h / (area(a) + area(b) - w * h)
            if all(iou(k, r) <= 0.5 for k in kept):
                kept.append(r)
        want.update((image, r.box_id) for r in kept)
    assert got == want


def test_merged_fragments(spark):
    rows = [(1, 0, 0, 10, 10), (1, 15, 1, 30, 11), (1, 100, 0, 120, 10), (1, 0, 50, 10, 60), (2, 5, 5, 6, 6)]
    got = windows.merged_fragments(spark.createDataFrame(rows, "image_id long, x0 long, y0 long, x1 long, y1 long")).orderBy("image_id", "place").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 0, 30, 11), (100, 0, 120, 10), (0, 50, 10, 60), (5, 5, 6, 6)]


def test_merging_against_the_plain_rule():
    """The first pair that can be joined is, from the start each time."""
    def plain(rows, gap=10):
        rows = sorted(rows, key=lambda b: (b[1], b[0]))
        for k in range(len(rows) - 1):
            for j in range(k, -1, -1):
                if abs(rows[j + 1][1] - rows[j][1]) < gap and rows[j + 1][0] < rows[j][0]:
                    rows[j], rows[j + 1] = rows[j + 1], rows[j]
                else:
                    break
        while True:
            pair = next(((p, q) for p, q in itertools.combinations(range(len(rows)), 2) if abs(rows[p][1] - rows[q][1]) <= gap and abs(rows[p][3] - rows[q][3]) <= gap and max(rows[p][0], rows[q][0]) - min(rows[p][2], rows[q][2]) <= gap), None)
            if pair is None:
                return rows
            p, q = rows[pair[0]], rows.pop(pair[1])
            rows[pair[0]] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))

    rng = random.Random(6)
    for _ in range(400):
        boxes = [(x, y, x + rng.randint(1, 40), y + rng.randint(5, 20)) for x, y in ((rng.randint(0, 200), rng.randint(0, 40)) for _ in range(rng.randint(0, 14)))]
        assert windows.merge_boxes(boxes) == plain(boxes)


def test_positions_of_one_moment(spark):
    """All assets of one time: places come from sorted parts, not from one task."""
    rows = spark.range(1, 500).select("id", F.lit("2020-01-01 10:00:00").cast("timestamp").alias("created_at"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_missing"))
    assert {r.id: r.position for r in windows.gallery_position(rows, rows.where("id < 5")).collect()} == {k: 499 - k for k in range(1, 5)}


def test_blocks_merge(spark, monkeypatch):
    """Several blocks on either side give what one block gives."""
    v = similarity.unit(Tables(spark, SF).embeddings)
    asked = v.where("id % 7 = 0")
    found = Tables(spark, SF).detections
    run = lambda: (sorted(map(tuple, similarity.knn_exact(asked, v, 5).select("query_id", "rank", "id").collect())), sorted(map(tuple, similarity.identity_match(found, found, 0.96).select("detection_id", "identity_id").collect())))
    one = run()
    monkeypatch.setattr(similarity, "ROWS", 16)
    monkeypatch.setattr(similarity, "QUERIES", 5)
    assert run() == one and len(one[0]) == 5 * asked.count()


def test_search_plans_without_jobs(spark):
    """Full text is one scan without a join; tags with other evidence need no job before the plan runs."""
    from shoal.plans.search import library

    lib = library(Tables(spark, SF))
    assert "Join" not in text_matches(lib.lines, 'the OR "in the" NOT of')._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setJobGroup("planning", "")
    search(lib, Search(tags=["a"], content_key="c1", text="the", filename="x"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unclassified_by_folder(spark):
    rows = spark.createDataFrame([(1, 1, "/a", None, 0.1), (2, 1, "/b", 0.1, None), (3, 2, "/c", None, None)], "id long, folder_id long, path string, safe_score double, hentai_score double").withColumns({c: F.lit(0.0) for c in ("porn_score", "sexy_score", "drawing_score")} | {c: F.lit(False) for c in ("is_deleted", "is_missing")})
    ids = lambda **o: sorted(r.id for r in filters.unclassified(rows, **o).collect())
    assert ids() == [1, 2, 3] and ids(folder_id=1) == [1]


def test_graph_loops(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91), (91, 90)], "u long, v long")
    assert dict(map(tuple, connected(chain).collect())) == {**{k: 0 for k in range(41)}, 90: 90, 91: 90}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    got = {(r.ancestor, r.node): r.distance for r in closure(cycle).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 3): 1, (2, 1): 2, (2, 4): 2, (3, 1): 1, (3, 4): 1, (3, 2): 2}


def test_new_identities(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16)) * 5
    rows = [(k, (centres[k % 6] + rng.normal(size=16) * 0.2).tolist()) for k in range(60)]
    v = similarity.unit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.id: r.identity_id for r in groups.new_identities(v, 10, 0.1).collect()}
    assert len(got) == 60 and set(got.values()) == set(range(11, 17)) and all(got[k] == 11 + k % 6 for k in got)


def test_checksum(spark):
    got = spark.createDataFrame([(1, [1.0, 2.5]), (2, None)], "id long, v array<float>").select("id", vector_checksum(F.col("v")).alias("c")).collect()
    assert got[0].c == hashlib.sha256(np.array([1.0, 2.5], "<f4").tobytes()).hexdigest() and got[1].c is None


def test_text_search(spark):
    lines = spark.createDataFrame([(1, 10, "HELLO OCR WORLD"), (2, 11, "world of hello"), (3, 12, None), (4, 13, "")], "id long, image_id long, text string")
    ask = lambda q: sorted(r.image_id for r in text_matches(lines, q).collect())
    assert ask("hello world") == [10, 11] and ask('"ocr world"') == [10] and ask("hello NOT of") == [10]
    assert ask("wor*") == [10, 11] and ask("ocr OR of") == [10, 11] and ask("nothing") == []


def test_hybrid_search_set_order(spark):
    assets = spark.createDataFrame([(k, f"c{k}", f"/f/{'pic' if k % 2 else 'clip'}{k}.png", f"2020-01-0{k}", False, k == 6, False) for k in range(1, 8)], "id long, content_key string, path string, created_at string, is_deleted boolean, is_missing boolean, favorite boolean")
    tags = spark.createDataFrame([(1, "blue_sky", "general"), (2, "red", "general")], "id long, name string, category string")
    held = spark.createDataFrame([(1, 1, 1, False), (2, 1, 1, False), (2, 2, 1, False), (3, 2, 1, True)], "image_id long, tag_id long, source_id long, is_deleted boolean")
    hashes = spark.createDataFrame([(1, 0), (2, 3), (3, -1)], "id long, hash long")
    vectors = similarity.unit(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    parsed = spark.createDataFrame([], "image_id long, artist string, pixiv_id string, twitter_id string, match_type string, extracted_tags string, raw_matched string")
    found = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "image_id long, identity_id int")
    lines = spark.createDataFrame([(1, 2, "hello"), (2, 4, "world")], "id long, image_id long, text string")
    lib = Library(assets, held, tags, hashes, vectors, parsed, found, lines)
    ids = lambda **ask: [r.id for r in search(lib, Search(**ask)).collect()]
    assert ids(identity=5) == [1, 2] and ids(identity=5, has_text=True) == [2]
    assert ids(identity=5, text="world") == [4]  # a text match replaces what came before
    assert ids(content_key="c3", image_hash=0) == [3, 1, 2]
    assert ids(tags=["Blue Sky"]) == [1, 2] and ids(tags=["blue_sky", "red"]) == [2]
    assert ids(tags=["blue_sky"], filename="pic") == [1, 2]  # nothing but tags counts
    assert ids(tags=["blue_sky"], content_key="c2") == [2]
    assert ids(filename="clip") == [2, 4]  # 6 is missing
    assert ids(limit=2) == [7]  # the newest two, missing dropped after the limit


def test_cascade_and_identities(spark):
    gone = spark.createDataFrame([(10,)], "image_id long")
    child = spark.createDataFrame([(10, 1), (11, 2)], "image_id long, x int")
    assert [r.image_id for r in changes.cascade_delete(gone, {"c": child})["c"].collect()] == [11]
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "identity_id long, name string")
    found = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, identity_id long")
    left, moved = changes.identity_merge(ids, found, spark.createDataFrame([(2, "a")], "identity_id long, name string"))
    assert [r.identity_id for r in left.collect()] == [1]
    assert sorted((r.id, r.identity_id) for r in moved.collect()) == [(1, 1), (2, 1), (3, None)]
    with pytest.raises(ValueError):
        changes.merge_folders(spark.createDataFrame([], "folder_id long"), spark.createDataFrame([(1,)], "id long"), 1, 1)


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    for parts in (1, 7):
        got = changes.numbered(rows.repartition(parts), ["k"], 100).collect()
        assert {r.k: r.id for r in got} == {k: 101 + k for k in range(1000)}


def test_empty_library(spark):
    t = Tables(spark, SF)
    none = t.assets.limit(0)
    assert stats.storage_stats(none).count() == 0 and stats.folder_overlap(none).count() == 0
    assert filters.live(none).count() == 0 and ranking.gallery_page(none, 10, 5).count() == 0
    assert windows.gallery_position(none, none).count() == 0 and windows.evicted(none.select("id", F.lit(1).alias("kind"), "created_at"), 10).count() == 0


def test_scan_and_hash(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.PNG", "a/y.txt", "z.mp4"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r.path.rsplit("/", 1)[1]: r.size_bytes for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"x.PNG": 7, "z.mp4": 5}
    # several paths: a single file counts whatever its name, one that isn't there counts for nothing
    got = [r.path.rsplit("/", 1)[1] for r in files.scan(spark, [f"{tmp_path}/a", f"{tmp_path}/a/y.txt", f"{tmp_path}/a/x.PNG", f"{tmp_path}/none"]).collect()]
    assert sorted(got) == ["x.PNG", "y.txt"] and files.scan(spark, [f"{tmp_path}/none"]).count() == 0
    row = spark.createDataFrame([(bytearray(b"abc" * 40000), True), (bytearray(b"abc" * 40000), False)], "c binary, ok boolean").select(files.content_hash(F.col("c"), F.col("ok")).alias("h")).collect()
    assert row[0].h == hashlib.sha256(b"abc" * 40000).hexdigest() and row[1].h == hashlib.sha256((b"abc" * 40000)[:65536]).hexdigest()


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    schema = "image_id long, vector array<float>, logits array<double>"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    gone = spark.createDataFrame([(9,)], "image_id long")
    stream = lambda: indexing.incoming(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    run = lambda **o: {r.image_id: r for r in indexing.run_index(stream(), f"{tmp_path}/run", deleted=gone, **o).collect()}
    states = lambda rows: {k: r.state for k, r in rows.items()}
    put([(1, [1.0], [0.0, 2.0, 1.0]), (2, None, [1.0]), (9, [1.0], None)])
    first = run()
    assert states(first) == {1: "ready", 2: "failed"} and first[1].label == 1 and first[2].label is None
    assert abs(first[1].score - np.exp(2) / (1 + np.exp(2) + np.e)) < 1e-12
    assert run() == first and run() == first  # nothing new: the state is still there
    put([(2, [3.0], None), (3, [2.0], [1.0, 1.0]), (1, None, None)])

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        run(step=broken)
    assert {r.image_id: r.state for r in indexing.state(spark, f"{tmp_path}/run").collect()} == {1: "preprocessing", 2: "preprocessing", 3: "preprocessing"}
    after = run()
    assert states(after) == {1: "failed", 2: "ready", 3: "ready"} and after[3].label == 0
    assert after[1].checksum == first[1].checksum  # a failure keeps what was known
    for k in range(10, 21):  # beyond a version that holds the whole state
        put([(k, [1.0], None)])
    assert len(run()) == 14 and [f for _, f in indexing.versions(spark, f"{tmp_path}/run") if f.endswith("-whole")]
