"""The asset model as views over the base tables; the SQL is the same for Spark and for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "assets": """
SELECT o_orderkey AS id, o_orderkey % 40 AS folder_id,
  CASE WHEN o_orderkey % 40 < 6 THEN concat('d', CAST(CAST(floor((o_orderkey % 40)/3.0) AS BIGINT) AS STRING), '-', CAST(CAST(floor(o_orderkey/40.0) AS BIGINT) AS STRING))
       ELSE concat('u', CAST(o_orderkey AS STRING)) END AS content_key,
  concat('/lib/f', CAST(o_orderkey % 40 AS STRING), '/', CASE o_orderkey % 10
   WHEN 0 THEN concat('artist_name_', CAST(10000000+o_orderkey AS STRING), '_p', CAST(o_orderkey % 4 AS STRING), '.png')
   WHEN 1 THEN concat('illust_', CAST(10000000+o_orderkey AS STRING), '_20230513_212357.jpg')
   WHEN 2 THEN concat('media_FR', CAST(o_orderkey AS STRING), 'd0XWUAImXfA.jpg')
   WHEN 3 THEN concat('__some_tags__', lpad(CAST(o_orderkey AS STRING), 32, '0'), '.JPG')
   WHEN 4 THEN '[Artist Name] Title (tag1 tag2,tag3).png'
   WHEN 5 THEN concat(CAST(1652448237+o_orderkey AS STRING), '.png')
   WHEN 6 THEN concat('random_no_match_', CAST(o_orderkey AS STRING), '.webp')
   WHEN 7 THEN concat('clip_', CAST(o_orderkey AS STRING), '.mp4')
   WHEN 8 THEN concat('[Grp] Some_Show - ', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ' [1080p].webm')
   ELSE concat('anim_', CAST(o_orderkey AS STRING), '.gif') END) AS path,
  o_orderdate AS created_at, (o_orderkey % 41 = 0) AS is_deleted, (o_orderkey % 17 = 0) AS is_missing,
  (o_orderpriority = '1-URGENT') AS favorite, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE)/97.0 END AS safe_score,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 89 AS DOUBLE)/89.0 END AS explicit_score
FROM orders
""",
    "tags": """
SELECT p_partkey AS id, concat(replace(p_name,' ','_'),'_',CAST(p_partkey AS STRING)) AS name,
 CASE p_partkey % 5 WHEN 0 THEN 'character' WHEN 1 THEN 'copyright' WHEN 2 THEN 'meta' WHEN 3 THEN 'user' ELSE 'general' END AS category FROM part
""",
    "sources": """
SELECT DISTINCT s_suppkey % 4 AS id, CASE s_suppkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'ai:tagger-a' WHEN 2 THEN 'ai:tagger-b' ELSE 'filename_parser' END AS name FROM supplier
""",
    "asset_tags": """
SELECT l_orderkey AS image_id, l_partkey AS tag_id, l_suppkey % 4 AS source_id, l_linenumber AS txn, l_discount + l_tax AS confidence,
 (l_returnflag = 'R') AS is_deleted, (l_returnflag = 'R' AND l_linestatus = 'F') AS is_blacklisted FROM lineitem
""",
    "detections": """
SELECT vec_id AS id, vec_id AS image_id, embedding AS vector, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label END AS identity_id FROM embeddings
""",
    "text_lines": """
SELECT conv_id*1000+turn AS id, conv_id AS image_id, text, (role='assistant') AS is_from_region FROM conversations
""",
    "boxes": """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT)*1000000000+l_partkey*10000+l_suppkey AS box_id, CAST(floor(l_quantity*8) AS BIGINT) AS x0, (l_partkey*7)%600 AS y0,
 CAST(floor(l_quantity*8) AS BIGINT)+80+l_suppkey AS x1, (l_partkey*7)%600+60+l_linenumber*10 AS y1, l_extendedprice/100000.0 AS confidence FROM lineitem
""",
    "history": """
SELECT user_id, event_id, event_type AS item, ts AS read_at FROM events
""",
    "cached_pages": """
SELECT l_orderkey AS chapter, l_linenumber AS page_index, CAST(floor(l_quantity) AS BIGINT)*1000 AS size_bytes, l_shipdate AS cached_at FROM lineitem
""",
    "progress": """
SELECT o_orderkey AS chapter, o_custkey AS series, 1 + o_orderkey % 7 AS page_total FROM orders WHERE o_orderkey % 3 <> 0
""",
    "urls": """
SELECT page_id, url FROM pages
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Base tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            if name not in BASE:
                raise AttributeError(name)
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._held:
            self._held[name] = self.sql(VIEWS[name])
        return self._held[name]

    def sql(self, text: str) -> DataFrame:
        """A statement over base tables."""
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in BASE:
            if name in words:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query over ``Tables``; ``sql`` is its oracle over base tables and ``views``."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            given = [f"{v} AS ({VIEWS[v].strip()})" for v in views.split()]
            body = sql.strip()
            recursive = ""
            if body.startswith("WITH RECURSIVE "):
                recursive, body = "RECURSIVE ", "WITH " + body[len("WITH RECURSIVE "):]
            if given:
                body = f"WITH {recursive}{', '.join(given)}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            elif recursive:
                body = "WITH RECURSIVE " + body[5:]
            ORACLE_SQL[name] = body
        return f

    return register
