"""Files as tables: what a scan finds, and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import query

#: Extensions of media files.
MEDIA = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tiff", "mp4", "webm")


def scan(spark: SparkSession, paths: str | Sequence[str], extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """``(path, size_bytes, mtime)`` of the files at or below some paths; contents are not read.

    Below a folder only files with one of the extensions count; a path that is a file counts whatever its
    name, and one that isn't there counts for nothing. A file that several paths reach is one row.
    """
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    folders, files = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            (folders if fs.getFileStatus(p).isDirectory() else files).append(path)
    read = lambda own: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(own)
    found = [read(folders).where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*extensions))] if folders else []
    found += [read(files)] if files else []
    cols = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    rows = [x.select(*cols) for x in found]
    if not rows:
        return spark.createDataFrame([], "path string, size_bytes long, mtime timestamp")
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]).dropDuplicates(["path"])


def content_hash(content: Column, readable: Column | None = None, head: int = 65536) -> Column:
    """SHA-256 of the whole content; of its first bytes where it can't be read whole."""
    whole = F.sha2(content, 256)
    return whole if readable is None else F.when(readable, whole).otherwise(F.sha2(F.substring(content, 1, head), 256))


@query("media_scan")
def _media_scan(t):
    found = scan(t.spark, t.sf_dir, ("parquet",))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size_bytes")


@query("content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
@query("content_hash_all", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _content_hash(t):
    return t.documents.select("doc_id", content_hash(F.col("text").cast("binary")).alias("sha"))
