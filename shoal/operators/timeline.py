"""Pages and places of a gallery from a tree of counts, kept with the rows.

Rows lie in folders of months, sorted by time in small pages; beside them a table has how many there are in each year, day and
hour. A page far back, or the place of one asset, goes down the tree (the years, then one year's days, then
one day's hours) and reads the hours it lies in. Appends and removals add a generation of rows and of
counts, so the tree is kept up without being built again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_path, written
from ..sources.generations import Generations
from ..sources.views import query
from .filters import live

#: Rows of a page of a file: what a bucket's read is rounded up to.
PAGE = 1 << 12
LEVELS = ("year", "day", "hour")
#: Rows without a time come last: they have this one, before any that a file may have.
NEVER = dt.datetime(1600, 1, 1)
ROWS, COUNTS = "id long, at long, month int", "day date, hour int, n long, year int"


def _bucket(at: Column) -> list[Column]:
    return [F.year(at).alias("year"), F.to_date(at).alias("day"), F.hour(at).alias("hour")]


def _month(at: Column) -> Column:
    return F.year(at) * 100 + F.month(at)


def _micros(time: dt.datetime) -> Column:
    """A wall-clock time of the session's zone as stored: microseconds, whose pages Parquet's readers can tell apart."""
    return F.unix_micros(F.to_timestamp(F.lit(time.isoformat(sep=" "))))


class Timeline(Generations):
    """Ids in order of time, newest first and then largest id first; one writer at a time.

    Rows are ``(id, created_at)``, times from 1601 on; those without one come last. Ids are distinct among the rows that are there;
    null ids are left out.
    """

    @classmethod
    def create(cls, rows: DataFrame, path: str) -> Timeline:
        line = cls(rows.sparkSession, path)
        line._log(0, "made")
        line.append(rows)
        return line

    @staticmethod
    def _timed(rows: DataFrame) -> DataFrame:
        return rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), _micros(NEVER)).alias("at"))

    def append(self, rows: DataFrame) -> None:
        """Further rows, as a generation of their own with its counts."""
        _, _, seq = self._state()
        placed = self._timed(rows).withColumn("month", _month(F.timestamp_micros("at")))
        order = ["month", "at", "id"]  # a month of very many rows is cut by time and id
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        sorted_rows.write.option("parquet.page.row.count.limit", PAGE).partitionBy("month").mode("overwrite").parquet(f"{self.path}/rows/seq={seq}")
        self._count(self._read("rows", [seq], ROWS), seq, 1)
        self._log(seq, "rows")

    def _count(self, rows: DataFrame, seq: int, sign: int) -> None:
        counts = rows.groupBy(*_bucket(F.timestamp_micros("at"))).agg((F.count("*") * sign).alias("n"))
        counts.coalesce(1).sortWithinPartitions("day", "hour").write.partitionBy("year").mode("overwrite").parquet(f"{self.path}/counts/seq={seq}")

    def remove(self, keys: DataFrame) -> None:
        """Take out ``(id, created_at)``; only the months of these times are read, and what isn't there is left out."""
        _, _, seq = self._state()
        wanted, _ = written(self._timed(keys).distinct(), "wanted")
        months = [r.month for r in wanted.select(_month(F.timestamp_micros("at")).alias("month")).distinct().collect()]  # a row a month
        there = self._rows(months).join(wanted, ["id", "at"], "left_semi")
        there, _ = written(there, "there")
        there.select(F.col("id").alias("key")).distinct().write.mode("overwrite").parquet(f"{self.path}/gone/seq={seq}")
        self._count(there, seq, -1)
        self._log(seq, "gone")

    def _rows(self, months: list[int], begin: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """Rows that are there, of some months and from ``begin`` to before ``end``."""
        table = self._read("rows", self._state()[0]["rows"], ROWS).where(F.col("month").isin(months))
        if begin is not None:
            table = table.where((F.col("at") >= _micros(begin)) & (F.col("at") < _micros(end)))
        return self._live(table, "id").select("id", "at")

    def _counts(self) -> DataFrame:
        kinds = self._state()[0]
        return self._read("counts", sorted(kinds["rows"] + kinds.get("gone", [])), COUNTS)

    def _level(self, level: str, **within) -> list[tuple]:
        """Buckets of a level inside one of the level above, latest first, with their counts."""
        rows = self._counts()
        for name, value in within.items():
            rows = rows.where(F.col(name) == F.lit(value))
        found = rows.groupBy(level).agg(F.sum("n").alias("n")).where("n > 0").collect()  # years, days of a year, hours of a day
        return sorted(((r[0], r.n) for r in found), reverse=True)

    def _months(self) -> list[int]:
        return [r[0] for r in self._counts().select(_month(F.col("day"))).distinct().collect()]  # a row a month

    def total(self) -> int:
        return self._counts().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _at(self, place: int) -> tuple[dt.datetime, int] | None:
        """The hour that has the row of a place (from 0), and how many rows come before that hour."""
        within, before = {}, 0
        for level in LEVELS:
            for value, n in self._level(level, **within):
                if place < before + n:
                    within[level] = value
                    break
                before += n
            else:
                return None
        return dt.datetime.combine(within["day"], dt.time(within["hour"])), before

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``(id, created_at)`` of the places from ``offset``, at most ``limit``; nothing beyond the end."""
        first = self._at(offset) if limit > 0 and offset >= 0 else None
        if first is None:
            return self.spark.createDataFrame([], "id long, created_at timestamp")
        last = self._at(offset + limit - 1)
        lo = last[0] if last else NEVER
        end = first[0] + dt.timedelta(hours=1)
        months = [m for m in self._months() if lo.year * 100 + lo.month <= m <= first[0].year * 100 + first[0].month]
        rows = self._rows(months, lo, end).orderBy(F.desc("at"), F.desc("id")).offset(offset - first[1]).limit(limit)
        return rows.select("id", F.when(F.col("at") != _micros(NEVER), F.timestamp_micros("at")).alias("created_at"))

    def position(self, id_: int, created_at: dt.datetime | None) -> int | None:
        """The place (from 0) of a row; None if it isn't there."""
        time = F.to_timestamp(F.lit(NEVER.isoformat(sep=" "))) if created_at is None else F.lit(created_at)
        year, day, hour, at = self.spark.sql("SELECT * FROM VALUES (0) AS one(x)").select(*_bucket(time), F.unix_micros(time)).first()
        before = 0
        for level, value, within in (("year", year, {}), ("day", day, {"year": year}), ("hour", hour, {"year": year, "day": day})):
            before += sum(n for v, n in self._level(level, **within) if v > value)
        begin = dt.datetime.combine(day, dt.time(hour))
        rows = self._rows([day.year * 100 + day.month], begin, begin + dt.timedelta(hours=1))
        earlier = (F.col("at") > at) | (F.col("at") == at) & (F.col("id") > id_)
        n, there = rows.agg(F.count_if(earlier), F.coalesce(F.bool_or((F.col("at") == at) & (F.col("id") == id_)), F.lit(False))).first()
        return before + n if there else None

    def clamped(self, page: int, size: int) -> tuple[DataFrame, int, int, int]:
        """A page's rows, its number within [1, number of pages], the number of pages and of rows."""
        total = self.total()
        pages = max(1, -(-total // size))
        page = min(max(1, page), pages)
        return self.page(size, (page - 1) * size), page, pages, total


def _kept_up(t) -> Timeline:
    """The live assets' timeline after an append, a removal and a return."""
    rows = live(t.assets).select("id", "created_at")
    early = F.col("id") % 3 > 0
    line = Timeline.create(rows.where(early), fresh_path(t.spark, "timeline"))
    line.append(rows.where(~early))
    line.remove(rows.where("id % 50 = 1"))
    line.append(rows.where("id % 50 = 1"))
    return line


@query("timeline_page", "SELECT id, CAST(created_at AS DATE) AS created_at FROM assets WHERE NOT is_deleted AND NOT is_missing ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 1000", "assets")
def _timeline_page(t):
    return _kept_up(t).page(200, 1000).select("id", F.col("created_at").cast("date").alias("created_at"))


@query("timeline_position", "WITH r AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS place FROM assets WHERE NOT is_deleted AND NOT is_missing) SELECT id, place FROM r WHERE id = (SELECT min(id) FROM r)", "assets")
def _timeline_position(t):
    one = live(t.assets).orderBy("id").select("id", F.col("created_at").cast("timestamp").alias("at")).first()
    place = _kept_up(t).position(one.id, one.at)
    return live(t.assets).where(F.col("id") == one.id).select("id", F.lit(place).cast("long").alias("place"))
