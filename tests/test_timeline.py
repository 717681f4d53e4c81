"""Pages and places from the tree of counts against sorting everything."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from plan_metrics import rows_read

from shoal.operators.timeline import Timeline
from shoal.shared import fresh_path

SCHEMA = "id long, created_at timestamp"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] or dt.datetime.min, r[0]), reverse=True)


def test_against_sorting(spark):
    rng = random.Random(1)
    start = dt.datetime(2021, 12, 30)
    rows = [(k, None if k % 40 == 0 else start + dt.timedelta(minutes=rng.randrange(6000) // 30 * 30)) for k in range(500)]
    line = Timeline.create(table(spark, rows[:300]), fresh_path(spark, "timeline"))
    line.append(table(spark, rows[300:] + [(None, start)]))
    gone = [r for r in rows if r[0] % 7 == 0]
    line.remove(table(spark, gone + [(9999, start), (1, start - dt.timedelta(days=1))]))
    back = gone[::3]
    line.append(table(spark, back))
    want = in_order([r for r in rows if r[0] % 7 or r in back])
    assert line.total() == len(want)
    for limit, offset in ((10, 0), (25, 100), (7, len(want) - 3), (1000, 0), (5, len(want)), (0, 0), (3, len(want) - 12)):
        assert list(map(tuple, line.page(limit, offset).collect())) == want[offset : offset + limit]
    for k in (0, 5, 200, len(want) - 1):
        assert line.position(*want[k]) == k
    assert line.position(gone[1][0], gone[1][1]) is None and line.position(1, start) is None
    rows_, page, pages, total = line.clamped(99, 50)
    assert (page, pages, total) == (-(-len(want) // 50),) * 2 + (len(want),) and [r.id for r in rows_.collect()] == [r[0] for r in want[(page - 1) * 50 :]]


def test_empty(spark):
    line = Timeline.create(table(spark, []), fresh_path(spark, "timeline"))
    assert line.total() == 0 and line.page(5).count() == 0 and line.position(1, None) is None
    assert line.clamped(3, 10)[1:] == (1, 1, 0)


@pytest.mark.parametrize("offset", [10, 1_000_000])
def test_an_offset_of_a_million_reads_its_hours(spark, offset):
    n = 1_200_000
    rows = spark.range(n).selectExpr("id", "timestamp'2020-01-01' + make_dt_interval(0, 0, 0, id * 4) AS created_at")  # 900 an hour
    line = Timeline.create(rows, fresh_path(spark, "timeline"))
    page = line.page(20, offset)
    assert [r.id for r in page.collect()] == list(range(n - 1 - offset, n - 21 - offset, -1))
    assert rows_read(page) < 30_000  # a few pages of two hours, of 1333
