"""The keyed queue: batches of sixteen, kill and restart, late deletes, retries and times to live."""

from __future__ import annotations

import datetime as dt

import pytest

from shoal.shared import fresh_path
from shoal.streaming import queue
from shoal.streaming.indexing import incoming

MINUTE = 60
START = dt.datetime(2024, 1, 1)


def event(image, seconds, vector=None, kind="add", logits=None):
    return (image, kind, vector, logits, START + dt.timedelta(seconds=seconds))


def arrive(spark, folder, *files):
    """Each list of events is a file, and so a micro-batch."""
    for rows in files:
        spark.createDataFrame(rows, queue.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, **options):
    stream = incoming(spark, folder, spark.createDataFrame([], queue.EVENTS).schema)
    return queue.run_queue(stream, path, **options)


def history(log):
    out = {}
    for r in sorted(log.collect(), key=lambda r: (r.image_id, r.step)):
        out.setdefault(r.image_id, []).append(r.state)
    return out


@pytest.fixture(scope="module", autouse=True)
def own_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


V = [1.0, 2.0]


def test_states_retries_and_life(spark):
    folder, path = fresh_path(spark, "events"), fresh_path(spark, "queue")
    arrive(spark, folder, [event(1, 0, V, logits=[0.0, 3.0]), event(2, 0), event(3, 0), event(4, 0, V)])
    arrive(spark, folder, [event(98, 65, V)], [event(98, 66, V)])  # time goes on: what waits for a minute is due
    arrive(spark, folder, [event(3, 90, V), event(4, 70, kind="remove"), event(9, 95)])
    arrive(spark, folder, [event(99, 3600, V)])
    log = run(spark, folder, path, tries=2, life=50 * MINUTE * 1000)
    got = history(log)
    assert got[1] == ["ready", "stale"]
    assert got[2] == ["waiting", "pending", "failed"]  # nobody sent it again
    assert got[3] == ["waiting", "pending", "ready", "stale"] and got[4] == ["ready", "removed"]
    rows = {r.image_id: r for r in queue.current(log).collect()}
    assert set(rows) == {1, 2, 3, 9, 98, 99} and rows[1].label == 1 and rows[1].checksum and rows[99].state == "ready"
    assert rows[2].tries == 2 and rows[3].state == "stale"


def test_removed_later_and_added_again(spark):
    folder, path = fresh_path(spark, "events"), fresh_path(spark, "queue")
    arrive(spark, folder, [event(1, 0, V), event(2, 0)])
    assert history(run(spark, folder, path)) == {1: ["ready"], 2: ["waiting"]}
    arrive(spark, folder, [event(1, 10, kind="remove"), event(2, 10, kind="remove")])
    log = run(spark, folder, path)  # a run of its own: the state is the stream's, not the run's
    assert history(log) == {1: ["ready", "removed"], 2: ["waiting", "removed"]} and queue.current(log).count() == 0
    arrive(spark, folder, [event(1, 20, [3.0])])
    log = run(spark, folder, path)
    assert [(r.image_id, r.state) for r in queue.current(log).collect()] == [(1, "ready")]


def test_batches_of_sixteen_and_a_killed_run(spark):
    folder, path, marks = fresh_path(spark, "events"), fresh_path(spark, "queue"), fresh_path(spark, "marks").removeprefix("file://")
    arrive(spark, folder, [event(k, 0, V) for k in range(40)], [event(40 + k, 1, V) for k in range(40)])

    def embed(frame):
        import pathlib

        assert len(frame) <= 16
        mark = pathlib.Path(marks)
        if (frame["image_id"] >= 40).any() and not mark.exists():
            mark.parent.mkdir(parents=True, exist_ok=True)
            mark.touch()
            raise RuntimeError("the worker is gone")
        return frame

    with pytest.raises(Exception, match="the worker is gone"):
        run(spark, folder, path, embed=embed)
    assert spark.read.schema(queue.LOG).parquet(f"{path}/log").count() == 40  # the first batch stands
    log = run(spark, folder, path, embed=embed)
    assert history(log) == {k: ["ready"] for k in range(80)}  # each once


def test_null_ids_and_nothing_new(spark):
    folder, path = fresh_path(spark, "events"), fresh_path(spark, "queue")
    arrive(spark, folder, [event(None, 0, V), event(1, 0, []), event(1, 1, V)])
    assert history(run(spark, folder, path)) == {1: ["waiting", "ready"]}
    assert history(run(spark, folder, path)) == {1: ["waiting", "ready"]}
