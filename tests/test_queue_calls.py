"""A batch's events of an image read and write its state once, however many they are."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Row

from shoal.streaming.queue import ImageQueue


class Held:
    """State and timers that count their calls."""

    def __init__(self):
        self.now, self.calls = None, Counter()

    def get(self):
        self.calls["get"] += 1
        return self.now

    def update(self, value):
        self.calls["update"] += 1
        self.now = value

    def registerTimer(self, at):
        self.calls["timer"] += 1

    def deleteTimer(self, at):
        self.calls["gone"] += 1


def test_one_read_and_one_write():
    queue, held = ImageQueue(), Held()
    queue.held = queue.handle = held
    event = lambda at, kind, checksum: Row(kind=kind, checksum=checksum, label=None, score=None, at=at)
    out = list(queue.handleInputRows((7,), iter([event(3, "add", "b"), event(1, "add", None), event(2, "remove", None)]), None))
    assert [(r.state, r.step) for r in out] == [("waiting", 0), ("removed", 1), ("ready", 2)]
    assert dict(held.calls) == {"get": 1, "update": 1, "timer": 1}
