"""The latest search wins; polling tells of changes only."""

import threading

from loomline.streaming import live


def test_latest_wins(spark):
    latest, got, go = live.LatestSearch(spark), [], threading.Event()

    def slow():
        go.wait(10)
        return [1]

    a = latest.start(slow, got.append)
    b = latest.start(lambda: spark.range(3).collect(), got.append)
    b.join(30)
    go.set()
    a.join(30)
    assert len(got) == 1 and len(got[0]) == 3


def test_changes(spark):
    looks = iter([[(1,)], [(1,)], [(1,), (2,)]])
    seen = list(live.changes(lambda: spark.createDataFrame(next(looks), "pid int"), 0, 3))
    assert [d.count() for d in seen] == [1, 2]
