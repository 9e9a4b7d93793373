import random

from eventloom.operators import windows as w
from eventloom.plans.incremental import WindowStore

SCHEMA = "g long, c string, t_us long"


def test_deliveries_equal_one(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 12), rnd.choice("abc"), rnd.randint(0, 100_000)) for _ in range(2000)]
    parts = [[r for r in rows if r[2] > 40_000 and r[0] < 9], [r for r in rows if r[2] > 40_000 and r[0] >= 9], [r for r in rows if r[2] <= 40_000]]
    frame = lambda p: spark.createDataFrame(p, SCHEMA)
    store = WindowStore(spark, str(tmp_path / "store"), ["g"], "c", 1000)
    said = [store.deliver(f"day {k}", frame(p)) for k, p in enumerate(parts)]
    assert [s["events"] for s in said] == [len(p) for p in parts] and said[0]["recounted"] == said[1]["recounted"] == 0 and said[2]["recounted"] == 13
    want = sorted(map(tuple, w.window_counts(frame(rows), ["g"], "c", 1000).select("g", "t0", "win", "c", "n").collect()))
    other = WindowStore(spark, str(tmp_path / "store"), ["g"], "c", 1000)  # as another session opens it
    taken = lambda: sorted(map(tuple, other.counts(frame([])).select("g", "t0", "win", "c", "n").collect()))
    assert taken() == want
    # a delivery that is there adds nothing, and one that never got into the manifest has no effect until it is given again
    assert other.deliver("day 1", frame(parts[1]))["events"] == 0 and taken() == want
    other._add(frame([(1, "z", 5)]).selectExpr("g", "5L t0"), "anchors", other._schemas(frame([]))["anchors"], "stopped")
    assert taken() == want
    more = [(1, "z", 5)]
    assert other.deliver("stopped", frame(more))["groups"] == 1
    assert taken() == sorted(map(tuple, w.window_counts(frame(rows + more), ["g"], "c", 1000).select("g", "t0", "win", "c", "n").collect()))
    assert WindowStore(spark, str(tmp_path / "none"), ["g"], "c", 1000).counts(frame([])).count() == 0
