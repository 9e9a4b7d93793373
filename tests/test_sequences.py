"""Closed forms against row-by-row loops."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import attribution as at
from eventloom.operators import placement, stats
from eventloom.operators import windows as w


def simulate_windows(events, delta, known):
    """(changes, inversions): {(group, earlier window, window)}, by going through the windows one after the other."""
    changes, inversions = set(), set()
    groups = {}
    for g, c, t in events:
        groups.setdefault(g, []).append((t, c))
    for g, rows in groups.items():
        start = min(t for t, _ in rows)
        counts = {}
        for t, c in rows:
            if c in known:
                counts.setdefault((t - start) // delta, {}).setdefault(c, 0)
                counts[(t - start) // delta][c] += 1
        last = None
        for i in range(max(counts, default=-1) + 1):
            if i not in counts:
                continue
            total = sum(counts[i].values())
            now = {c: n / total for c, n in counts[i].items()}
            if last is not None:
                j, before = last
                if any(abs(now.get(c, 0.0) - before.get(c, 0.0)) > 0.1 for c in set(now) | set(before)):
                    changes.add((g, j, i))
                a, b = (sorted(s, key=lambda c: (-s[c], c)) for s in (before, now))
                n = min(len(a), len(b))
                if a[:n] != b[:n]:
                    inversions.add((g, j, i))
            last = i, now
    return changes, inversions


def test_pairs_of_windows(spark):
    rnd = random.Random(1)
    events = []
    for g in range(60):
        for _ in range(rnd.randint(1, 40)):
            events.append((g, rnd.randint(0, 4), 1000 * g + rnd.randint(0, 300)))
    known = {0, 1, 2, 3}
    frame = spark.createDataFrame(events, "g long, c long, t_us long")
    classes = spark.createDataFrame([(c,) for c in known], "c long")
    counts = w.window_counts(frame, ["g"], "c", 10, known=classes)
    pairs = w.window_pairs(w.share_vectors(counts, ["g"], "c"), ["g"])
    got = [{(r.g, r.prev_win, r.win) for r in f(pairs).collect()} for f in (w.share_changes, w.rank_inversions)]
    want = simulate_windows(events, 10, known)
    assert got[0] == want[0] and got[1] == want[1] and want[0] and want[1]


def simulate_placement(times, t0, n, delta, whole):
    out, queue = {}, sorted(times)
    for i in range(n if whole else n - 1):
        if queue and t0 // 1000 + (i * delta) // 1000 > queue[0] // 1000:
            out[queue.pop(0)] = i
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_placement(spark, whole):
    rnd = random.Random(2)
    groups, states = [], []
    for g in range(150):
        t0 = rnd.randint(0, 50_000)
        groups.append((g, t0, rnd.randint(1, 30)))
        for tag in "CD":
            for time in rnd.sample(range(-20, 120), rnd.randint(0, 8)):
                states.append((g, tag, time * 1000))
    delta = 2000
    placed = placement.place(spark.createDataFrame(states, "g long, tag string, time_us long"), spark.createDataFrame(groups, "g long, t0 long, n_windows long"), ["g"], delta, whole=whole)
    got = {(r.g, r.tag, r.time_us): r.step for r in placed.collect()}
    want = {}
    for g, t0, n in groups:
        for tag in "CD":
            for time, step in simulate_placement([t for h, x, t in states if h == g and x == tag], t0, n, delta, whole).items():
                want[g, tag, time] = step
    assert got == want and want


def random_timelines(seed, unique):
    rnd = random.Random(seed)
    rows = []
    for g in range(200):
        ids, started, step = [str(k) for k in range(8)], [], 0
        for _ in range(rnd.randint(0, 14)):
            kind = rnd.choice("CDWWW")
            if kind == "C":
                i = ids.pop(0) if unique and ids else rnd.choice("0123")
                started.append(i)
                rows.append((g, step, 0, "C", i, rnd.choice(["c1", "c2"]), None))
            elif kind == "D":
                if unique and not started:
                    continue
                i = rnd.choice(started) if unique else rnd.choice("0123")
                rows.append((g, step, 1, "D", i, None, None))
            else:
                rows.append((g, step, 2, "W", None, None, [rnd.choice("abcd") for _ in range(2)]))
            step += 1
    return rows


SCHEMA = "g long, step long, kind_ord int, tag string, id string, kind string, names array<string>"


@pytest.mark.parametrize("kind", [None, "c2"])
def test_state_in_force(spark, kind):
    rows = random_timelines(3, False)
    got = {(r.g, r.step, r.kind_ord): r.state for r in at.attribute_state(spark.createDataFrame(rows, SCHEMA), ["g"], kind).collect()}
    state = {}
    for g, step, order, tag, i, k, _ in rows:
        now = state.get(g, "interpreter")
        if tag == "C" and (kind is None or k == kind):
            now = i
        elif tag == "D" and now == i:
            now = "interpreter"
        state[g] = now
        assert got[g, step, order] == now


def test_before_end(spark):
    rows = random_timelines(4, False)
    got = {(r.g, r.id): r.n for r in at.observations_before_end(spark.createDataFrame(rows, SCHEMA), ["g"]).collect()}
    want, seen, state = {}, {}, {}
    for g, _, _, tag, i, k, _ in rows:
        now = state.get(g, "interpreter")
        if tag == "C":
            now = i if k == "c2" else now
        elif tag == "D":
            if (g, i) in seen:
                want[g, i] = seen[g, i]
            now = "interpreter" if now == i else now
        else:
            seen[g, now] = seen.get((g, now), 0) + 1
        state[g] = now
    assert got == {k: v for k, v in want.items() if k[1] != "interpreter"} and got


def test_reduction(spark):
    """Against the loop, on timelines whose ids are unique and end after they begin."""
    rows = [r for r in random_timelines(5, True)]
    got = {(r.g, r.id): (r.n_before, r.n_after) for r in at.category_reduction(spark.createDataFrame(rows, SCHEMA), ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        out, last, before, now = {}, "interpreter", set(), set()
        for _, _, _, tag, i, _, names in (r for r in rows if r[0] == g):
            if tag == "C":
                out[last] = (before, now)
                before, now, last = now, set(), i
            elif tag == "D":
                if i in out:
                    continue
                out.setdefault(last, (before, now))
                if last == i:
                    last, before, now = "interpreter", set(), set()
            else:
                now |= set(names)
        out.setdefault(last, (before, now))
        want |= {(g, i): (len(a), len(b)) for i, (a, b) in out.items()}
    assert got == want


def test_bigrams_follow_states(spark):
    rows = [(1, 0, 0, "C", "7", "c1", None), (1, 1, 2, "W", None, None, ["a"]), (1, 2, 0, "C", "8", "c1", None), (1, 3, 2, "W", None, None, ["b"]), (1, 4, 0, "C", "7", "c1", None), (1, 5, 2, "W", None, None, ["c"]), (1, 6, 2, "W", None, None, ["c"])]
    states = at.attribute_state(spark.createDataFrame(rows, SCHEMA), ["g"])
    seen = at.attribution_order(states.withColumn("sig", F.array_join("names", "")), ["g"])
    assert [r.sig for r in seen.orderBy("place").collect()] == ["a", "c", "c", "b"]
    pairs = at.frequencies(at.transitions(seen, ["g"], ["sig"]), ["g"], ["sig", "next_sig"])
    assert {(r.sig, r.next_sig, r.n) for r in pairs.collect()} == {("a", "c", 1), ("c", "c", 1), ("c", "b", 1)}
    best = at.most_frequent(at.frequencies(seen, ["g"], ["sig"]), ["g"]).first()
    assert (best.sig, best.n) == ("c", 2)


def test_leading_two(spark):
    kind = "array<struct<name:string,ratio:double>>"
    rows = [([("A", 0.5), ("B", 0.3), ("C", 0.2)], [("C", 0.6), ("A", 0.4), ("B", 0.0)]), ([("A", 0.5), ("B", 0.5)], [("A", 0.6), ("B", 0.4)])]
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select(at.leading_two(F.col("a"), F.col("b")), at.leading_two(F.col("a"), F.col("b"), by_name=False), at.signature(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(["A", "C"], ["A", "C"], "C - A - B"), (["A", "B"], ["A"], "A - B")]


def test_box_without_keys(spark):
    r = stats.box(spark.createDataFrame([(float(x),) for x in (-5, 1, 2, 3, 4, 100)], "v double"), [], "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_signed_rank_with_ties(spark):
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 5.0, 3.0), (1, 4.0, 4.0), (1, 9.0, 7.0), (1, 8.0, 3.0)], "k int, a double, b double")
    r = stats.signed_rank(pairs, ["k"]).first()
    assert (r.n, r.w) == (4, 1.0) and 0 < r.p_value < 1


def test_running_totals_of_a_hot_group(spark):
    from eventloom.operators import scans

    rnd = random.Random(12)
    rows = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), k, rnd.choice([None, rnd.randint(-9, 9)])) for k in range(3000)]
    rnd.shuffle(rows)
    dealt = scans.ranged(spark.createDataFrame(rows, "g string, t int, v int"), ["g"], ["t"])
    sizes = [r["count"] for r in dealt.groupBy(scans.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * len(rows)
    for how in ("sum", "max", "last"):
        got = {(r.g, r.t): r.x for r in scans.running(dealt, ["g"], ["t"], "x", F.col("v"), how).collect()}
        now = {}
        for g, t, v in sorted(rows, key=lambda r: r[1]):
            if v is not None:
                now[g] = {"sum": lambda a, b: (a or 0) + b, "max": lambda a, b: b if a is None else max(a, b), "last": lambda a, b: b}[how](now.get(g), v)
            assert got[g, t] == now.get(g, 0 if how == "sum" else None), (how, g, t)


@pytest.mark.parametrize("kind", [None, "c2"])
def test_spread_groups_have_the_same_states_and_steps(spark, kind):
    rnd = random.Random(13)
    rows = [(0 if rnd.random() < 0.9 else 1, step, k, tag, rnd.choice("pqr") if tag != "W" and rnd.random() < 0.95 else None, rnd.choice(["c1", "c2", None])) for step in range(900) for k, tag in enumerate("CDW") if rnd.random() < 0.6]
    frame = spark.createDataFrame(rows, "g long, step long, kind_ord int, tag string, id string, kind string")
    want = sorted(map(str, at.attribute_state(frame, ["g"], kind).select("g", "step", "kind_ord", "epoch", "state").collect()))
    assert sorted(map(str, at.attribute_state(frame, ["g"], kind, spread=True).select("g", "step", "kind_ord", "epoch", "state").collect())) == want
    marks = spark.createDataFrame([(0 if rnd.random() < 0.9 else 1, rnd.choice("CD"), rnd.randint(0, 400_000), k) for k in range(800)], "g long, tag string, time_us long, n int")
    spans = spark.createDataFrame([(0, 1000, 500), (1, 0, 300)], "g long, t0 long, n_windows long")
    place = lambda spread: sorted(map(str, placement.place(marks, spans, ["g"], 1000, order=("n",), spread=spread).select("g", "tag", "n", "step").collect()))
    assert place(True) == place(False)


def test_shares_are_printed_as_sql_prints_them(spark):
    """Shares of which six decimals leave exactly, or nearly, a half."""
    import duckdb

    values = sorted({k / n for n in (128, 640, 1280, 3) for k in range(n + 1)})
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(w.shares_text(F.array(F.struct(F.lit("a").alias("name"), F.col("v").alias("ratio")))).alias("t")).collect()]
    assert got == [duckdb.sql(f"SELECT 'a: ' || printf('%.6f', {v!r}::DOUBLE)").fetchall()[0][0] for v in values]
