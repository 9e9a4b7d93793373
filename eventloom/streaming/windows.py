"""Rank inversions and share changes of unbounded event streams.

A group's state is its anchor, the counts of its open window and the shares of the last closed one. In ``window_pairs_stream`` a
window closes when an event of a later one arrives. Events must come in order of time within a group,
as a capture writes them; one that is older than the open window is counted as late and left out. ``window_pairs_in_event_time`` takes
events out of order and closes windows by the clock of the events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.windows import CHANGE

OUTPUT = "prev_win long, win long, prev_shares string, shares string, changed boolean, inverted boolean, late long"
STATE = "anchor long, win long, counts string, prev_win long, prev string, late long"


def ranked(shares: dict[str, float]) -> list[str]:
    return [name for name, r in sorted(shares.items(), key=lambda e: (-e[1], e[0])) if r]


def compare(before: dict[str, float], after: dict[str, float], threshold: float = CHANGE) -> tuple[bool, bool]:
    """(a share moved, the rankings contradict each other)."""
    moved = any(abs(before.get(k, 0.0) - after.get(k, 0.0)) > threshold for k in before.keys() | after.keys())
    a, b = ranked(before), ranked(after)
    n = min(len(a), len(b))
    return moved, a[:n] != b[:n]


def window_pairs_stream(events: DataFrame, keys: list[str], category: str, delta_us: int, time: str = "t_us") -> DataFrame:
    """keys and, for every closed window after a group's first, what it is against the one before: a streaming DataFrame."""
    names = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join(f"`{k}` {names[k]}" for k in keys) + ", " + OUTPUT

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            anchor, win, counts, prev_win, prev, late = state.get
            counts, prev = json.loads(counts), json.loads(prev) if prev else None
        else:
            anchor, win, counts, prev_win, prev, late = None, 0, {}, None, None, 0
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, name in zip(rows[time].tolist(), rows[category].astype(str).tolist()):
            anchor = t if anchor is None else anchor
            at = (t - anchor) // delta_us
            if at < win:
                late += 1
                continue
            if at > win and counts:
                total = sum(counts.values())
                shares = {k: n / total for k, n in counts.items()}
                if prev is not None:
                    out.append((*key, prev_win, win, json.dumps(prev, sort_keys=True), json.dumps(shares, sort_keys=True), *compare(prev, shares), late))
                prev_win, prev, counts = win, shares, {}
            win = at
            counts[name] = counts.get(name, 0) + 1
        state.update((anchor, win, json.dumps(counts), prev_win, json.dumps(prev) if prev is not None else None, late))
        yield pd.DataFrame(out, columns=[*keys, "prev_win", "win", "prev_shares", "shares", "changed", "inverted", "late"])

    return events.select(*keys, category, time).groupBy(*keys).applyInPandasWithState(advance, schema, STATE, "append", "NoTimeout")


PENDING = "groups string"


def window_pairs_in_event_time(events: DataFrame, keys: list[str], category: str, delta_us: int, time: str = "t_us", stamp: str = "ts", delay: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """As ``window_pairs_stream``, for events in any order that are at most ``delay`` behind: the pairs equal those of a batch of all events.

    Events wait until the watermark on ``stamp``, the time as a timestamp, has passed a group's first one, so that no older one can move the anchor; from then on
    they are counts of their windows. A timer closes each window when the watermark passes its end, so a
    group's last window comes out too, as soon as any group's events are far enough ahead. State is a group's events of one delay, and counts of its open windows.

    With ``buckets``, so many rows of state hold the groups dealt to them, and Python is called once for each of these instead of once for each group: for streams of very
    many small groups. Some tens of groups a bucket are enough, and their states are one row.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    columns = ["group", "prev_win", "win", "prev_shares", "shares", "changed", "inverted", "late"]

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # group: [anchor, waiting events, counts by open window, last closed window, its shares]
        groups = json.loads(state.get[0]) if state.exists else {}

        def count(group: list, t: int, name: str) -> None:
            mine = group[2].setdefault(str((t - group[0]) // delta_us), {})
            mine[name] = mine.get(name, 0) + 1

        if not state.hasTimedOut:
            for rows in batches:
                for at, t, name in zip(rows["group"].tolist(), rows[time].tolist(), rows[category].astype(str).tolist()):
                    group = groups.setdefault(at, [None, [], {}, None, None])
                    group[1].append((t, name)) if group[0] is None else count(group, t, name)
        now = state.getCurrentWatermarkMs() * 1000
        out, due = [], []
        for at, group in groups.items():
            if group[0] is None and now >= (first := min(t for t, _ in group[1])):
                group[0] = first
                for t, name in group[1]:
                    count(group, t, name)
                group[1] = []
            open_ = group[2]
            for win in sorted(map(int, open_)):
                if group[0] + (win + 1) * delta_us > now:
                    break
                counts = open_.pop(str(win))
                total = sum(counts.values())
                shares = {k: n / total for k, n in counts.items()}
                if group[4] is not None:
                    out.append((at, group[3], win, json.dumps(group[4], sort_keys=True), json.dumps(shares, sort_keys=True), *compare(group[4], shares), 0))
                group[3:] = win, shares
            due += [group[0] + (int(w) + 1) * delta_us for w in open_] or [t for t, _ in group[1]]
        state.update((json.dumps(groups),))
        if due:
            state.setTimeoutTimestamp(max(min(due), now) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=columns)

    # a group is told apart by its keys as JSON, which has nulls too
    rows = events.withWatermark(stamp, delay).select(F.to_json(F.struct(*keys)).alias("group"), category, time, stamp)
    held = F.col("group") if buckets is None else F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("string")
    pairs = rows.withColumn("held", held).groupBy("held").applyInPandasWithState(advance, "group string, " + OUTPUT, PENDING, "append", GroupStateTimeout.EventTimeTimeout)
    group = F.from_json("group", ", ".join(f"`{k}` {names[k]}" for k in keys))
    return pairs.select(*[group[k].alias(k) for k in keys], *columns[1:])


def window_counts_stream(events: DataFrame, anchors: DataFrame, keys: list[str], category: str, delta_us: int, time: str = "t_us", stamp: str = "ts", delay: str = "1 day") -> DataFrame:
    """keys, win, category, n for groups whose anchors are known: built-in aggregation, with a watermark on ``stamp``."""
    placed = events.withWatermark(stamp, delay).join(anchors.select(*keys, "t0"), keys)
    placed = placed.withColumn("win", F.expr(f"(`{time}` - t0) div {delta_us}"))
    return placed.groupBy(*keys, "win", category).agg(F.count("*").alias("n"))
