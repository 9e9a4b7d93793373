"""Tumbling windows anchored at each group's first event, and what changes between them.

Counting by (group, window, category) comes before anything that needs a group's rows together, so a
group that owns most events is pre-aggregated where its events are read. Windows are kept sparse: a
category that a window lacks counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A share must move by more than this, in doubles, to be a change.
CHANGE = 0.1


def anchors(events: DataFrame, keys: list[str], time: str = "t_us") -> DataFrame:
    """keys, t0 and t_end of every group."""
    return events.groupBy(*keys).agg(F.min(time).alias("t0"), F.max(time).alias("t_end"))


def numbered(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``place`` of each row in its group's order, from 1; sorts spill to disk, so a group need not fit in memory."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def window_counts(events: DataFrame, keys: list[str], category: str, delta_us: int, time: str = "t_us", known: DataFrame | None = None) -> DataFrame:
    """keys, t0, win, category, n. ``known`` holds the categories to count; others still set the anchor."""
    first = anchors(events, keys, time).drop("t_end")
    rows = events if known is None else events.join(known.select(category).distinct(), category, "left_semi")
    placed = rows.join(first, keys).withColumn("win", F.expr(f"(`{time}` - t0) div {delta_us}"))
    return placed.groupBy(*keys, "t0", "win", category).agg(F.count("*").alias("n"))


def window_shares(counts: DataFrame, keys: list[str], category: str) -> DataFrame:
    """The counts with the window's total and the category's share of it."""
    total = F.sum("n").over(Window.partitionBy(*keys, "win"))
    return counts.withColumn("total", total).withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("n") / F.col("total")))


def share_vectors(counts: DataFrame, keys: list[str], category: str) -> DataFrame:
    """One row per non-empty window: keys, t0, win, total and ``shares``, an array of (name, ratio) by name.

    The counts are dealt by group once; the vectors, and windows over a group's vectors, need no exchange after it.
    """
    grouped = counts.repartition(*keys).groupBy(*keys, "t0", "win").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(F.col(category).alias("name"), "n"))).alias("counts"))
    shares = F.transform("counts", lambda c: F.struct(c["name"].alias("name"), (c["n"] / F.col("total")).alias("ratio")))
    return grouped.select(*keys, "t0", "win", "total", shares.alias("shares"))


def dense_shares(counts: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Every window up to the group's last and every category of the group, absent ones with share 0."""
    shares = window_shares(counts, keys, category)
    spans = counts.groupBy(*keys).agg(F.max("win").alias("last"), F.collect_set(category).alias("names"))
    grid = spans.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("win"), "names").select(*keys, "win", F.explode("names").alias(category))
    return grid.join(shares.select(*keys, "win", category, "n", "ratio"), [*keys, "win", category], "left").fillna({"n": 0, "ratio": 0.0})


def ranking(shares: Column) -> Column:
    """Names of non-zero shares, the largest first; ties by name."""
    present = F.filter(shares, lambda s: s["ratio"] != 0)
    return F.transform(F.array_sort(F.transform(present, lambda s: F.struct((-s["ratio"]).alias("r"), s["name"].alias("name")))), lambda s: s["name"])


def prefix_compatible(a: Column, b: Column) -> Column:
    """Whether one ranking begins with the other."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(True)).otherwise(F.slice(a, 1, F.greatest(n, F.lit(1))) == F.slice(b, 1, F.greatest(n, F.lit(1))))


def window_pairs(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Each non-empty window with the last non-empty one before it: prev_win, prev_shares, step and label.

    ``step`` is the place before the later window, and ``label`` counts it from the time origin. Groups'
    first windows have no partner and are left out.
    """
    order = Window.partitionBy(*keys).orderBy("win")
    out = vectors.withColumns({"prev_win": F.lag("win").over(order), "prev_shares": F.lag("shares").over(order)})
    return out.where(F.col("prev_win").isNotNull()).withColumn("step", F.col("win") - 1)


def label(t0: Column, step: Column, delta_us: int) -> Column:
    """Number of a step's window from the time origin."""
    return F.floor(t0 / F.lit(delta_us)).cast("long") + step


def _share_of(shares: Column, name: Column) -> Column:
    found = F.filter(shares, lambda s: s["name"] == name)
    return F.coalesce(F.get(found, F.lit(0))["ratio"], F.lit(0.0))


def share_moved(before: Column, after: Column, threshold: float = CHANGE) -> Column:
    """Whether any category's share moved by more than the threshold."""
    names = F.array_union(F.transform(before, lambda s: s["name"]), F.transform(after, lambda s: s["name"]))
    return F.exists(names, lambda n: F.abs(_share_of(before, n) - _share_of(after, n)) > F.lit(float(threshold)))


def share_changes(pairs: DataFrame, threshold: float = CHANGE) -> DataFrame:
    """The pairs of windows between which a share moved by more than the threshold."""
    return pairs.where(share_moved(F.col("prev_shares"), F.col("shares"), threshold))


def rank_inversions(pairs: DataFrame) -> DataFrame:
    """The pairs of windows whose rankings contradict each other, with both rankings."""
    ranked = pairs.withColumns({"prev_rank": ranking(F.col("prev_shares")), "rank": ranking(F.col("shares"))})
    return ranked.where(~prefix_compatible(F.col("prev_rank"), F.col("rank")))


def six_digits(share: Column) -> Column:
    """A share with six decimals, of exact halves the even one as C prints them; ``format_string`` rounds them up, and a double's shortest digits instead of its value."""
    return F.format_number(share, 6)


def shares_text(shares: Column, names: Column | None = None) -> Column:
    """``a: 0.500000, b: 0.250000``; with ``names``, of these categories, absent ones as 0."""
    if names is None:
        return F.array_join(F.transform(shares, lambda s: F.format_string("%s: %s", s["name"].cast("string"), six_digits(s["ratio"]))), ", ")
    return F.array_join(F.transform(names, lambda n: F.format_string("%s: %s", n.cast("string"), six_digits(_share_of(shares, n)))), ", ")
