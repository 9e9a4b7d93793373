"""What holds when: observations attributed to the state in force.

A timeline has rows with tag C (a state begins, with id and kind), D (the state ``id`` ends) and W (an observation), in the order
(step, kind_ord) within its keys. The state at a row is the last id begun, unless that id has ended
since; then, and before any, it is ``interpreter``. An ending of another id changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import scans

REST = "interpreter"


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("step", "kind_ord")


def attribute_state(rows: DataFrame, keys: list[str], kind: str | None = None, spread: bool = False) -> DataFrame:
    """The rows with ``state`` and ``epoch``. With ``kind``, only beginnings of that kind are beginnings.

    ``spread`` deals each group's rows over all tasks, for groups that are too many rows for one.
    """
    begins = (F.col("tag") == "C") if kind is None else (F.col("tag") == "C") & F.coalesce(F.col("kind") == kind, F.lit(False))
    if spread:
        order = ["step", "kind_ord"]
        rows = scans.running(scans.ranged(rows, keys, order), keys, order, "epoch", F.when(begins, 1).otherwise(0), "sum")
        rows = scans.running(rows, keys, order, "own", F.when(begins, F.struct("id")), "last")
        mine = F.col("own.id")
        rows = scans.running(rows, keys, order, "ended", F.when((F.col("tag") == "D") & (F.col("id") == mine), F.col("epoch")), "max")
        state = F.when(mine.isNull() | F.coalesce(F.col("ended") == F.col("epoch"), F.lit(False)), F.lit(REST)).otherwise(mine)
        return rows.withColumn("state", state).drop("own", "ended", scans.PART)
    upto = _order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("epoch", F.sum(F.when(begins, 1).otherwise(0)).over(upto))
    inside = Window.partitionBy(*keys, "epoch").orderBy("step", "kind_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.first(F.when(begins, F.col("id")), ignorenulls=True).over(inside)
    rows = rows.withColumn("epoch_id", own)
    ended = F.max(F.when((F.col("tag") == "D") & (F.col("id") == F.col("epoch_id")), 1).otherwise(0)).over(inside)
    return rows.withColumn("state", F.when(F.col("epoch_id").isNull() | (ended == 1), F.lit(REST)).otherwise(F.col("epoch_id"))).drop("epoch_id")


def line_counts(rows: DataFrame, keys: list[str], lines: int = 3) -> DataFrame:
    """lines (an observation takes several), pairs, compilations and decompilations of each group."""
    w, c, d = (F.sum(F.when(F.col("tag") == t, 1).otherwise(0)) for t in "WCD")
    return rows.groupBy(*keys).agg((w * lines + c + d).alias("lines"), w.alias("pairs"), c.alias("compilations"), d.alias("decompilations"))


def counts_in_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """Observations of each group outside the resting state."""
    return states.groupBy(*keys).agg(F.sum(F.when((F.col("tag") == "W") & (F.col("state") != REST), 1).otherwise(0)).alias("after_compilation"))


def observations_before_end(rows: DataFrame, keys: list[str], kind: str = "c2") -> DataFrame:
    """keys, id, n: for each state of this kind that ended, the observations that it had until its last ending.

    A state that had none by then isn't listed.
    """
    states = attribute_state(rows, keys, kind)
    seen = states.where("tag = 'W'").select(*keys, F.col("state").alias("id"), F.struct("step", "kind_ord").alias("at"))
    ends = states.where("tag = 'D'").groupBy(*keys, "id").agg(F.max(F.struct("step", "kind_ord")).alias("end"))
    return ends.join(seen, [*keys, "id"]).where("at < end").groupBy(*keys, "id").agg(F.count("*").alias("n"))


def time_in_wrong_state(before: DataFrame, ended: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """keys, suboptimal_us: windows of observations before the end of states that ended, as time."""
    return before.join(ended.select(*keys, "id").distinct(), [*keys, "id"]).groupBy(*keys).agg((F.sum("n") * window_us).alias("suboptimal_us"))


def mean_before_end(before: DataFrame, keys: list[str]) -> DataFrame:
    return before.groupBy(*keys).agg(F.avg("n").alias("mean_before_end"))


def category_reduction(rows: DataFrame, keys: list[str], names: str = "names") -> DataFrame:
    """keys, id, n_before, n_after: different categories seen before a state and in it.

    A segment ends where a state begins and where the state in force ends. A state's entry pairs the
    segment before it with its own; what rested after an ending has nothing before it. Of a state with
    several segments the last that another beginning closed counts, or else the first.
    """
    states = attribute_state(rows, keys)
    order = _order(keys)
    previous = F.lag("state", 1, REST).over(order)
    own_end = (F.col("tag") == "D") & (F.col("state") == REST) & (previous == F.col("id"))
    cut = (F.col("tag") == "C") | own_end
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = states.withColumn("own_end", own_end).withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(upto))
    parts = cuts.groupBy(*keys, "segment").agg(
        F.min_by(F.when(F.col("tag") == "C", F.col("id")).otherwise(F.col("state")), F.struct("step", "kind_ord")).alias("id"),
        F.max(F.col("own_end").cast("int")).alias("after_end"),
    )
    # a row a category and segment, never a list of them
    seen = cuts.where("tag = 'W'").select(*keys, "segment", F.explode(names).alias("name")).distinct().groupBy(*keys, "segment").agg(F.count("*").alias("seen"))
    # the first segment exists even where a state begins at once
    starts = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("segment"))
    parts = starts.join(parts, [*keys, "segment"], "full").join(seen, [*keys, "segment"], "left")
    parts = parts.select(*keys, "segment", F.coalesce("id", F.lit(REST)).alias("id"), F.coalesce("after_end", F.lit(0)).alias("after_end"), F.coalesce("seen", F.lit(0)).alias("seen"))
    by = Window.partitionBy(*keys).orderBy("segment")
    parts = parts.withColumn("before", F.when(F.col("after_end") == 1, 0).otherwise(F.coalesce(F.lag("seen").over(by), F.lit(0))))
    parts = parts.withColumn("closed_by_begin", F.coalesce((F.lead("after_end").over(by) == 0), F.lit(False)))
    pick = F.struct(F.col("closed_by_begin").cast("int").alias("c"), F.when(F.col("closed_by_begin"), F.col("segment")).otherwise(-F.col("segment")).alias("s"))
    best = parts.groupBy(*keys, "id").agg(F.max_by(F.struct(F.col("before").alias("n_before"), F.col("seen").alias("n_after")), pick).alias("e"))
    return best.select(*keys, "id", F.col("e.n_before").cast("long").alias("n_before"), F.col("e.n_after").cast("long").alias("n_after"))


# ------------------------------------------------------------- inversions
def leading_two(before: Column, after: Column, by_name: bool = True) -> Column:
    """At most two names that lead either window: each one's first, then each one's second, without repeats.

    Shares are ranked from the largest, ties in the order given. With ``by_name`` off, entries are
    repeats only if name and share both agree, so that one name can take both places.
    """

    def ranked(shares: Column) -> Column:
        placed = F.transform(shares, lambda s, k: F.struct((-s["ratio"]).alias("r"), k.alias("k"), s["name"].alias("name"), s["ratio"].alias("ratio")))
        return F.transform(F.array_sort(placed), lambda s: F.struct(s["name"].alias("name"), s["ratio"].alias("ratio")))

    a, b = ranked(before), ranked(after)
    order = F.filter(F.array(F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(1))), lambda s: s.isNotNull())
    if by_name:
        return F.slice(F.array_distinct(F.transform(order, lambda s: s["name"])), 1, 2)
    return F.array_distinct(F.transform(F.slice(F.array_distinct(order), 1, 2), lambda s: s["name"]))


def keep_names(shares: Column, names: Column) -> Column:
    return F.filter(shares, lambda s: F.array_contains(names, s["name"]))


def signature(shares: Column, separator: str = " - ") -> Column:
    """Names from the largest share, ties in the order given, joined."""
    placed = F.transform(shares, lambda s, k: F.struct((-s["ratio"]).alias("r"), k.alias("k"), s["name"].cast("string").alias("name")))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["name"]), separator)


def attribution_order(states: DataFrame, keys: list[str]) -> DataFrame:
    """Observations outside the resting state with ``place``: states in order of first appearance, each one's observations together."""
    rows = states.where((F.col("tag") == "W") & (F.col("state") != REST))
    first = F.min(F.struct("step", "kind_ord")).over(Window.partitionBy(*keys, "state"))
    rows = rows.withColumn("first_at", first)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", "step", "kind_ord"))).drop("first_at")


def frequencies(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """How often each combination of values occurs, and the place of its first occurrence."""
    return rows.groupBy(*keys, *values).agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def transitions(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Consecutive observations: values, and next_ values."""
    by = Window.partitionBy(*keys).orderBy("place")
    out = rows.select(*keys, "place", *values, *[F.lead(v).over(by).alias(f"next_{v}") for v in values], F.lead("place").over(by).alias("next_place"))
    return out.where(F.col("next_place").isNotNull()).drop("next_place")


def most_frequent(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's most frequent combination; of equals, the one that came first."""
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_place")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
