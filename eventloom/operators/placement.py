"""External state changes on the timeline of windows.

A group's windows are steps 0, 1, 2 and so on; each step takes at most one state change of each kind,
and an event waits for the first free step that begins after it. So the j-th event of a kind goes to
step j + max over k <= j of (f_k - k), where f_k is the first step that begins after event k: a running
maximum, and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import scans

#: Order within a step.
KIND_ORDER = {"C": 0, "D": 1, "W": 2}


def first_step(t0: Column, time_us: Column, delta_us: int) -> Column:
    """The first step that begins after a time; both clocks count whole milliseconds."""
    ahead = F.floor(time_us / F.lit(1000)) - F.floor(t0 / F.lit(1000)) + 1
    return F.when(ahead <= 0, F.lit(0)).otherwise(F.ceil(ahead * 1000 / F.lit(delta_us))).cast("long")


def spans(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t0 and the number of windows of each group, gaps included."""
    return counts.groupBy(*keys).agg(F.min("t0").alias("t0"), (F.max("win") + 1).alias("n_windows"))


def place(states: DataFrame, windows: DataFrame, keys: list[str], delta_us: int, on: list[str] | None = None, tag: str = "tag", time: str = "time_us", order: tuple[str, ...] = (), whole: bool = False, spread: bool = False) -> DataFrame:
    """The state changes with their step; those after the last step are left out.

    ``spread`` deals each group's changes over all tasks, for groups that are too many rows for one.

    ``states`` are matched to groups by ``on`` (all of ``keys`` by default), and order ties of time by
    ``order``. Steps lie between windows, or with ``whole`` are the windows themselves, one more.
    """
    rows = states.join(windows, on or keys)
    if spread:
        by, at = [*keys, tag], [time, *order]
        rows = scans.running(scans.ranged(rows.withColumn("f", first_step(F.col("t0"), F.col(time), delta_us)), by, at), by, at, "j", F.lit(1), "sum")
        rows = scans.running(rows, by, at, "step", F.col("f") - F.col("j"), "max").withColumn("step", F.col("j") + F.col("step"))
        return rows.where(F.col("step") <= F.col("n_windows") - (1 if whole else 2)).drop("j", "f", scans.PART)
    by = Window.partitionBy(*keys, tag).orderBy(time, *order)
    rows = rows.withColumn("j", F.row_number().over(by) - 1).withColumn("f", first_step(F.col("t0"), F.col(time), delta_us))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("step", F.col("j") + F.max(F.col("f") - F.col("j")).over(upto))
    return rows.where(F.col("step") <= F.col("n_windows") - (1 if whole else 2)).drop("j", "f")


def timeline(windows: DataFrame, placed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Windows or pairs of them (``step`` and what ``columns`` names) and placed state changes, one row each.

    Order within a group is (step, kind_ord): compilations, then deoptimisations, then the window.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])
    states = placed.select(*keys, "step", "tag", kinds[F.col("tag")].alias("kind_ord"), *[c for c in ("id", "kind", "time_us") if c in placed.columns])
    rows = windows.select(*keys, "step", F.lit("W").alias("tag"), F.lit(KIND_ORDER["W"]).alias("kind_ord"), *columns)
    return rows.unionByName(states, allowMissingColumns=True)
