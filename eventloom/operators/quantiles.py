"""Exact quantiles of groups of any size, by histograms that are refined around the ranks asked for.

A rank of a group starts in the group's whole range. A pass counts the values of every open range in bins of equal width, with each bin's least and largest value, and the
range of the bin that holds the rank replaces it. Counting is combined before it is shuffled, so a pass moves some thousand
rows a range and task at most, however many values a group has. A range of few values, or one that no more passes shall narrow, is finished from the counts of its
different values; a range whose ends are equal is its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.sinks.scratch import broadcast_if, save

#: Bins of a range, values from which a range is narrowed rather than finished, and passes at most.
BINS, FEW, PASSES = 4096, 10_000, 8
#: Ranges that are broadcast at most, some hundred bytes each; more are joined.
RANGES = 100_000


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def ordered_values(values: DataFrame, keys: list[str], value: str, ranks: Column, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n, rank, v: the values at these ranks, an array of numbers from 0 made from ``n``, the group's count of values that are neither null nor NaN."""
    names = [f"k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double") + 0.0  # -0.0 is 0.0
    base = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.alias("v")).where("v is not null and not isnan(v)")
    whole = base.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    now = save(whole.select(*names, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), F.explode(F.array_distinct(ranks.cast("array<bigint>"))).alias("rank")), "ranks")

    def met(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        spans = broadcast_if(open_.select(*names, "lo", "hi").distinct(), RANGES)
        inside = base.join(spans, _same(base, spans, names) & base["v"].between(spans["lo"], spans["hi"]))
        return spans, inside.select(*[spans[n] for n in names], "v", "lo", "hi")

    def placed(open_: DataFrame, counts: DataFrame, order: str) -> DataFrame:
        """The open ranks beside the row of counts (keys, lo, hi, ..., c) that each falls in, with the number of values before it."""
        earlier = Window.partitionBy(*names, "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).alias("x")
        at = F.col("o.rank") - F.col("o.below") - F.col("x.before")
        on = (F.col("o.lo") == F.col("x.lo")) & (F.col("o.hi") == F.col("x.hi")) & (at >= 0) & (at < F.col("x.c"))
        for n in names:
            on = on & F.col(f"o.{n}").eqNullSafe(F.col(f"x.{n}"))
        return open_.alias("o").join(counts, on)

    keep = [F.col(f"o.{n}").alias(n) for n in (*names, "n", "rank")]
    for _ in range(PASSES):
        wide = (F.col("lo") < F.col("hi")) & (F.col("size") > few)
        open_ = now.where(wide)
        if not open_.limit(1).count():
            break
        _, inside = met(open_)
        # never falls as v rises, whatever is rounded; ends that aren't finite keep bins of their own
        share = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))
        place = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)))
        counts = inside.groupBy(*names, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("l"), F.max("v").alias("h"))
        nearer = placed(open_, counts, "bin").select(*keep, F.col("x.l").alias("lo"), F.col("x.h").alias("hi"), (F.col("o.below") + F.col("x.before")).alias("below"), F.col("x.c").alias("size"))
        now = save(nearer.unionByName(now.where(~wide).select(nearer.columns)), "ranks")
    open_ = now.where("lo < hi")
    _, inside = met(open_)
    last = placed(open_, inside.groupBy(*names, "lo", "hi", "v").agg(F.count("*").alias("c")), "v").select(*keep, F.col("x.v").alias("v"))
    out = last.unionByName(now.where("lo = hi").select(*names, "n", "rank", F.col("lo").alias("v")))
    return out.toDF(*keys, "n", "rank", "v")


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n and a column for each named share: the value at (n - 1) * share in ascending order, between neighbours in proportion."""
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ranks = F.array(*[x.cast("long") for a in at.values() for x in (F.floor(a), F.ceil(a))])
    found = ordered_values(values, keys, value, ranks, bins, few)
    held = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("__at"))  # two entries a share

    def between(a: Column) -> Column:
        low, high = (F.try_element_at("__at", f(a).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a)))

    return held.select(*keys, "n", *[between(a).alias(name) for name, a in at.items()])
