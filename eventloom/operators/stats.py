"""Statistics of series and of paired runs. Sums are of per-row terms, so every group is combined before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.distributions import signed_rank_p_value, student_p_value
from eventloom.operators.quantiles import quantiles
from eventloom.sinks.scratch import broadcast_if

#: Groups whose quartiles are broadcast at most, some fifty bytes each; more are joined.
GROUPS = 100_000


def pair_runs(runs: DataFrame, keys: list[str], variant: str, names: tuple[str, str], run: str = "run_no", value: str = "value") -> DataFrame:
    """keys, run, a, b: runs of equal number of the two variants, for keys where both have as many."""
    a, b = names
    side = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    paired = runs.where(F.col(variant).isin(a, b)).groupBy(*keys, run).agg(side(a).alias("a"), side(b).alias("b"))
    whole = paired.groupBy(*keys).agg(F.count("a").alias("na"), F.count("b").alias("nb")).where("na = nb and na > 0").select(*keys)
    return paired.where(F.col("a").isNotNull() & F.col("b").isNotNull()).join(whole, keys, "left_semi")


def without(runs: DataFrame, names: list[str], bench: str = "bench", variant: str | None = None, side: str | None = None) -> DataFrame:
    """The runs but those of these benchmarks, or of one variant of them; a benchmark that so has one side only has no pairs."""
    out = F.col(bench).isin(names) if names else F.lit(False)
    if variant is not None:
        out = out & (F.col(variant) == side)
    return runs.where(~F.coalesce(out, F.lit(False)))


def summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means and population deviations of both sides."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in ("a", "b") for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def cohen_d(mean_a: Column, mean_b: Column, std_a: Column, std_b: Column) -> Column:
    spread = F.sqrt((std_a * std_a + std_b * std_b) / 2)
    return F.when(spread != 0, (mean_a - mean_b) / spread)


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.log(value)))


def percent_difference(base: Column, other: Column) -> Column:
    return F.when(base != 0, 100 - other / base * 100)


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, t of the differences a - b, and its two-sided p-value."""
    d = F.col("a") - F.col("b")
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    out = out.withColumn("t", F.when(F.col("s") != 0, F.col("m") / (F.col("s") / F.sqrt("n"))))
    return out.select(*keys, "n", "t", student_p_value(F.col("t"), F.col("n").cast("double")).alias("p_value"))


def signed_rank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n of the non-zero differences, the lesser sum of ranks w, and its two-sided p-value; equal differences share their mean rank."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where("d <> 0").withColumn("size", F.abs("d"))
    # equal sizes are counted first, so ranks come from one row a size
    sizes = d.groupBy(*keys, "size").agg(F.count("*").alias("ties"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    before = F.coalesce(F.sum("ties").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("rank", before + (F.col("ties") + 1) / 2)
    sums = sizes.groupBy(*keys).agg(
        F.sum("ties").alias("n"),
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * (F.col("ties") - F.col("up"))).alias("minus"),
        F.sum(F.expr("ties * ties * ties - ties")).cast("double").alias("tied"),
    )
    w = F.least("plus", "minus")
    return sums.select(*keys, "n", w.alias("w"), signed_rank_p_value(w, F.col("n").cast("double"), F.col("tied")).alias("p_value"))


def significant(rows: DataFrame, p: str = "p_value", level: float = 0.05) -> DataFrame:
    return rows.where(F.col(p) < level)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _whiskers() -> tuple[Column, Column]:
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return F.col("q1") - spread, F.col("q3") + spread


def _boxed(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The positive values beside their group's quartiles; NaN is no value."""
    rows = values.where((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")))
    quartiles = broadcast_if(quantiles(rows, keys, value, QUARTILES).drop("n"), GROUPS)
    return rows.join(quartiles, keys)


def box(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles of the positive values, the extremes within 1.5 interquartile ranges, and how many lie beyond; exact, and no group needs a task of its own."""
    if not keys:  # one group of all rows
        return box(values.withColumn("__all", F.lit(0)), ["__all"], value).drop("__all")
    inside = F.col(value).between(*_whiskers())
    return _boxed(values, keys, value).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))


def outliers(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows whose positive values lie beyond 1.5 interquartile ranges, with their group's median: the points of a box chart."""
    if not keys:
        return outliers(values.withColumn("__all", F.lit(0)), ["__all"], value).drop("__all")
    return _boxed(values, keys, value).where(~F.col(value).between(*_whiskers())).drop("q1", "q3")


def top(rows: DataFrame, value: str, n: int = 30, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n rows with the largest value."""
    return rows.orderBy(F.desc(value), *ties).limit(n)


def tail(rows: DataFrame, keys: list[str], order: str, n: int = 100) -> DataFrame:
    """Each group's last n rows."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= n).drop("__rn")
