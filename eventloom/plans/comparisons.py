"""Paired runs compared: what a change costs, and whether steady states differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import stats


def overhead(runs: DataFrame, variants: tuple[str, str] = ("default", "instrumented")) -> DataFrame:
    """bench, n, means and deviations of both variants, w and p_value of the signed-rank test, d, geometric_ratio; from runs (bench, variant, run_no, value)."""
    pairs = stats.pair_runs(runs, ["bench"], "variant", variants)
    s = stats.summary(pairs, ["bench"]).withColumn("d", stats.cohen_d(F.col("a_mean"), F.col("b_mean"), F.col("a_std"), F.col("b_std")))
    geo = pairs.groupBy("bench").agg((stats.geometric_mean(F.col("b")) / stats.geometric_mean(F.col("a"))).alias("geometric_ratio"))
    return s.join(stats.signed_rank(pairs, ["bench"]).drop("n"), "bench", "left").join(geo, "bench")


def steady_state(runs: DataFrame, values: tuple[str, ...] = ("duration", "uptime"), variants: tuple[str, str] = ("normal", "tweaked")) -> DataFrame:
    """bench and, for each value, means, deviations, t, p_value and percent_difference; the largest difference of the first value first."""
    out = None
    for value in values:
        pairs = stats.pair_runs(runs.withColumn("value", F.col(value).cast("double")), ["bench"], "variant", variants)
        part = stats.summary(pairs, ["bench"]).drop("n").join(stats.paired_t(pairs, ["bench"]).drop("n"), "bench")
        part = part.withColumn("percent_difference", stats.percent_difference(F.col("a_mean"), F.col("b_mean")))
        part = part.select("bench", *[F.col(c).alias(f"{value}_{c}") for c in part.columns if c != "bench"])
        out = part if out is None else out.join(part, "bench")
    return out.orderBy(F.desc(f"{values[0]}_percent_difference"), "bench")
