"""Event sequences out of the star-schema tables, which the catalogue's queries run over.

A user is a site, the parity of an event's ``k`` a compile id, an event type a category. Sign-ups begin
states and errors end them. Windows are a day wide. Timestamps count as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["callsite_id", "compile_id"]
DELTA = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("user_id").alias("callsite_id"), k.alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callsite_id, compile_id, class, t_us, k."""
    return _events(spark, sf_dir).select("callsite_id", (F.col("k") % 2).alias("compile_id"), F.col("event_type").alias("class"), "t_us", "k")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """callsite_id, tag, id, kind, time_us, event_id: what begins (C) and ends (D)."""
    rows = _events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    return rows.select(
        "callsite_id",
        F.when(F.col("event_type") == "signup", "C").otherwise("D").alias("tag"),
        (F.col("k") % 5).cast("string").alias("id"),
        F.when(F.col("k") % 3 == 0, "c1").otherwise("c2").alias("kind"),
        (F.floor(F.col("t_us") / 1000) * 1000).alias("time_us"),
        "event_id",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bench, variant, run_no, value: order lines of a supplier as numbered runs of two variants."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    number = F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    rows = rows.select(F.col("l_suppkey").alias("bench"), F.when(F.col("l_returnflag") == "A", "default").otherwise("instrumented").alias("variant"), number.alias("run_no"), F.col("l_quantity").alias("value"))
    # runs beyond the other variant's last one have no partner
    least = rows.groupBy("bench", "variant").count().groupBy("bench").agg(F.min("count").alias("m"), F.count("*").alias("v")).where("v = 2")
    return rows.join(least, "bench").where("run_no <= m").drop("m", "v")
