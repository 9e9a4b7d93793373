"""Cost listings, timing outputs and run series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.descriptors import hot_descriptor, strip_hidden
from eventloom.functions.text import elapsed_seconds, series_name
from eventloom.sinks.scratch import broadcast_if
from eventloom.sources.lines import SPLITS, numbered_lines

# Fixed values of the formats: heading lines of a cost listing, and columns of the cost table.
HEADING_LINES = 7
COST_SCHEMA = "`exclusive cpu sec` double, `cpu cycles` double, method_descriptor string"


def read_cost_listing(spark: SparkSession, path: str, limit: int | None = None, bare_argument: bool = False) -> DataFrame:
    """file, ord and the cost table's columns, from a profiler's listing; with ``limit``, of its first entries."""
    rows = numbered_lines(spark, path).where((F.col("ord") >= HEADING_LINES) & (F.col("ord") < F.col("lines") - 1))
    if limit:
        rows = rows.where(F.col("ord") < HEADING_LINES + limit)
    parts = F.split(F.trim("line"), r"\s+", 3)
    return rows.select("file", "ord", parts[0].try_cast("double").alias("exclusive cpu sec"), parts[1].try_cast("double").alias("cpu cycles"), hot_descriptor(strip_hidden(parts[2]), bare_argument).alias("method_descriptor"))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COST_SCHEMA).csv(path, header=True)


def read_elapsed(spark: SparkSession, path: str, short: bool = False) -> DataFrame:
    """bench, variant, run_no, value: seconds of each run, from files ``default_*`` and ``instrumented_*``."""
    pattern = r"\d:\d\d.\d\delapsed" if short else r"(?:\d+:)?\d+:\d+(?:\.\d+)?elapsed"
    rows = numbered_lines(spark, path, F.size(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))) == 1)
    variant = F.when(F.contains("file", F.lit("instrumented")), "instrumented").otherwise("default")
    rows = rows.select(series_name(F.col("file"), ("default_", "instrumented_")).alias("bench"), variant.alias("variant"), "file", "ord", elapsed_seconds(F.col("line"), short).alias("value"))
    # a series is one file, or several of the same name but for its ending, whose runs follow by file name
    before = Window.partitionBy("bench", "variant").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("bench", "variant", "file").agg(F.count("*").alias("n")).select("bench", "variant", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(broadcast_if(files, SPLITS), ["bench", "variant", "file"])  # one row a file
    return rows.select("bench", "variant", (F.col("before") + F.col("ord") + 1).cast("int").alias("run_no"), "value")


def read_run_series(spark: SparkSession, path: str, last: int = 100) -> DataFrame:
    """bench, variant, run_no, duration, uptime: the last lines of files ``normal_*`` and ``th_*``.

    A series is one file, or several of the same name but for its ending, whose lines follow by file name; its last lines are meant.
    """
    rows = numbered_lines(spark, path).where(F.col("ord") >= F.col("lines") - last)  # what a file has before them is not among its series' either
    parts = F.split("line", ",")
    rows = rows.select(series_name(F.col("file"), ("normal_", "th_")).alias("bench"), F.when(F.col("file").startswith("th_"), "tweaked").otherwise("normal").alias("variant"), "file", "ord", parts[1].try_cast("long").alias("duration"), parts[2].try_cast("long").alias("uptime"))
    of = lambda *order: Window.partitionBy("bench", "variant").orderBy(*order)
    rows = rows.withColumn("from_end", F.row_number().over(of(F.desc("file"), F.desc("ord")))).where(F.col("from_end") <= last)
    return rows.select("bench", "variant", F.row_number().over(of("file", "ord")).alias("run_no"), "duration", "uptime")
