"""Tables and named files in the folder that the cluster shares, until the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the driver's session has ended
        path, fs = _path(spark, folder)
        fs.delete(path, True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    _delete(spark, folder)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile has its shuffle files removed as soon as it is written; they would stay until the driver forgets them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session that has none, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/eventloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)
    return folder


def broadcast_if(rows: DataFrame, most: int) -> DataFrame:
    """The rows, saved, and marked for a broadcast if they are at most so many."""
    spark, folder = rows.sparkSession, scratch_folder(rows.sparkSession, "side")
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    return F.broadcast(rows) if rows.count() <= most else rows


def save(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    folder = scratch_folder(rows.sparkSession, name)
    with shuffles_dropped(rows.sparkSession):
        rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def write_ordered(rows: DataFrame, folder: str, *order: str) -> str:
    """The lines ``value`` in this order over files that follow each other by name, written by as many tasks."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(rows.sparkSession):
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value").write.text(folder)
    return folder


def write_named(rows: DataFrame, folder: str, *order: str, compression: str = "none") -> str:
    """A file ``folder/name`` for each value of ``name``, with the lines ``value`` in this order. Each file is written by one task."""
    return _write_files(rows.repartition("name").sortWithinPartitions("name", *order), folder, compression)


#: Rows of a series that one task sorts and writes, about.
SERIES_ROWS = 500_000


def write_series(rows: DataFrame, folder: str, *order: str) -> str:
    """The lines ``value`` of each ``name`` in this order, over files of that name with other endings, which follow each other by name.

    Ranges of (name, order) are dealt to as many tasks as there are, and to more where they would be large, so that a task's rows are bounded.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SERIES_ROWS))
    ending = F.lpad(F.spark_partition_id().cast("string"), 8, "0")
    ranged = rows.repartitionByRange(parts, "name", *order).withColumn("name", F.concat_ws(".", F.regexp_replace("name", r"\.[^.]*$", ""), ending))
    # sorted by the name that is written, so that the writer doesn't sort by it once more
    return _write_files(ranged.sortWithinPartitions("name", *order), folder, "none")


def _write_files(rows: DataFrame, folder: str, compression: str) -> str:
    spark = rows.sparkSession
    parts = f"{folder}/parts"
    with shuffles_dropped(spark):
        rows.select("name", "value").write.partitionBy("name").text(parts, compression=compression)
    path, fs = _path(spark, parts)
    for status in fs.listStatus(path):
        if status.isDirectory():
            for file in fs.listStatus(status.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), _path(spark, f"{folder}/{status.getPath().getName().removeprefix('name=')}")[0])
    fs.delete(path, True)
    return folder


def number_rows(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """The rows with ``name``, their place in this order, from 0. The driver gets one count a range partition."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # within a partition the lower bits count rows from 0
    placed = sorted_rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    folder = scratch_folder(spark, "numbers")
    placed.write.parquet(folder)  # so that later readers see the same partitions
    placed = spark.read.schema(placed.schema).parquet(folder)
    count = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    before, at = [0], 0
    for k in range(max(count, default=-1) + 1):
        before.append(at := at + count.get(k, 0))
    first = F.element_at(F.array(*map(F.lit, before)), F.col("__part") + 1)
    return placed.withColumn(name, (first + F.col("__row")).cast("long")).drop("__part", "__row")
