"""Running totals of groups of any size: sums, maxima and last values up to each row, composed over ranges of rows.

Rows are dealt into ranges of (group, order), as many as there are tasks, so that a group of any size spreads over them. A range has its own running total;
what goes before it in its group is the total of the ranges before, found from one row a range and group. Only the first group of a range goes on
from another one, so what is carried is one row a range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.sinks.scratch import save

PART = "__part"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range, saved, so that all who read them see the same ranges."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return save(rows.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, how: str) -> DataFrame:
    """``ranged`` rows with ``name``: the sum, max or last (not null) of the value over their group's rows up to each, in this order.

    ``value`` may be of any type for last. A sum of no rows is 0, a max or last of none is null.
    """
    rows = rows.withColumn("__v", value)
    upto = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    if how == "sum":
        own, total, before = F.sum("__v").over(upto), F.sum("__v"), F.sum("__t").over(earlier)
        both = F.coalesce(F.col("__own"), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0))
    elif how == "max":
        own, total, before = F.max("__v").over(upto), F.max("__v"), F.max("__t").over(earlier)
        both = F.greatest("__own", "__carry")
    else:
        at = F.when(F.col("__v").isNotNull(), F.struct(*order))
        own, total, before = F.last("__v", ignorenulls=True).over(upto), F.max_by("__v", at), F.last("__t", ignorenulls=True).over(earlier)
        both = F.coalesce("__own", "__carry")
    totals = rows.groupBy(PART, *keys).agg(total.alias("__t"))
    carry = totals.withColumn("__carry", before).where("__carry is not null")
    carry = F.broadcast(carry.select(F.col(PART).alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry"))  # a row a range at most
    on = F.col(PART) == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumn("__own", own).join(carry, on, "left").withColumn(name, both)
    return out.drop("__v", "__own", "__carry", "__p", *[f"__k{i}" for i in range(len(keys))])
