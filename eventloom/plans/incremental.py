"""Window counts that grow by deliveries of events.

A store is a folder of three Parquet tables, appended to by each delivery: its events, the anchors that it brought to groups, and counts by
anchor. A group whose anchor stays gets the delivery's own counts, and nothing else of it is read. Only groups for which an event older than their
anchor arrives are counted anew, from all of their events. Counts of an anchor that has since moved stay where they are
and are passed over, so nothing is ever rewritten, and a delivery that was stopped half way leaves no trace in results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import windows as w
from eventloom.sinks.scratch import save


class WindowStore:
    """Counts of events in windows anchored at their group's first one, kept in ``folder``.

    A delivery is known by its name: one that has been taken in adds nothing, and one that was stopped is taken in whole when it is given again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], category: str, delta_us: int, time: str = "t_us"):
        self.spark, self.folder, self.keys, self.category, self.delta_us, self.time = spark, folder.rstrip("/"), keys, category, delta_us, time

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(str(path))

    def _schemas(self, events: DataFrame) -> dict[str, T.StructType]:
        own = lambda *names: [events.schema[n] for n in names]
        more = lambda *pairs: [T.StructField(n, t) for n, t in pairs]
        long, text = T.LongType(), T.StringType()
        return {
            "events": T.StructType([*own(*self.keys, self.category, self.time), *more(("delivery", text))]),
            "anchors": T.StructType([*own(*self.keys), *more(("t0", long), ("delivery", text))]),
            "counts": T.StructType([*own(*self.keys), *more(("t0", long), ("win", long)), *own(self.category), *more(("n", long), ("delivery", text))]),
            "done": T.StructType(more(("delivery", text), ("events", long), ("groups", long), ("recounted", long))),
        }

    def _add(self, rows: DataFrame, table: str, schema: T.StructType, delivery: str) -> None:
        rows = rows.withColumn("delivery", F.lit(delivery)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "delivery"], "delivery")
        # a partition a delivery: given again, it replaces what a stopped run left
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(f"{self.folder}/{table}")

    def deliver(self, name: str, events: DataFrame) -> dict[str, int]:
        """Takes in a delivery; how many events, groups, and groups counted anew. The store's tables are appended to, the manifest of deliveries last."""
        schemas = self._schemas(events)
        done = self._table("done", schemas["done"])
        known = done.where(F.col("delivery") == name).first()
        if known:
            return {"events": 0, "groups": 0, "recounted": 0}
        taken = [r["delivery"] for r in done.select("delivery").collect()]  # a name a delivery
        past = lambda table: self._table(table, schemas[table]).where(F.col("delivery").isin(taken) if taken else F.lit(False))
        new = save(events.select(*self.keys, self.category, self.time), "delivery")
        first = new.groupBy(*self.keys).agg(F.min(self.time).alias("new_t0"), F.count("*").alias("n"))
        old = past("anchors").groupBy(*self.keys).agg(F.min("t0").alias("old_t0"))
        groups = save(first.join(old, self.keys, "left"), "groups")
        stays = groups.where("old_t0 <= new_t0").select(*self.keys, F.col("old_t0").alias("t0"))
        fresh = groups.where("old_t0 is null or old_t0 > new_t0").select(*self.keys, F.col("new_t0").alias("t0"))
        moved = groups.where("old_t0 > new_t0").select(*self.keys)
        added = new.join(stays, self.keys).unionByName(new.join(fresh, self.keys))
        again = past("events").join(moved, self.keys, "left_semi").select(new.columns).join(fresh, self.keys)
        placed = added.unionByName(again).withColumn("win", F.expr(f"(`{self.time}` - t0) div {self.delta_us}"))
        counts = placed.groupBy(*self.keys, "t0", "win", self.category).agg(F.count("*").alias("n"))
        self._add(new, "events", schemas["events"], name)
        self._add(fresh, "anchors", schemas["anchors"], name)
        self._add(counts, "counts", schemas["counts"], name)
        said = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("groups"), F.count_if(F.col("old_t0") > F.col("new_t0")).alias("recounted")).first()
        self.spark.createDataFrame([(name, *said)], schemas["done"]).coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        return said.asDict()

    def counts(self, events: DataFrame) -> DataFrame:
        """keys, t0, win, category, n over all deliveries, as ``windows.window_counts`` gives them; ``events`` shows the columns' types."""
        schemas = self._schemas(events)
        taken = self._table("done", schemas["done"]).select("delivery")
        tables = {t: self._table(t, schemas[t]).join(F.broadcast(taken), "delivery", "left_semi") for t in ("anchors", "counts")}
        anchor = tables["anchors"].groupBy(*self.keys).agg(F.min("t0").alias("t0"))
        return tables["counts"].join(anchor, [*self.keys, "t0"]).groupBy(*self.keys, "t0", "win", self.category).agg(F.sum("n").alias("n"))


def pairs(store: WindowStore, events: DataFrame) -> DataFrame:
    """Consecutive windows of all deliveries, as ``windows.window_pairs`` gives them."""
    return w.window_pairs(w.share_vectors(store.counts(events), store.keys, store.category), store.keys)
