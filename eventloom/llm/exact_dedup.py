"""Exact duplicates by a persistent digest index, in DataFrame operations only.

Texts are equal when they are identical without white space (space and 0x09 to 0x0D). The index is a Parquet table of digests in a
shared folder, bucketed by digest and sorted within buckets. A delivery is first reduced to one entry a digest; a sort-merge
anti-join against the index, which needs no shuffle of the index, tells digests never seen from those seen before. The former are appended
as first entries, the latter as amendments that carry the delivery's count and its best row. An index can be opened again by a later
session, and a delivery whose name the index holds adds nothing, so that a job that was stopped can be run again.

Of equal texts the row with the most code points in its original text stays; ties go to the smallest id, then to the earlier
delivery by name, then to the row read first, so that exactly one row of a group stays.

Defined results: a null text is the empty text, and texts of white space only equal it. Null ids come after all others where rows tie; a
group whose best row has no id has a null keep_id. Repeated rows count one by one. A very long text is hashed where it is read and never shuffled unless it is
among the passing columns. Columns pass through; an output column that clashes with an input column, in any case of
letters, replaces it. An empty table gives no rows and adds nothing to the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Columns, Scratch

#: Fixed value: what normalisation deletes.
SPACE = " \t\n\x0b\x0c\r"
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digest(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of the normalised text in UTF-8."""
    return F.unhex(F.sha2(normalised(text), 256))


class Delivery:
    """Rows of a table with their digests, saved: what passes, and id, digest, chars, delivery and row."""

    def __init__(self, docs: DataFrame, name: str | Callable[[Column], Column], id: str = "doc_id", text: str = "text", columns: list[str] | None = None):
        """``name`` names the delivery, or makes each row's name from its id."""
        self.scratch = Scratch(docs.sparkSession, "digests")
        self.given = given = Columns(docs, columns, MADE)
        words, name = given.text(text), F.lit(name) if isinstance(name, str) else name(given.col(id))
        rows = given.frame.select(
            *given.passing(),
            given.col(id).alias("id"),
            digest(words).alias("digest"),
            F.coalesce(F.length(words), F.lit(0)).alias("chars"),
            name.alias("delivery"),
            F.monotonically_increasing_id().alias("row"),
        )
        self.id_type = given.types[given.at(id)].simpleString()
        self.rows = self.scratch.save(rows, "rows")


class DigestIndex:
    """The digests of all deliveries so far: digest, first, size, best (less, no_id, id, delivery, row), delivery."""

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "bigint", buckets: int | None = None):
        """Opens the index at ``path``, or begins one there; without a path, one that goes when the driver ends.

        ``buckets`` of a new index should make its buckets a task's share at its full size; the number of shuffle partitions if None.
        """
        self.spark, self.scratch = spark, Scratch(spark, "digest-index")
        self.path = path or self.scratch.path("index")
        about = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/about")
        if about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about):
            kept = spark.read.parquet(f"{self.path}/about").first()
            self.buckets, id_type = kept["buckets"], kept["id_type"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(id_type).alias("id_type")).coalesce(1).write.parquet(f"{self.path}/about")
        self.name = f"eventloom_index_{uuid.uuid4().hex}"
        schema = f"digest binary, first boolean, size bigint, best struct<less: int, no_id: boolean, id: {id_type}, delivery: string, row: bigint>, delivery string"
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet OPTIONS (path '{self.path}/entries') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, delivery: str) -> None:
        """Appends what rows (id, digest, chars, delivery, row) of the delivery of this name bring: one entry a digest."""
        if self.entries().where(F.col("delivery") == delivery).limit(1).count():
            return
        best = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "delivery", "row")
        own = rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(best).alias("best"))
        own, part = self.scratch.save(own, "own"), uuid.uuid4().hex
        known = self.entries().where("first").select("digest")
        fresh = own.join(known.hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True))
        again = own.join(known.hint("merge"), "digest", "left_semi").withColumn("first", F.lit(False))
        found = fresh.unionByName(again).withColumn("delivery", F.lit(delivery)).select("digest", "first", "size", "best", "delivery")
        found = self.scratch.save(found, f"found-{part}")  # read in full before the index grows
        found.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.scratch.drop("own", f"found-{part}")

    def groups(self) -> DataFrame:
        """digest, group_size, best of all deliveries; a bucket's digests are summed where they lie."""
        return self.entries().groupBy("digest").agg(F.sum("size").alias("group_size"), F.min("best").alias("best"))

    def decide(self, delivery: Delivery) -> DataFrame:
        """The passing columns of a delivery's rows, and keep_id, group_size, kept and text_sha256 by all that the index holds.

        The groups are written without buckets first: in a join of two shuffled sides, a digest that very many rows have is split by
        adaptive execution, in a bucketed one it isn't.
        """
        groups = self.scratch.save(self.groups(), f"groups-{uuid.uuid4().hex}")
        stays = (F.col("best.delivery") == F.col("delivery")) & (F.col("best.row") == F.col("row"))
        out = delivery.rows.join(groups, "digest", "left")
        return delivery.given.named(
            out.select(
                *delivery.given.passing(),
                F.col("best.id").alias("keep_id"),
                F.col("group_size"),
                F.coalesce(stays, F.lit(False)).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


def exact_duplicates(docs: DataFrame, path: str | None = None, name: str = "all", id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of one delivery with keep_id, group_size, kept and text_sha256, by itself and what the index at ``path`` holds."""
    delivery = Delivery(docs, name, id, text, columns)
    index = DigestIndex(docs.sparkSession, path, delivery.id_type)
    index.add(delivery.rows, name)
    out = index.decide(delivery)
    index.close()
    return out
