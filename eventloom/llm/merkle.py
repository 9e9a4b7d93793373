"""Merkle manifest of a dataset, with every row's authentication path by fractal traversal.

Rows are leaves. A group's leaves in the order of their ids are joined in runs of three, level by level, until one node is left, the
group's subroot; subroots in the order of their groups are joined likewise, up to the root. The last run of a level may be shorter, and a
single node becomes its hash too while the level has others.

A tree is cut into aligned blocks of ``3 ** HEIGHT`` leaves. Blocks are reduced to their roots in tasks of their own, and these are the leaves of
the next table of blocks, until a tree is a single block; a group of any size so spreads over all tasks. Paths then come from the top down. A block gets the path
above its root in one row, and emits the paths of its leaves in order: of its own tree it keeps only a stack of existing subtrees, which
hold the siblings of the leaf at hand, and of desired ones, which grow by one leaf a step and stand in when the leaf leaves
an existing one. The upper proof follows. Beside the subtrees a task holds a block's leaf hashes.

Positions come from one range partitioning by (group, id, hash): a task counts rows since the last change of group, and the driver
adds up what goes before each partition from one row a partition.

Defined results: a null field is ``-`` in a leaf, so it differs from an empty one; fields that are no text count as their text. The null
group is first; null ids come first in a group. Rows that repeat an id stand in the order of their hashes, and rows alike in the order they were read in; each is a leaf. A very long text is hashed
where it is read. A table of one row has its leaf as root and an empty proof; an empty table gives no rows. Columns pass through; an
output column that clashes with an input column, in any case of letters, replaces it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import Columns, Scratch, tidied

#: Levels of a block, and of a stacked subtree.
HEIGHT, LAYER = 6, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
MADE = ("leaf", "subroot", "root", "proof")


# ----------------------------------------------------------------------- hashes
def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields, each with its length in UTF-8 bytes."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in its order, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def join_run(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def block_root(nodes: list[str], height: int | None = None) -> str:
    """The root of a block after ``height`` levels, or of a whole tree."""
    while len(nodes) > 1 if height is None else height:
        nodes = [join_run(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        height = height and height - 1
    return nodes[0]


# -------------------------------------------------------------------- traversal
class Subtree:
    """The nodes of the heights ``low`` to ``high`` below one node, grown leaf by leaf from the left.

    Of lower heights only unfinished runs are kept, at most two nodes each.
    """

    def __init__(self, leaves: list[str], low: int, high: int, place: int):
        self.leaves, self.low, self.high, self.place = leaves, low, high, place
        self.next, self.end = place * 3**high, min((place + 1) * 3**high, len(leaves))
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.nodes: list[list[str]] = [[] for _ in range(high - low)]

    def grow(self) -> None:
        if self.next >= self.end:
            return
        at, node = self.next, self.leaves[self.next]
        self.next += 1
        for height in range(self.high):
            if height >= self.low:
                self.nodes[height - self.low].append(node)
            run = self.runs[height]
            run.append(node)
            last = -(-len(self.leaves) // 3**height) - 1
            if len(run) < 3 and at < last:
                return
            node, at = join_run(run), at // 3
            run.clear()

    def beside(self, leaf: int, height: int) -> tuple[str, str]:
        """The siblings, left and right, of a leaf's ancestor at this height."""
        row = self.nodes[height - self.low]
        at = leaf // 3**height - self.place * 3 ** (self.high - height)
        run = at - at % 3
        return "".join(row[run:at]), "".join(row[at + 1 : run + 3])


def paths(leaves: list[str], height: int, layer: int = LAYER) -> Iterator[list[tuple[str, str]]]:
    """The siblings of every leaf in order, level by level up to ``height``."""
    layers = [(low, min(low + layer, height)) for low in range(0, height, layer)]
    exist = [Subtree(leaves, low, high, 0) for low, high in layers]
    for tree in exist:
        while tree.next < tree.end:
            tree.grow()
    desire = [Subtree(leaves, low, high, 1) for low, high in layers]
    for leaf in range(len(leaves)):
        yield [exist[h // layer].beside(leaf, h) for h in range(height)]
        for k, (low, high) in enumerate(layers):
            desire[k].grow()
            if (leaf + 1) % 3**high == 0:
                exist[k] = desire[k]
                desire[k] = Subtree(leaves, low, high, exist[k].place + 1)


# ------------------------------------------------------------------------ tables
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), of batches in their order."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tree)], strict=True):
            if held and (tree[a], block[a]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tree[a], block[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def placed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows (group, id, leaf, tie, ...) with tree, the place of their group, and pos, theirs in it."""
    spark, order = rows.sparkSession, ["group", "id", "leaf", "tie"]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields]).add("nth", "long").add("at", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, at, last = -1, 0, object()
        for batch in batches:
            places = []
            for group in batch.column("group").to_pylist():
                nth, at, last = (nth, at + 1, last) if group == last else (nth + 1, 0, group)
                places.append((nth, at))
            pair = np.array(places, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=schema.names)

    counted = scratch.save(ordered.mapInArrow(tidied(count), schema), "counted")
    ends = F.struct("nth", "at", "group")
    stats = counted.groupBy("part").agg(F.min(ends)["group"].alias("first"), F.max(ends).alias("last"), F.count_if(F.col("nth") == 0).alias("n_first")).orderBy("part").collect()
    before, tree, seen, last = [], -1, 0, object()
    for s in stats:
        tree, seen = (tree, seen) if s["first"] == last else (tree + 1, 0)
        before.append((s["part"], tree, seen))
        seen = seen + s["n_first"] if s["last"]["nth"] == 0 else s["last"]["at"] + 1
        tree, last = tree + s["last"]["nth"], s["last"]["group"]
    offsets = spark.createDataFrame(before, "part int, first_tree long, seen long")  # a row a partition
    out = counted.join(F.broadcast(offsets), "part").withColumn("tree", F.col("first_tree") + F.col("nth"))
    return out.withColumn("pos", F.col("at") + F.when(F.col("nth") == 0, F.col("seen")).otherwise(0)).drop("part", "nth", "at", "first_tree", "seen", "group", "id", "tie")


class Forest:
    """Trees over nodes (tree, pos, node, ...), cut into blocks: ``levels``, each made of the roots of the blocks below, and ``roots`` (tree, level, node)."""

    def __init__(self, scratch: Scratch, name: str, nodes: DataFrame, height: int):
        self.scratch, self.name, self.height = scratch, name, height
        self.levels, self.roots = [nodes], None
        while True:
            level = len(self.levels) - 1
            blocks = scratch.save(self._reduced(self.levels[-1].select("tree", "pos", "node")), f"{name}-{level}")
            done = blocks.where("not many").select("tree", F.lit(level).alias("level"), "node")
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            more = blocks.where("many")
            if not more.limit(1).count():
                break
            self.levels.append(more.select("tree", F.col("block").alias("pos"), "node"))

    def _reduced(self, nodes: DataFrame) -> DataFrame:
        """tree, block, node, many: every block's root, and whether its tree has others."""
        height, size = self.height, 3**self.height

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _blocks(batches):
                tree, block = rows.column("tree")[0].as_py(), rows.column("block")[0].as_py()
                own = rows.filter(pa.array(rows.column("pos").to_numpy() // size == block)).column("node").to_pylist()
                many = block > 0 or len(own) < rows.num_rows  # the first block is sent the first leaf of the second
                yield pa.RecordBatch.from_pylist([{"tree": tree, "block": block, "node": block_root(own, height if many else None), "many": many}])

        dealt = nodes.withColumn("block", F.floor(F.col("pos") / size))
        dealt = dealt.unionByName(nodes.where(F.col("pos") == size).withColumn("block", F.lit(0).cast("long")))
        return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(tidied(reduce), "tree long, block long, node string, many boolean")

    def proofs(self, crowns: DataFrame) -> DataFrame:
        """The lowest nodes' rows, with path: their siblings up to the root of their tree and beyond, as ``crowns`` (tree, path, ...) goes on; and the crown's other columns."""
        above = None
        for level in reversed(range(len(self.levels))):
            heads = self.roots.where(F.col("level") == level).select("tree").join(crowns, "tree").withColumn("block", F.lit(0).cast("long")).withColumn("many", F.lit(False))
            if above is not None:
                heads = heads.unionByName(above.drop("node").withColumnRenamed("pos", "block").withColumn("many", F.lit(True)))
            above = self._traversed(self.levels[level], heads)
            if level:
                above = self.scratch.save(above, f"{self.name}-paths-{level}")
        return above

    def _traversed(self, nodes: DataFrame, heads: DataFrame) -> DataFrame:
        height, size = self.height, 3**self.height
        told = [f for f in heads.schema.fields if f.name not in ("tree", "block", "path", "many")]
        schema = T.StructType([*nodes.schema.fields]).add("path", heads.schema["path"].dataType)
        for f in told:
            schema = schema.add(f.name, f.dataType)

        def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _blocks(batches):
                head, rows = rows.slice(0, 1), rows.slice(1)
                leaves = rows.column("node").to_pylist()
                if head.column("many")[0].as_py():
                    own = height
                else:
                    own = next(h for h in range(height + 1) if 3**h >= len(leaves))
                upper = [(s["left"], s["right"]) for s in head.column("path")[0].as_py()]
                lefts, rights = [], []
                for path in paths(leaves, own):
                    for left, right in (*path, *upper):
                        lefts.append(left)
                        rights.append(right)
                steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])
                offsets = pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * (own + len(upper)))
                columns = [rows.column(f.name).combine_chunks() for f in nodes_fields]
                columns += [pa.ListArray.from_arrays(offsets, steps), *(pa.repeat(head.column(f.name)[0], len(leaves)) for f in told)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        nodes_fields = nodes.schema.fields
        dealt = nodes.withColumn("block", F.floor(F.col("pos") / size)).unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(tidied(traverse), schema)


def manifest(
    docs: DataFrame,
    id: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    columns: list[str] | None = None,
    also: dict[str, Callable[[Callable[[str], Column]], Column]] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """``columns`` of every row with its leaf, subroot, root and proof, an array of the siblings to its left and right at each level.

    ``also`` makes further columns from a row, as functions of a function that gives a column by its name. Groups are compared as text.
    """
    scratch, also = Scratch(docs.sparkSession, "manifest"), also or {}
    given = Columns(docs, columns, (*MADE, *also))
    extra = [f(given.col).alias(f"x{k}") for k, f in enumerate(also.values())]
    rows = given.frame.select(
        *given.passing(), *extra, given.col(id).alias("id"), given.col(group).cast("string").alias("group"), leaf_hash([given.col(f) for f in fields]).alias("leaf"), F.monotonically_increasing_id().alias("tie")
    )
    rows = scratch.save(placed(scratch, scratch.save(rows, "leaves")).withColumnRenamed("leaf", "node"), "placed")
    scratch.drop("leaves", "counted")
    trees = Forest(scratch, "trees", rows, height)
    top = Forest(scratch, "top", trees.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node"), height)
    crown = top.roots.select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    crowns = scratch.save(top.proofs(crown).select(F.col("pos").alias("tree"), F.col("node").alias("subroot"), "path", "root"), "crowns")
    out = trees.proofs(crowns)
    return given.named(out.select(*given.passing(), F.col("node").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), *[F.col(f"x{k}").alias(name) for k, name in enumerate(also)]))
