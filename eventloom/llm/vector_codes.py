"""Compression of vectors to codes: product quantisation whose Lloyd rounds keep partition-local heaps.

A vector's components become whole numbers, floor(4096 * x), and the vector is cut into equal consecutive parts. Each part's place has a codebook,
which begins with the parts of the vectors of smallest id. A round assigns every part to its nearest entry, ties to the lower index, and moves each
entry to the floor of its parts' mean. Results are exact: equal to comparing every part with every entry in every round.

Most parts need no comparison. Vectors lie in blocks of bounded size, in a table bucketed by block. Beside it, in a table of the same
buckets, each block keeps a heap of parts for every entry, keyed by slack: the distance to the second nearest entry less that to the nearest, plus what the
entry's cumulative drift was when it was pushed. The drift of an entry grows by its own move and the largest move of the others in each round. As long as a part's key exceeds
that, its entry is still strictly nearest; so only parts at the top of the heap whose keys the drift has reached are popped, compared with all entries in whole numbers, and
pushed again. A block whose heaps have no such part is passed on. What popped parts add to and take from sums is all that a round sends: one row a
block, summed by component before the driver gets the new codebooks.

Defined results: vectors that are null or hold null or non-finite components get no code, nor do empty ones, those whose length isn't a multiple of ``parts``, and those
of another length than the first of the rest, by id; rows that get no code aren't returned. Null ids come last in the order of ids, and repeated ids go by their vectors. With fewer vectors than entries there are
fewer entries. Repeated rows count one by one. Null labels are one label. Components beyond 62 bits, and sums beyond long, raise an error rather than wrap.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import Columns, Scratch, tidied

#: Vectors a block holds at most, and bytes.
BLOCK, BLOCK_BYTES = 2048, 1 << 22
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CODED = (T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType()))


# -------------------------------------------------------------------- exact steps
def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component."""
    scaled = np.floor(np.float64(scale) * vectors)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component is too large for whole numbers of 64 bits")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact: in floating point where all terms fit its 53 bits, else in whole numbers that fit."""
    most = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    bound = 4 * x.shape[1] * most * most
    if bound < 1 << 52:
        f, g = x.astype(np.float64), book.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    kind = np.int64 if bound < 1 << 62 else object  # Python's own whole numbers have no limit
    return np.stack([((x.astype(kind) - c.astype(kind)) ** 2).sum(1) for c in book], axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and the slack: how much further the second nearest is."""
    d = distances(x, book)
    first = d.argmin(axis=1)
    if len(book) == 1:
        return first, np.full(len(x), np.inf)
    two = np.sort(d, axis=1)[:, :2].astype(np.float64)
    return first, np.sqrt(two[:, 1]) - np.sqrt(two[:, 0])


@dataclass
class Codebooks:
    """Entries by part, their sums and counts, and by how much each has drifted since the first round, against the others."""

    entries: list[list[list[int]]]
    drift: np.ndarray = field(init=False)

    def __post_init__(self):
        parts, k, width = len(self.entries), len(self.entries[0]), len(self.entries[0][0])
        self.drift = np.zeros((parts, k))
        self.sums = [[[0] * width for _ in range(k)] for _ in range(parts)]
        self.counts = [[0] * k for _ in range(parts)]

    def arrays(self) -> list[np.ndarray]:
        return [np.array(part, np.int64) for part in self.entries]

    def move(self, sums: list[list[list[int]]], counts: list[list[int]]) -> bool:
        """Takes in what a round has added to sums and counts; False if no entry moves."""
        any_moved = False
        for p, part in enumerate(self.entries):
            moves = []
            for c, entry in enumerate(part):
                self.counts[p][c] += counts[p][c]
                self.sums[p][c] = [a + b for a, b in zip(self.sums[p][c], sums[p][c], strict=True)]
                n = self.counts[p][c]
                new = [s // n for s in self.sums[p][c]] if n else entry
                moves.append(math.sqrt(sum((a - b) ** 2 for a, b in zip(new, entry, strict=True))))
                part[c] = new
            any_moved |= any(moves)
            for c, own in enumerate(moves):
                self.drift[p, c] += own + max(moves[:c] + moves[c + 1 :], default=0.0)
        return any_moved

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


class Heaps:
    """A block's heaps, one an entry of each part: lists of (key, row) in heap order, kept as arrays end to end."""

    def __init__(self, parts: int, k: int, data: tuple[bytes, bytes, bytes] | None, n: int):
        self.parts, self.k, self.n = parts, k, n
        if data is None:
            self.sizes, self.keys, self.rows = np.zeros((parts, k), np.int32), np.zeros(0), np.zeros(0, np.int32)
        else:
            self.sizes, self.keys, self.rows = (np.frombuffer(b, t) for b, t in zip(data, ("<i4", "<f8", "<i4"), strict=True))
            self.sizes = self.sizes.reshape(parts, k)
        ends = np.cumsum(self.sizes.ravel()).reshape(parts, k)
        self.starts, self.ends, self.fresh = ends - self.sizes, ends, data is None
        self.lists: dict[tuple[int, int], list[tuple[float, int]]] = {}

    def open(self, p: int, c: int) -> list[tuple[float, int]]:
        if (p, c) not in self.lists:
            a, b = self.starts[p, c], self.ends[p, c]
            self.lists[p, c] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
        return self.lists[p, c]

    def violated(self, p: int, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Takes out the rows of a part whose keys the drift has reached, and the entries that they were assigned to."""
        rows, entries = [], []
        for c in range(self.k):
            # a little more than the drift, for what rounding may have added to it or taken from a key
            limit = drift[c] + 1e-9 * (1 + drift[c])
            a = self.starts[p, c]
            if not self.sizes[p, c] or self.keys[a] * (1 - 1e-9) > limit:
                continue
            heap = self.open(p, c)
            while heap and heap[0][0] * (1 - 1e-9) <= limit:
                rows.append(heapq.heappop(heap)[1])
                entries.append(c)
        return rows, entries

    def push(self, p: int, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for row, c, key in zip(rows.tolist(), entries.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.open(p, c), (key, row))

    def assigned(self) -> np.ndarray:
        """The entry of every part: rows by parts."""
        out = np.zeros((self.n, self.parts), np.uint8)
        for p in range(self.parts):
            for c in range(self.k):
                rows = [r for _, r in self.lists[p, c]] if (p, c) in self.lists else self.rows[self.starts[p, c] : self.ends[p, c]]
                out[np.asarray(rows, np.int64), p] = c
        return out

    def data(self) -> tuple[bytes, bytes, bytes]:
        sizes, keys, rows = np.zeros((self.parts, self.k), "<i4"), [], []
        for p in range(self.parts):
            for c in range(self.k):
                if (p, c) in self.lists:
                    mine = self.lists[p, c]
                    key, row = np.array([x for x, _ in mine], "<f8"), np.array([x for _, x in mine], "<i4")
                else:
                    key, row = self.keys[self.starts[p, c] : self.ends[p, c]], self.rows[self.starts[p, c] : self.ends[p, c]]
                sizes[p, c] = len(key)
                keys.append(key)
                rows.append(row)
        return sizes.tobytes(), np.concatenate(keys).astype("<f8").tobytes(), np.concatenate(rows).astype("<i4").tobytes()


def reassign(x: np.ndarray, heaps: Heaps, books: list[np.ndarray], drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Brings a block's heaps up to date; what that adds to the entries' sums (parts, entries, width) and counts, and the number of parts compared."""
    parts, k, width = heaps.parts, heaps.k, x.shape[1] // heaps.parts
    sums, counts, seen = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), 0
    for p in range(parts):
        if heaps.fresh:
            rows, old = np.arange(len(x)), None
        else:
            popped, entries = heaps.violated(p, drift[p])
            rows, old = np.array(popped, np.int64), np.array(entries, np.int64)
        if not len(rows):
            continue
        seen += len(rows)
        mine = x[rows, p * width : (p + 1) * width]
        new, slack = nearest(mine, books[p])
        heaps.push(p, rows, new, slack + drift[p][new])
        changed = np.ones(len(rows), bool) if old is None else new != old
        np.add.at(sums[p], new[changed], mine[changed])
        np.add.at(counts[p], new[changed], 1)
        if old is not None:
            np.subtract.at(sums[p], old[changed], mine[changed])
            np.subtract.at(counts[p], old[changed], 1)
    return sums, counts, seen


# ------------------------------------------------------------------------ tables
def usable(v: Column, parts: int) -> Column:
    good = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)
    return good & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _packed(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """block, n, ids, labels, x: rows (id, label, v) in blocks, their components as whole numbers of 4 or 8 bytes."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dimension)))
    kinds = [rows.schema["id"].dataType, rows.schema["label"].dataType]
    schema = T.StructType().add("block", "long").add("n", "integer").add("ids", T.ArrayType(kinds[0])).add("labels", T.ArrayType(kinds[1])).add("x", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(now: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal at
            table = pa.Table.from_batches(now).combine_chunks()
            n = table.num_rows
            x = whole(np.asarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, dimension), scale)
            x = x.astype("<i4") if not n or np.abs(x).max() < 1 << 31 else x.astype("<i8")
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "label")]
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at - 1]), pa.array([n], pa.int32()), *lists, pa.array([x.tobytes()], pa.binary())], names=schema.names)

        for batch in batches:
            while batch.num_rows:
                took = min(batch.num_rows, size - sum(b.num_rows for b in held))
                held.append(batch.slice(0, took))
                batch = batch.slice(took)
                if sum(b.num_rows for b in held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return rows.select("id", "label", "v").mapInArrow(tidied(pack), schema)


@dataclass
class Coded:
    """id, label, code (entries by part) and error (squared distance) of every coded vector; the codebooks; the parts compared in each round."""

    rows: DataFrame
    codebooks: Codebooks | None
    compared: list[int]


def compress(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    spark = vectors.sparkSession
    scratch, given = Scratch(spark, "codes"), Columns(vectors)
    v = given.col(column).cast("array<double>")
    rows = given.frame.select(given.col(id).alias("id"), given.col(label).alias("label"), v.alias("v")).where(usable(v, parts))
    order = (F.col("id").asc_nulls_last(), "v")
    first = rows.orderBy(*order).select(F.size("v").alias("d")).first()
    kinds = [rows.schema["id"], rows.schema["label"]]
    if first is None:
        return Coded(spark.createDataFrame([], T.StructType([*kinds, *CODED])), None, [])
    dimension = first["d"]
    width = dimension // parts
    rows = rows.where(F.size("v") == dimension)
    start = [r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    start = whole(np.array(start, np.float64), scale).tolist()
    books = Codebooks([[x[p * width : (p + 1) * width] for x in start] for p in range(parts)])
    k, buckets = len(start), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.save_bucketed(_packed(rows, dimension, scale).withColumn("wide", F.octet_length("x") > 4 * dimension * F.col("n")).repartition(buckets, "block"), "blocks", "block", buckets)

    def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, tuple[bytes, bytes, bytes] | None]:
        n = batch.column("n")[i].as_py()
        x = np.frombuffer(batch.column("x")[i].as_buffer(), "<i8" if batch.column("wide")[i].as_py() else "<i4").reshape(n, dimension).astype(np.int64)
        data = tuple(batch.column(c)[i].as_py() for c in ("sizes", "keys", "heap"))
        return x, None if data[0] is None else data

    def state(now: int) -> DataFrame:
        """The blocks beside their heaps after ``now`` rounds."""
        if not now:
            return blocks.selectExpr("*", *(f"cast(null as binary) {c}" for c in ("sizes", "keys", "heap")))
        return blocks.join(heaps.hint("merge"), "block")

    heaps, compared = None, []
    for now in range(rounds):
        arrays, drift = books.arrays(), books.drift.copy()

        def step(batches: Iterator[pa.RecordBatch], arrays=arrays, drift=drift) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, data = opened(batch, i)
                    mine = Heaps(parts, k, data, len(x))
                    sums, counts, seen = reassign(x, mine, arrays, drift)
                    moved = np.concatenate([sums.ravel(), counts.ravel()]) if seen else None
                    yield pa.RecordBatch.from_pylist(
                        [{"block": batch.column("block")[i].as_py(), **dict(zip(("sizes", "keys", "heap"), mine.data(), strict=True)), "moved": None if moved is None else moved.tolist(), "compared": seen}],
                        schema=pa.schema([("block", pa.int64()), ("sizes", pa.binary()), ("keys", pa.binary()), ("heap", pa.binary()), ("moved", pa.list_(pa.int64())), ("compared", pa.int64())]),
                    )

        made = state(now).select("block", "n", "x", "wide", "sizes", "keys", "heap").mapInArrow(tidied(step), "block long, sizes binary, keys binary, heap binary, moved array<long>, compared long")
        heaps = scratch.save_bucketed(made, f"heaps-{now}", "block", buckets)
        if now:
            scratch.drop(f"heaps-{now - 1}")
        compared.append(heaps.agg(F.sum("compared")).first()[0])
        change = heaps.select(F.posexplode("moved").alias("at", "x")).where("x <> 0").groupBy("at").agg(F.sum("x").alias("x"))
        flat = [0] * (parts * k * (width + 1))
        for r in change.collect():  # a number a component of the codebooks at most
            flat[r["at"]] = r["x"]
        sums = [[flat[(p * k + c) * width : (p * k + c + 1) * width] for c in range(k)] for p in range(parts)]
        counts = [flat[parts * k * width + p * k : parts * k * width + (p + 1) * k] for p in range(parts)]
        if not books.move(sums, counts):
            break  # all further rounds would be as this one
    arrays, drift = books.arrays(), books.drift.copy()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, data = opened(batch, i)
                mine = Heaps(parts, k, data, len(x))
                reassign(x, mine, arrays, drift)
                code = mine.assigned()
                error = np.zeros(len(x), object)
                for p in range(parts):
                    part, entry = x[:, p * width : (p + 1) * width], arrays[p][code[:, p]]
                    most = max(int(np.abs(part).max()), int(np.abs(entry).max()))
                    kind = np.int64 if 4 * width * most * most < 1 << 60 else object
                    error = error + ((part.astype(kind) - entry.astype(kind)) ** 2).sum(1).astype(object)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(code.ravel().astype(np.int32)))
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    coded = state(rounds).mapInArrow(tidied(finish), T.StructType([*kinds, *CODED]))
    coded = scratch.save(coded, "coded")
    scratch.drop("blocks", f"heaps-{now}")
    return Coded(coded, books, compared)


def codes(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """id, code (two hex digits a part), error, label_error (summed over equal labels) and codebooks_sha256 of every coded vector."""
    out = compress(vectors, id, column, label, **how)
    by_label = out.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    rows = out.rows.join(by_label, F.col("label").eqNullSafe(F.col("same")))
    text = F.array_join(F.transform("code", lambda c: F.format_string("%02x", c)), "")
    return rows.select(F.col("id").alias(id), text.alias("code"), "error", "label_error", F.lit(out.codebooks.sha256() if out.codebooks else None).cast("string").alias("codebooks_sha256"))
