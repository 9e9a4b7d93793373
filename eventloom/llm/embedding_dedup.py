"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Principal axes and a learned rotation turn a vector into a balanced binary code; two rotations from
different starts give 128 bits. Substrings of them key the tables, under which
a vector also stands with each single bit of the substring flipped: codes meet if a substring differs in at
most two places. The width of the substrings grows with the number of vectors, and the number of tables with the width. Vectors that meet and differ in few of the 128 bits are near; a bucket yields
a spanning forest of its near vectors, never their pairs, and the forests' components are the clusters
in which vectors are compared. The original vectors then decide: within clusters, in blocks of
bounded size, cosines in double precision give each vector's number of links and a forest of the links.

The axes and rotations are fitted on a bounded, hash-chosen sample; every vector is indexed. Recall is
that of the tables: what is linked but never within two places in a substring, or differs in too many bits, is missed,
and no link below the threshold is ever made. The number of tables and the near limit come from pairs at the threshold, made from the sample, and from links in it:
codes are taken about the vectors' mean or about the origin, whichever needs fewer tables to miss at most ``MISS`` of them. Where
vectors share so large a part that neither does, all are compared in blocks, which is exact and takes the square of their number. Equal vectors are one class throughout.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors link
with those of their own length; each length that several have has axes, tables and clusters of its own. Null ids take part in counts as members of their class; a class that has only null ids links with nothing, and gets no component.
Repeated rows count as vectors of their own. Parts of any finite size are compared. A very long vector is held whole by the tasks that compare it, with as many others as a block has.
Ids that are no whole numbers are compared in their order. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import Columns, Scratch, by_number, components, mix, tidied

#: Vectors that the axes and rotations are fitted on, and steps of that.
SAMPLE, STEPS = 20_000, 30
#: Bits of a table's substring at least; they grow with the vectors so that a bucket of unrelated ones holds at most so many.
SUBSTRING, LOAD = 16, 4096
#: Share of pairs at the threshold that all tables may miss, and places of 128 by which near codes may differ beyond those expected.
MISS, MARGIN = 0.03, 18
#: Tables at most, and pairs that they are tried on.
MOST_TABLES, TRIED = 64, 20_000
#: Vectors that are compared without codes at most, those of a cluster compared with as many others at once, and codes.
BLOCK, LINKED, CODES = 256, 8192, 4096
#: Numbers of the vectors of a block, about; and vectors sent in a pass, if those of the clusters are fewer.
NUMBERS, SENT = 1 << 20, 100_000
#: Places of codes in tables that are shuffled at once; of more codes, one table after the other.
PLACED = 1_000_000
#: Columns of links and forest rows.
LINKS = "rep long, n long, b long"
#: Hot buckets whose keys are broadcast, 16 bytes each; more are joined.
HOT_ROWS = 1_000_000


@dataclass
class Quantiser:
    """Mean and two projections; the signs of the projected vector are its code."""

    mean: np.ndarray
    projections: np.ndarray  # (dimension, 128)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Two 64-bit integers a vector."""
        bits = (vectors - self.mean) @ self.projections > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest part first, whose square may be no finite number."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def substrings(width: int, count: int) -> list[np.ndarray]:
    """The bits of each table's substring: the first code's bits one after the other, then both codes' in other orders."""
    rng, bits = np.random.default_rng(3), np.arange(64)
    while len(bits) < count * width:
        bits = np.concatenate([bits[: len(bits) // width * width], rng.permutation(128)])
    return [bits[k * width : (k + 1) * width] for k in range(count)]


def tables_for(n: int, threshold: float, least: int = SUBSTRING) -> tuple[list[np.ndarray], int]:
    """The bits of each table's substring, and the places in which near codes differ at most, for codes about the origin.

    Unrelated codes fill a bucket with n * (width + 1) / 2**width vectors. A pair at the threshold differs in each bit with probability
    q; it meets in a table if it differs in at most two bits of the substring, and there are tables enough for ``MISS``.
    """
    width = least
    while n * (width + 1) >> width > LOAD and width < 40:
        width += 1
    q = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    meet = sum(math.comb(width, k) * q**k * (1 - q) ** (width - k) for k in range(3))
    count = min(MOST_TABLES, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))) if meet < 1 else 1
    return substrings(width, count), min(64, round(128 * q) + MARGIN)


def tried_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at or over the threshold, in two sets: ones made from the sample, and links found in it if they are many.

    A made pair is a vector and another one of the sample, or, where that is less than the threshold, the vector turned towards it as far as the threshold
    allows; so its difference has the directions that differences have in these data.
    """
    rng = np.random.default_rng(5)
    x = sample[rng.integers(0, len(sample), min(TRIED, 10 * len(sample)))]
    y = sample[rng.integers(0, len(sample), len(x))]
    cosine = (x * y).sum(axis=1)
    across = y - cosine[:, None] * x
    size = np.linalg.norm(across, axis=1)
    turned = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * across / np.maximum(size, 1e-12)[:, None]
    some = size > 1e-9  # neither the same vector nor its opposite
    out = [(x[some], np.where((cosine < threshold)[:, None], turned, y)[some])]
    few = sample[rng.permutation(len(sample))[:4000]]
    a, b = np.nonzero(np.triu(few @ few.T >= threshold, 1))
    if len(a) >= 50:
        pick = rng.permutation(len(a))[:TRIED]
        out.append((few[a[pick]], few[b[pick]]))
    return [p for p in out if len(p[0])]


def _bits(quantiser: Quantiser, vectors: np.ndarray) -> np.ndarray:
    return (vectors - quantiser.mean) @ quantiser.projections > 0


def plan_for(sample: np.ndarray, n: int, threshold: float, least: int = SUBSTRING) -> tuple[Quantiser, list[np.ndarray], int] | None:
    """The quantiser, tables and near limit by which at most ``MISS`` of the tried pairs are missed; None if no number of tables is enough.

    Codes about the mean tell vectors apart best, but where vectors share a large part, the angle about the mean says little about the one about
    the origin; codes about the origin keep it, with buckets that are as full as the vectors are alike.
    """
    tables, near = tables_for(n, threshold, least)
    width, pairs, best = len(tables[0]), tried_pairs(sample, threshold), None
    every = substrings(width, MOST_TABLES)
    for centred in (True, False):
        quantiser = fit(sample, centred=centred)
        count, limit = len(tables), near
        for x, y in pairs:
            differ = _bits(quantiser, x) != _bits(quantiser, y)
            apart = differ.sum(axis=1)
            limit = max(limit, int(np.quantile(apart, 1 - MISS / 3, method="higher")))
            left, used = np.ones(len(differ), bool), 0
            while left.mean() > MISS * 2 / 3 and used < MOST_TABLES:
                left &= differ[:, every[used]].sum(axis=1) > 2
                used += 1
            count = max(count, used if left.mean() <= MISS * 2 / 3 else MOST_TABLES + 1)
        if count <= MOST_TABLES and (best is None or count < best[0]):
            best = count, (quantiser, every[:count], limit)
    return best and best[1]


def fit(vectors: np.ndarray, steps: int = STEPS, centred: bool = True) -> Quantiser:
    """Iterative quantisation of unit vectors, about their mean or the origin: turn, take signs, turn to fit the signs, again and again."""
    mean = vectors.mean(axis=0) if centred else np.zeros(vectors.shape[1])
    about = vectors - mean
    dimension = vectors.shape[1]
    values, axes = np.linalg.eigh(about.T @ about)
    axes = axes[:, ::-1]
    width = min(64, dimension)
    parts = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        projected = about @ axes[:, :width]
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        part = axes[:, :width] @ turn
        if width < 64:  # too few axes for all bits: random directions fill the rest
            part = np.hstack([part, rng.standard_normal((dimension, 64 - width))])
        parts.append(part)
    return Quantiser(mean, np.hstack(parts))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def classes_of(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """For vectors (id, v): (id and class key of every row, null where unusable; one row per class: rep, size, vector), and the classes of each length that several have."""
    kind = vectors.schema["v"].dataType
    v = F.col("v").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("id", F.when(good, v).alias("v"))
    # 0.0 and -0.0 are one number
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("key", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.to_json(F.struct("v")), 256))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))  # as they were given: half the bytes on disk, and the same numbers
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()
    return rows.select("id", "key"), classes, {r["d"]: r["count"] for r in lengths}


def sample_of(classes: DataFrame, dimension: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors that a hash chooses."""
    n = classes.count()
    rate = min(1.0, sample / max(n, 1))
    chosen = classes.where(F.pmod(F.xxhash64(F.lower(F.hex("key"))), F.lit(1 << 30)) / float(1 << 30) < rate).orderBy("key").select("v").toArrow()
    return unit(_matrix(chosen.column("v").combine_chunks(), dimension))


def _sent(classes: DataFrame, quantiser: Quantiser, dimension: int) -> DataFrame:
    """rep, two code words and the vector, of the classes that have an id."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = quantiser.codes(unit(_matrix(batch.column(1), dimension))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes[:, 0]), pa.array(codes[:, 1])], names=["rep", "c0", "c1"])

    return classes.where("rep is not null").select("rep", "v").mapInArrow(tidied(code), "rep long, c0 long, c1 long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def near_forest(rep: np.ndarray, codes: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Edges that join all codes of a bucket within ``near`` places of one another, directly or through others.

    Each code is compared with one leader per tree first, and then with those codes that are still in
    other trees; a bucket that is one large family so costs little more than its size.
    """
    n, edges, leaders = len(rep), [], [0]
    root = np.arange(n)

    def join(i: int, at: np.ndarray) -> None:
        for other in at[_distance(codes[at], codes[i]) <= near].tolist():
            a, b = int(root[other]), int(root[i])
            if a != b:
                root[: i + 1][root[: i + 1] == max(a, b)] = min(a, b)
                edges.append((int(rep[other]), int(rep[i])))

    for i in range(1, n):
        join(i, np.array(leaders))
        join(i, np.flatnonzero(root[:i] != root[i]))
        if root[i] == i:
            leaders.append(i)
    return edges


def _keys(coded: DataFrame, tables: list[np.ndarray], flip: bool, hot: Broadcast | None = None, only: bool = False, some: range | None = None) -> DataFrame:
    """key, rep, c0, c1 of every code in every table: its substring's bucket and, to flip, those with one bit of it changed.

    In buckets that ``hot`` (sorted keys, blocks) has, the key's upper bits name the code's block. ``only`` gives their rows alone, as key, block, blocks, rep, c0, c1.
    ``some`` names the tables, all if None.
    """
    width = len(tables[0])
    names = ["key", *(["block", "blocks"] if only else []), "rep", "c0", "c1"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([0, *(1 << k for k in range(width))] if flip else [0], np.int64)
        for batch in batches:
            rep, c0, c1 = (batch.column(k).to_numpy() for k in range(3))
            bits = np.unpackbits(np.ascontiguousarray(np.stack([c0, c1], axis=1)).view(np.uint8).reshape(len(rep), 16), axis=1, bitorder="little")
            for t in range(len(tables)) if some is None else some:
                places = tables[t]
                own = bits[:, places].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                columns = [(own[:, None] ^ flips[None, :]).ravel() | t << width, *(np.repeat(x, len(flips)) for x in (rep, c0, c1))]
                if hot is not None:
                    keys, blocks = hot.value
                    at = np.searchsorted(keys, columns[0])
                    at[at == len(keys)] = 0
                    heavy = keys[at] == columns[0]
                    block = np.where(heavy, (mix(columns[1].view(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64), 0)
                    columns = [x[heavy] for x in (columns[0], block, blocks[at], *columns[1:])] if only else [columns[0] | block << 47, *columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return coded.mapInArrow(tidied(place), ", ".join(f"{n} long" for n in names))


def _hot(coded: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """key, blocks: the buckets that may hold more than about CODES codes, and the blocks to deal each into; at most one for every CODES places in a table."""
    width = len(tables[0])
    own = _keys(coded, tables, False).groupBy("key").agg(F.count("*").alias("n")).where(f"n * {width + 1} > {CODES}")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(width)))
    near = own.select(F.explode(F.transform(flips, lambda x: F.col("key").bitwiseXOR(x))).alias("key"), "n")
    return near.groupBy("key").agg(F.ceil((F.sum("n") + CODES) / CODES).cast("long").alias("blocks"))


def _forests(scratch: Scratch, coded: DataFrame, tables: list[np.ndarray], near: int, name: str) -> DataFrame:
    """(a, b): edges that join all near vectors of every bucket, directly or through others.

    A bucket that is too large for a task is dealt into blocks: each block has its forest, and all its members that are near its
    least one are joined with that. Of the buckets that then still hold several components, blocks are compared two by two, across components only.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            edges = []
            cuts = np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] - 1 if rows.shape[1] else []))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.shape[1]], strict=True):
                if b - a > 1:
                    codes = np.ascontiguousarray(rows[2:, a:b].T).view(np.uint64)
                    if b - a == 2:
                        if _distance(codes[0], codes[1]) <= near:
                            edges.append((int(rows[1, a]), int(rows[1, a + 1])))
                    else:
                        edges += _small_forest(rows[1, a:b], codes, near)
            return np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)])
            if not rows.shape[1]:
                continue
            if held and held[-1][0, -1] != rows[0, -1]:
                # the last bucket of this batch may go on in the next one
                cut = int(np.searchsorted(rows[0], rows[0, -1]))
                a, b = flush(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = [rows[:, cut:]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            else:
                held.append(rows)
        if held:
            a, b = flush(np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    spread = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = scratch.save(_hot(coded, tables), f"{name}-hot")
    n_hot = hot.count()
    shared = None
    if 0 < n_hot <= HOT_ROWS:
        rows = hot.orderBy("key").toArrow()
        shared = coded.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("key", "blocks")))  # its rows are counted
        members = scratch.save(_keys(coded, tables, True, shared, True), f"{name}-members")

    def dealt(some: range | None) -> DataFrame:
        out = _keys(coded, tables, True, some=some).join(hot, "key", "left")
        return out.withColumn("block", F.expr("if(blocks is null, 0L, pmod(xxhash64(rep), blocks))"))

    if n_hot > HOT_ROWS:
        members = scratch.save(dealt(None).where("blocks is not null"), f"{name}-members")
    # one table after the other, so that no more than its places lie on disk at once
    found, each = None, max(1, PLACED // max(1, coded.count() * (len(tables[0]) + 1)))
    for t in range(0, len(tables), each):
        some = range(t, min(t + each, len(tables)))
        if n_hot > HOT_ROWS:
            placed = dealt(some).select((F.col("key") + F.shiftleft("block", 47)).alias("key"), "rep", "c0", "c1")
        else:
            placed = _keys(coded, tables, True, shared, some=some)
        edges = placed.repartition(spread, "key").sortWithinPartitions("key", "rep").mapInArrow(tidied(join), "a long, b long").distinct()
        edges = scratch.save(edges, f"{name}-forests-{t}")
        found = edges if found is None else found.unionByName(edges)
    if not n_hot:
        return found
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "c0", "c1")).alias("hub"))
    apart = F.bit_count(F.col("c0").bitwiseXOR(F.col("hub.c0"))) + F.bit_count(F.col("c1").bitwiseXOR(F.col("hub.c1")))
    stars = members.join(hubs, "key").where((apart <= near) & (F.col("rep") != F.col("hub.rep"))).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    found = scratch.save(found.unionByName(stars), f"{name}-stars")
    first = components(scratch, found, f"{name}-first")
    members = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = members.join(mixed, "key").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "c0", "c1")

    def across(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, rep, component = (table.column(c).to_numpy() for c in ("block", "rep", "component"))
        codes = np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in ("c0", "c1")], axis=1)).view(np.uint64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        for a in range(0, len(left), 128):
            mine = left[a : a + 128]
            hit = (_distance(codes[mine][:, None, :], codes[right][None, :, :]) <= near) & (component[mine][:, None] != component[right][None, :])
            for x, y in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
                p, q = find(int(component[mine[x]])), find(int(component[right[y]]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(rep[mine[x]]), int(rep[right[y]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return scratch.save(found.unionByName(rows.groupBy("key", "i", "j").applyInArrow(across, "a long, b long")), f"{name}-all")


def _small_forest(rep: np.ndarray, codes: np.ndarray, near: int) -> list[tuple[int, int]]:
    """``near_forest``, from one comparison of all pairs while the bucket is small."""
    if len(rep) > 256:
        return near_forest(rep, codes, near)
    d = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(axis=2)
    x, y = np.nonzero(np.triu(d <= near, 1))
    root, edges = list(range(len(rep))), []

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            edges.append((int(rep[a]), int(rep[b])))
    return edges


def _links(scratch: Scratch, clusters: DataFrame, classes: DataFrame, threshold: float, dimension: int) -> list[str]:
    """The names of tables of rep, links to vectors of other classes and, in forest rows, b: a class that it is linked with.

    A block of a cluster meets each other one, and its vectors are sent once for each. That is done in passes, each of which sends about as many vectors
    as the clusters have, and whose shuffle files are gone before the next: what lies on disk doesn't grow with the clusters' blocks.
    """
    total = clusters.count()
    most = min(LINKED, max(BLOCK, NUMBERS // dimension), max(BLOCK, total // 64))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    rows = clusters.join(sizes, "component").join(classes.select(F.col("rep").alias("node"), "size", "v"), "node")
    rows = rows.withColumn("blocks", F.expr(f"cast(ceil(n / {most}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    name = f"links-{dimension}"
    rows = scratch.save(rows.select("component", "blocks", "block", "node", "size", "v"), f"{name}-members")
    sent = rows.agg(F.sum("blocks")).first()[0] or 0
    passes = max(1, -(-sent // max(SENT, total)))

    def compare(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node, size = (table.column(c).to_numpy() for c in ("block", "node", "size"))
        vectors = unit(_matrix(table.column("v").combine_chunks(), dimension))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = np.zeros((len(left), len(right)), bool)
        weight, counts = size.astype(np.float64), np.zeros(len(node))  # sums of whole numbers, exact
        single, slack = vectors.astype(np.float32), (dimension + 8) * 2.0**-22
        theirs = np.ascontiguousarray(single[right].T)
        for a in range(0, len(left), 512):
            mine = left[a : a + 512]
            # single precision rules most pairs out; double precision decides the others
            x, y = np.divmod(np.flatnonzero(single[mine] @ theirs >= threshold - slack), len(right))
            if len(x) > len(mine) * len(right) // 16:
                x, y = np.divmod(np.flatnonzero(vectors[mine] @ vectors[right].T >= threshold), len(right))
            else:
                parts = [np.zeros(0, bool)]
                for c in range(0, len(x), most):
                    parts.append(np.einsum("ij,ij->i", vectors[mine[x[c : c + most]]], vectors[right[y[c : c + most]]]) >= threshold)
                some = np.concatenate(parts)
                x, y = x[some], y[some]
            if i == j:
                other = x + a != y
                x, y = x[other], y[other]
            linked[x + a, y] = True
            counts[mine] += np.bincount(x, weight[right[y]], len(mine))
            if i != j:
                counts[right] += np.bincount(y, weight[mine[x]], len(right))
        # a forest of the links: breadth first from each class not yet reached
        sides = ((linked, left, right), (np.ascontiguousarray(linked.T), right, left))
        new, a, b = np.ones(len(node), bool), [], []
        for start in np.flatnonzero(linked.any(axis=1)).tolist():
            if not new[left[start]]:
                continue
            new[left[start]], todo = False, [(0, start)]
            while todo:
                side, x = todo.pop()
                near, mine, theirs = sides[side]
                found = np.flatnonzero(near[x] & new[theirs])
                new[theirs[found]] = False
                a += [int(node[mine[x]])] * len(found)
                b += node[theirs[found]].tolist()
                todo += [(1 - side if i != j else 0, y) for y in found.tolist()]
        some = np.flatnonzero(counts)
        return pa.table({"rep": pa.array([*node[some].tolist(), *a], pa.int64()), "n": pa.array([*counts[some].astype(np.int64).tolist(), *[0] * len(a)], pa.int64()), "b": pa.array([*[None] * len(some), *b], pa.int64())})

    names = []
    for k in range(passes):
        first = F.expr(f"cast(pmod({k} - block - pmod(xxhash64(component), {passes}), {passes}) as int)")
        pairs = rows.withColumn("first", first).where("first < blocks").withColumn("other", F.explode(F.expr(f"sequence(first, blocks - 1, {passes})")))
        pairs = pairs.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "v")
        names.append(f"{name}-{k}")
        scratch.save(pairs.groupBy("component", "i", "j").applyInArrow(compare, LINKS), names[-1])
    scratch.drop(f"{name}-members")
    return names


def near_duplicates(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", threshold: float = 0.9, substring: int = SUBSTRING) -> DataFrame:
    """id, n_links, component_id and kept for every row; rows are linked where their cosine reaches the threshold."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    given = Columns(vectors)
    return by_number(scratch, given, id, [given.col(column).alias("v")], lambda rows: _linked(scratch, rows, threshold, substring))


def _linked(scratch: Scratch, vectors: DataFrame, threshold: float, substring: int) -> DataFrame:
    rows, classes, dimensions = classes_of(vectors, scratch)
    if dimensions:
        names: list[str] = []
        for dimension, n in dimensions.items():
            mine = classes.where(F.size("v") == dimension)
            plan = plan_for(sample_of(mine, dimension), n, threshold, substring) if n > BLOCK else None
            if plan is None:  # so few are no sample to fit axes on, or codes that say nothing of these vectors: all are compared, in blocks
                clusters = mine.where("rep is not null").select(F.col("rep").alias("node"), F.lit(0).cast("long").alias("component"))
            else:
                quantiser, tables, near = plan
                coded = scratch.save(_sent(mine, quantiser, dimension), f"coded-{dimension}")
                clusters = components(scratch, _forests(scratch, coded, tables, near, f"near-{dimension}"), f"clusters-{dimension}")
            names += _links(scratch, clusters, mine, threshold, dimension)
            if plan is not None:  # all that is made of these tables is written
                scratch.drop(f"coded-{dimension}", *(f"near-{dimension}-{n}" for n in ("hot", "members", "stars", "all")), *(f"near-{dimension}-forests-{t}" for t in range(len(tables))))
        links = scratch.spark.read.schema(LINKS).parquet(*map(scratch.path, names))
        found = components(scratch, links.where("b is not null").selectExpr("rep a", "b"), "all")
        counts = links.where("b is null").groupBy("rep").agg(F.sum("n").alias("n"))
        labels = classes.select("key", "rep", "size").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        labels = labels.select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    else:
        labels = classes.select("key", (F.col("size") - 1).alias("n_links"), F.col("rep").alias("component"))
    labels = scratch.save(labels, "labels")
    out = rows.join(labels, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.expr("if(key is null, id, component)").alias("component_id"))
    return out.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
