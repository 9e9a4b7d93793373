"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct word shingles. One hash pass deals the set into ``REGISTERS``
buckets; a bucket's register keeps, of the smallest hash in it, the count of leading zeros and ten
mantissa bits, 16 bits in all. Empty buckets borrow from others by a fixed order of probes, so that
registers agree with the probability of the sets' Jaccard similarity at every set size. Bands of
registers give candidates; registers, corrected for chance collisions, estimate the similarity, and
what is near the threshold is confirmed on full sets.

Equal sets are one class first. Within a band's bucket each class is paired with the smallest one.
The confirmed links give components. In buckets that then still hold several, pairs across components are compared
by registers, in blocks of bounded size, and each component's best candidate is confirmed; that goes on while it joins many. Only
classes that still have a candidate in another component are then compared with all of those on full sets, in smaller blocks.
Pairs inside a component need no comparison, as they change nothing, so that the members of a bucket's largest component are never
sent to one another. So components are those of all
links, and no step emits all pairs of a group: a block emits links that join what was apart.

Defined results: null texts and texts without words have an empty set, size 0, and are linked with
nothing; their component is themselves. A row with a null id belongs to the class of its set; a class that has only null ids
is linked with nothing, and its component is null. Repeated rows are each returned. Columns beyond id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, Columns, Scratch, by_number, chunks, components, mix, signed, text_buffer, tidied, word_hashes

REGISTERS = 128
#: Registers in a band. At similarity 0.8 a linked pair shares none of the 32 bands with probability 5e-8.
ROWS = 4
BANDS = REGISTERS // ROWS
#: Pairs whose estimate is this far under the threshold are not confirmed; the estimate's deviation is at most 0.045.
SLACK = 0.2
#: Classes, and shingles, of a bucket that are compared on full sets at once with as many others, and by registers; bounds a task's memory.
BLOCK, BLOCK_SHINGLES, BLOCK_REGISTERS = 512, 1_500_000, 1024

_ONE = np.uint64(1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _probes() -> np.ndarray:
    """For each bucket the order in which it looks for one to borrow from."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


PROBES = _probes()


# -------------------------------------------------------------------- sets
def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and where each text's begin."""
    words, bounds = word_hashes(raw, starts, SPACES)
    n_words = np.diff(bounds)
    n = len(n_words)
    whole = (n_words > 0) & (n_words < size)
    counts = np.where(n_words >= size, n_words - size + 1, whole.astype(np.int64))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], np.uint64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += mix(words[k : len(words) - size + 1 + k] * _K[k % len(_K)] + np.uint64(k + 1))
        long = np.flatnonzero(n_words >= size)
        index = np.repeat(bounds[:-1][long] - at[:-1][long], counts[long]) + _positions(at, long)
        out[_positions(at, long)] = mix(rolled[index])
    for d in np.flatnonzero(whole).tolist():
        h = np.array([n_words[d]], np.uint64)
        for w in range(bounds[d], bounds[d + 1]):
            h = mix(h * _K[0] + words[w : w + 1])
        out[at[d]] = h[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    doc = np.repeat(np.arange(n), counts)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n))]).astype(np.int64)


def _positions(at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """All positions of these texts in an array that ``at`` bounds."""
    counts = at[docs + 1] - at[docs]
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[docs] - (ends - counts), counts)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (text, bucket) of sorted sets; those of an empty set are zero."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    bits = int(np.log2(REGISTERS))
    slot = doc * REGISTERS + (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    rest = hashes[first] << np.uint64(bits)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << zeros << _ONE) >> np.uint64(54)
    out = np.zeros(n * REGISTERS, np.uint16)
    out[slot[first]] = ((zeros << np.uint64(10)) | mantissa).astype(np.uint16)
    filled = np.zeros(n * REGISTERS, bool)
    filled[slot[first]] = True
    out, filled = out.reshape(n, REGISTERS), filled.reshape(n, REGISTERS)
    for d in np.flatnonzero(~filled.all(axis=1) & (np.diff(at) > 0)).tolist():
        empty = np.flatnonzero(~filled[d])
        order = PROBES[empty]
        out[d, empty] = out[d, order[np.arange(len(empty)), filled[d][order].argmax(axis=1)]]
    return out


def _set_hashes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that name it."""
    out = []
    for x in (hashes, mix(hashes ^ _K[3])):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out.append(signed(sums[at[1:]] - sums[at[:-1]]))
    return out[0], out[1]


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that a register of unrelated sets of these sizes agrees, summed over the leading-zero counts."""
    a, b = np.maximum(np.asarray(a, float) / REGISTERS, 1.0)[:, None], np.maximum(np.asarray(b, float) / REGISTERS, 1.0)[:, None]
    level = np.arange(40)[None, :]
    high, low = 2.0**-level, 2.0 ** -(level + 1)

    def inside(m: np.ndarray) -> np.ndarray:
        return (1 - low) ** m - (1 - high) ** m

    return (inside(a) * inside(b)).sum(axis=1) / 1024


def estimate(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of rows of registers, corrected for collisions."""
    same = (sig_a == sig_b).mean(axis=1)
    chance = collision_rate(n_a, n_b)
    return (same - chance) / (1 - chance)


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary array with one entry per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """For documents (id, text): id, n_shingles, two hashes of the set (null if it is empty) and its registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffer(batch.column(1))
            for a, b in chunks(starts):
                hashes, at = shingle_sets(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size)
                n = np.diff(at)
                h1, h2 = _set_hashes(hashes, at)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n),
                        pa.array(h1, mask=none),
                        pa.array(h2, mask=none),
                        _binaries(registers(hashes, at)),
                    ],
                    names=["id", "n_shingles", "h1", "h2", "sig"],
                )

    return docs.mapInArrow(tidied(sketch), "id long, n_shingles long, h1 long, h2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw, at = text_buffer(column.cast(pa.binary()))
    return np.frombuffer(raw.tobytes(), np.uint16).reshape(len(at) - 1, REGISTERS)


# ------------------------------------------------------------------- links
def _near(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity isn't clearly under the threshold."""
    left = classes.selectExpr("rep a", "n_shingles na", "sig sa")
    right = classes.selectExpr("rep b", "n_shingles nb", "sig sb")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                near = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb) >= threshold - SLACK
                near &= np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return joined.mapInArrow(tidied(keep), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(sets.selectExpr("rep a", "hashes ha"), "a").join(sets.selectExpr("rep b", "hashes hb"), "b").select("a", "b", "ha", "hb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(tidied(keep), "a long, b long")


def _sets(docs: DataFrame, size: int, reps: DataFrame) -> DataFrame:
    """The full sets of these classes (at, h1, h2), each from the document (id, text) that the class is named after."""
    source = docs.join(reps, docs["id"] == reps["at"]).select("at", "h1", "h2", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffer(batch.column(3))
            for a, b in chunks(starts):
                hashes, at = shingle_sets(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size)
                rows = [hashes[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["rep", "hashes"])
                h1, h2 = _set_hashes(hashes, at)
                # rows of another text under the same id are not the class
                yield out.filter(pa.array((h1 == batch.column(1).slice(a, b - a).to_numpy()) & (h2 == batch.column(2).slice(a, b - a).to_numpy())))

    return source.mapInArrow(tidied(build), "rep long, hashes binary")


def _mixed(members: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """band, key, rep, component, and whether that is the bucket's largest, of the buckets that hold several components. Of buckets with the same members one stays."""
    placed = members.join(found, members["rep"] == found["node"], "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy("band", "key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("most")).where("parts > 1")
    most = most.join(shared.select("band", "key", "m1", "m2", "n"), ["band", "key"])
    most = most.groupBy("m1", "m2", "n").agg(F.min(F.struct("band", "key", "most")).alias("b")).select("b.band", "b.key", F.col("b.most.component").alias("most"))
    return placed.join(most, ["band", "key"]).select("band", "key", "rep", "component", (F.col("component") == F.col("most")).alias("large"))


def _dealt(rows: DataFrame, block: int, shingles: int | None = None) -> DataFrame:
    """The rows (band, key, rep, large, n_shingles, ...) in groups (band, key, i, j) of two blocks each. Blocks of the large component meet the others' only."""
    def count(what: str) -> Column:
        by_rows = F.sum(F.expr(f"if({what}, 1, 0)")) / block
        return F.ceil(by_rows if shingles is None else F.greatest(by_rows, F.sum(F.expr(f"if({what}, n_shingles, 0)")) / shingles)).cast("int")

    blocks = rows.groupBy("band", "key").agg(count("not large").alias("few"), count("large").alias("many")).where("few > 0")
    rows = rows.join(blocks, ["band", "key"])
    rows = rows.withColumn("block", F.expr("cast(if(large, few + pmod(xxhash64(rep), greatest(many, 1)), pmod(xxhash64(rep), few)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("if(large, sequence(0, few - 1), sequence(0, few + many - 1))")))
    return rows.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *[c for c in rows.columns if c not in ("band", "key", "few", "many", "other", "large")])


def _near_rows(table: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows of other components whose registers come near, estimates) for the rows of a group's first block; each pair in the first band that it shares."""
    band = table.column("band")[0].as_py()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block = table.column("block").to_numpy()
    rep, component, n = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
    sig = _matrix(table.column("sig").combine_chunks())
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left.tolist():
        y = right[component[right] != component[x]]
        y = y[(rep[y] > rep[x])] if i == j else y
        y = y[np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-9]
        if not len(y):
            continue
        same = sig[y] == sig[x]
        mine = same.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        y, same = y[mine], same[mine]
        chance = collision_rate(n[y], np.full(len(y), n[x]))
        near = (same.mean(axis=1) - chance) / (1 - chance)
        ok = near >= threshold - SLACK
        if ok.any():
            yield x, y[ok], near[ok]


def _suspects(mixed: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """band, key, rep of the classes with a candidate in another component, by registers; with each component's best candidate (a, b) in each two blocks."""
    rows = _dealt(mixed.join(classes.select("rep", "n_shingles", "sig"), "rep"), BLOCK_REGISTERS)

    def compare(table):
        rep, component = (table.column(c).to_numpy() for c in ("rep", "component"))
        flagged: set[int] = set()
        best: dict[int, tuple[float, int, int]] = {}
        for x, ys, near in _near_rows(table, threshold):
            flagged.add(x)
            flagged.update(ys.tolist())
            for y, e in zip(ys.tolist(), near.tolist(), strict=True):
                pair = (e, -int(min(rep[x], rep[y])), -int(max(rep[x], rep[y])))
                for c in (int(component[x]), int(component[y])):
                    if c not in best or pair > best[c]:
                        best[c] = pair
        marks, pairs = sorted(flagged), sorted({(-a, -b) for _, a, b in best.values()})
        n = len(marks) + len(pairs)
        band, key = table.column("band")[0].as_py(), table.column("key")[0].as_py()
        none = [None] * len(marks)
        return pa.table({"band": pa.array([band] * n, pa.int32()), "key": pa.array([key] * n, pa.binary()), "rep": pa.array([*rep[marks].tolist(), *[None] * len(pairs)], pa.int64()), "a": pa.array([*none, *(a for a, _ in pairs)], pa.int64()), "b": pa.array([*none, *(b for _, b in pairs)], pa.int64())})

    return rows.groupBy("band", "key", "i", "j").applyInArrow(compare, "band int, key binary, rep long, a long, b long")


def _across(mixed: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough of them to join all that are linked."""
    rows = _dealt(mixed.join(classes.select("rep", "n_shingles", "sig"), "rep"), BLOCK, BLOCK_SHINGLES).join(sets, "rep")

    def compare(table):
        rep, component, n = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        found: list[tuple[int, int]] = []
        for x, y, _ in _near_rows(table, threshold):
            own = hashes[x]
            flat = np.concatenate([hashes[k] for k in y.tolist()])
            at = np.searchsorted(own, flat)
            at[at == len(own)] = 0
            shared = np.add.reduceat(own[at] == flat, np.concatenate([[0], np.cumsum(n[y])[:-1]]), dtype=np.int64)
            for k in y[100 * shared >= percent * (n[y] + len(own) - shared)].tolist():
                p, q = find(int(component[x])), find(int(component[k]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((int(rep[x]), int(rep[k])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept for every row.

    Rows are linked where 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    """
    scratch = Scratch(docs.sparkSession, "near")
    given = Columns(docs)
    return by_number(scratch, given, id, [given.text(text).alias("text")], lambda rows: _linked(scratch, rows, size, percent))


def _linked(scratch: Scratch, docs: DataFrame, size: int, percent: int) -> DataFrame:
    threshold = percent / 100
    rows = scratch.save(sketches(docs, size), "rows")
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = scratch.save(classes.withColumn("rep", F.col("at")), "classes")
    bands = classes.where("rep is not null").select("rep", F.explode(F.expr(f"sequence(0, {BANDS - 1})")).alias("band"), "sig").selectExpr("rep", "band", f"substring(sig, 1 + band * {2 * ROWS}, {2 * ROWS}) key")
    named = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"m{k}") for k in (1, 2)]  # of the bucket's members
    shared = scratch.save(bands.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), *named).where("n > 1"), "shared")
    members = scratch.save(bands.join(shared.select("band", "key", "hub"), ["band", "key"]), "members")

    involved = members.select("rep").distinct().join(classes.select("rep", "at", "h1", "h2"), "rep")
    sets = _sets(docs, size, involved)
    if rows.where("id is not null").groupBy("id", "h1", "h2").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["rep"])
    sets = scratch.save(sets, "sets")
    stars = members.where("rep <> hub").selectExpr("rep a", "hub b").distinct()
    links = scratch.save(_confirmed(_near(stars, classes, threshold), sets, percent), "links-0")
    found, step = components(scratch, links, "cc-0"), 0
    while True:
        mixed = scratch.save(_mixed(members, shared, found), f"mixed-{step}")
        suspects = scratch.save(_suspects(mixed, classes, threshold), f"suspects-{step}")
        pairs = scratch.save(suspects.where("a is not null").select("a", "b").distinct(), f"pairs-{step}")
        step += 1
        new = scratch.save(_confirmed(pairs, sets, percent), f"links-{step}")
        joined = new.count()
        if joined:
            links = links.unionByName(new)
            found = components(scratch, links, f"cc-{step}")
        if 10 * joined <= pairs.count():  # most candidates aren't linked: what is left is compared on full sets
            break
    left = suspects.where("rep is not null").select("band", "key", "rep").distinct()
    if left.limit(1).count():
        mixed = scratch.save(_mixed(members.join(left, ["band", "key", "rep"], "left_semi"), shared, found), f"mixed-{step}")
        more = scratch.save(_across(mixed, classes, sets, threshold, percent), "across")
        found = components(scratch, links.unionByName(more), "all")

    labels = classes.join(found, classes["rep"] == found["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    labels = scratch.save(labels, "labels")
    scratch.drop("sets", "classes", "shared", "members", "across", *(f"{x}-{k}" for x in ("links", "mixed", "suspects", "pairs") for k in range(step + 1)))
    out = rows.select("id", "n_shingles", "h1", "h2").join(labels, ["h1", "h2"], "left")
    out = out.select("id", "n_shingles", F.expr("if(h1 is null, id, component)").alias("component_id"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
