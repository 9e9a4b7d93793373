"""Best-fit packing with certified bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into groups of bounded
size by a hash; each group is packed by best-fit decreasing, bin by bin with exact fits of one or two
pieces taken first as well, and the fewer bins count. Dual feasible functions give a lower bound on the bins that its pieces need. A group whose bin count meets the bound is certified and
closed. In the other groups full bins stay, and the pieces of all other bins are dealt anew among groups of the same size,
and packed again, for as long as that lowers the count; a round that doesn't is not kept.

Defined results: null or empty text is the end id alone. Every row is a document of its own, so repeated rows, and rows with
a null id, are each packed once. A very long text is encoded whole and gives as many pieces as it needs. An empty table gives no pieces. Columns beyond id and text are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.bpe import encoder
from eventloom.llm.common import Columns, Scratch, tidied

#: Pieces that one group packs at once; bounds a task's memory at every input size.
GROUP_PIECES = 40_000

PIECES = "uid long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: uid, doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids themselves."""
    given = Columns(docs)
    source = given.frame.select(given.col(id).alias("doc_id"), given.text(text).alias("text"))
    schema = PIECES.format(id=source.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if keep_ids else "")
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                all_ids = np.append(enc.encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for p, (at, n) in enumerate(cut(len(all_ids), capacity)):
                    part = all_ids[at : at + n]
                    rows.append(k)
                    number.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            columns = [
                pa.array(np.arange(uid, uid + len(rows))),
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            uid += len(rows)
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return source.mapInArrow(tidied(split), schema)


# ----------------------------------------------------------------- one group
def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that these lengths need at least, by two families of dual feasible functions.

    A function f with f(x1) + ... + f(xn) <= 1 wherever x1 + ... + xn <= 1 gives the bound
    ceil(sum f(x)). One family rounds large items up to a whole bin and small ones down to nothing;
    the other rounds (k + 1) x down, but for multiples, and divides by k.
    """
    if not len(lengths):
        return 0
    size, count = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    return lower_bound_of_counts(dict(zip(size.tolist(), count.tolist(), strict=True)), capacity)


def lower_bound_of_counts(counts: dict[int, int], capacity: int) -> int:
    """``lower_bound`` of lengths that are given as length: count."""
    if not counts:
        return 0
    size, count = np.fromiter(counts, np.int64), np.fromiter(counts.values(), np.int64)
    best = -(-int((size * count).sum()) // capacity)
    for cutoff in range(1, capacity // 2 + 1):
        value = np.where(size > capacity - cutoff, capacity, np.where(size < cutoff, 0, size))
        best = max(best, -(-int((value * count).sum()) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * count).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the room left in every bin. Ties go to the item first in order."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, room = 0, []  # bit r of open_rooms: some bin has room r
    for i in order.tolist():
        n = int(lengths[i])
        fit = open_rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def _mirrored(bits: int, n: int) -> int:
    """Bit i as bit n - i, for i up to n."""
    return int(format(bits & ((1 << (n + 1)) - 1), f"0{n + 1}b")[::-1], 2)


def exact_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_fit_decreasing``, but one bin after the other.

    A bin begins with the largest item left and takes one or two items that fill it exactly if there are
    such, or else the largest that fits, and so on. Sizes that are left are bits of an integer, so an
    exact pair is a bit that a mirrored copy shares.
    """
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit s: items of size s are left
    for i in range(len(lengths) - 1, -1, -1):
        by_size[int(lengths[i])].append(i)
        there |= 1 << int(lengths[i])
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    while there:
        left, fill = capacity, [there.bit_length() - 1]
        while fill:
            for n in fill:
                i = by_size[n].pop()
                if not by_size[n]:
                    there ^= 1 << n
                bins[i], offsets[i] = len(room), capacity - left
                left -= n
            small = there & ((1 << (left + 1)) - 1)
            if not small:
                break
            pairs = small & _mirrored(small, left)
            half = left // 2
            if left % 2 == 0 and pairs >> half & 1 and len(by_size[half]) < 2:
                pairs ^= 1 << half
            if small >> left & 1:
                fill = [left]
            elif pairs:
                a = pairs.bit_length() - 1
                fill = [a, left - a]
            else:
                fill = [small.bit_length() - 1]
        room.append(left)
    return bins, offsets, np.array(room, np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packing with fewer bins of the two."""
    return min((f(lengths, capacity) for f in (best_fit_decreasing, exact_fit_decreasing)), key=lambda x: len(x[2]))


PACKED = "uid long, length long, sequence_id long, offset long, open boolean"


def _pack_group(capacity: int, base: int):
    def pack(key, table):
        table = table.sort_by("uid").combine_chunks()
        length = table.column("length").to_numpy()
        bins, offsets, room = pack_lengths(length, capacity)
        certified = len(room) == lower_bound(length, capacity)
        still = np.zeros(len(room), bool) if certified else room > 0
        return pa.table(
            {
                "uid": table.column("uid"),
                "length": table.column("length"),
                "sequence_id": pa.array(base + (key[0].as_py() << 20) + bins),
                "offset": pa.array(offsets),
                "open": pa.array(still[bins]),
            }
        )

    return pack


def _round(items: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    dealt = items.select("uid", "length", F.expr(f"pmod(xxhash64(uid, {number}), {groups})").alias("g"))
    return dealt.groupBy("g").applyInArrow(_pack_group(capacity, number << 48), PACKED)


def place(scratch: Scratch, items: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> tuple[DataFrame, dict]:
    """(uid, length, sequence_id, offset) for items (uid, length), and a report: bins, bound and bins after each round.

    The report's bound holds for all items together: the counts of the ``capacity`` lengths are all that it needs.
    """
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    n = sum(counts.values())
    everything = lower_bound_of_counts(counts, capacity)
    groups = max(1, -(-n // group_pieces))
    now = scratch.save(_round(items, groups, 0, capacity), "packed-0")
    total = now.select("sequence_id").distinct().count()
    report = {"pieces": n, "bound": everything, "bins": [total]}
    done = None
    for number in itertools.count(1):
        if total == everything or groups == 1:
            break
        left = now.where("open")
        state = left.agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins")).first()
        if not state["n"]:
            break
        groups = -(-state["n"] // group_pieces)
        again = scratch.save(_round(left, groups, number, capacity), f"packed-{number}")
        bins = again.select("sequence_id").distinct().count()
        if bins >= state["bins"]:
            break
        closed = now.where("not open")
        done = closed if done is None else done.unionByName(closed)
        now, total = again, total - state["bins"] + bins
        report["bins"].append(total)
    out = now if done is None else done.unionByName(now)
    return out.select("uid", "length", "sequence_id", "offset"), report


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the ids.

    Texts are encoded once; from there only ids and lengths move.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    table = scratch.save(pieces(docs, path, id, text, end_id, capacity, keep_ids), "pieces")
    placed, _ = place(scratch, table.select("uid", "length"), capacity)
    return table.join(placed.drop("length"), "uid").drop("uid")
