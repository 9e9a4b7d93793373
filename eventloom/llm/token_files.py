"""Token-id files: one wavelet matrix per shard.

Documents go in ascending order of id. A shard holds the ids of some documents, end to end, as ranks in
its own alphabet, the most frequent id first, and the ranks as a wavelet matrix: a bit-plane for each
bit of the last rank, from the highest down; each plane splits the order of the one above stably into
zeros and then ones. Counts of ones before every block give rank, and a
search over them select, so one file answers which token stands at a place, how often a token occurs
in a range, and where its n-th occurrence is. Planes are compressed in segments that are read alone.

A shard is one file, complete in itself with its documents' ids, in any store that Spark writes: its bytes are the one line of a file of
Spark's text writer, whose commit leaves out what lost executors wrote. The folders above a file name its part, its number there, and its
ids and those before it in the part. ``WaveletMatrix.open`` reads the header of a file and then the segments that a question needs.

Defined results: a null or empty text is the end id alone. Null ids sort first. Repeated ids keep all their rows, in the order of a hash
of their texts, by which they are dealt too. A very long text is encoded whole and is a shard by itself or the end of one. An empty table gives no shards. Columns beyond id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.bpe import encoder
from eventloom.llm.common import Columns, Scratch, tidied

MAGIC = b"EVWM0003"
#: Ids after which a shard is closed; bounds a task's memory.
SHARD_IDS = 2_000_000
#: Bits counted together for rank, and bits compressed together.
BLOCK_BITS, SEGMENT_BITS = 512, 1 << 17
_HEADER = "<8sQQIIQ"


# ------------------------------------------------------------------ the file
def write_matrix(ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array | None = None) -> bytes:
    """The file of a shard: header, alphabet, document lengths, zeros of each plane, rank counts, segment ends, documents' ids, segments."""
    n = len(ids)
    seen = np.bincount(ids)
    alphabet = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    rank = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    width = max(1, (len(alphabet) - 1).bit_length()) if n else 1
    now = rank[ids]
    press = zstandard.ZstdCompressor(level=1)
    zeros, ranks, segments = [], [], []
    for bit in range(width - 1, -1, -1):
        ones = (now & now.dtype.type(1 << bit)) != 0
        plane = np.packbits(ones, bitorder="little").tobytes()
        padded = np.zeros(-(-n // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
        padded[: len(plane)] = np.frombuffer(plane, np.uint8)
        per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes())
        step = SEGMENT_BITS // 8
        segments += [press.compress(plane[a : a + step]) for a in range(0, len(plane), step)]
        # both parts keep their order; taking by position is much faster than by mask
        now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
        zeros.append(n - int(per_block.sum()))
    ends = np.cumsum([len(s) for s in segments], dtype=np.int64).astype("<u8").tobytes()
    names = _packed(pa.array(np.arange(len(lengths))) if doc_ids is None else doc_ids)
    head = struct.pack(_HEADER, MAGIC, n, len(lengths), width, len(alphabet), len(names))
    return b"".join([head, alphabet.astype("<u4").tobytes(), np.asarray(lengths, "<u4").tobytes(), np.array(zeros, "<u8").tobytes(), *ranks, ends, names, *segments])


def _packed(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([values], names=["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class WaveletMatrix:
    """Reads a shard's file, given as bytes or as a file that can seek; segments are read and decompressed as they are needed."""

    def __init__(self, source):
        if isinstance(source, (bytes, bytearray, memoryview)):
            self._read = lambda at, n: source[at : at + n]
        else:
            self._read = lambda at, n: (source.seek(at), source.read(n))[1]
        at = struct.calcsize(_HEADER)
        head = self._read(0, at)
        magic, self.n, docs, self.width, letters, names = struct.unpack(_HEADER, head) if len(head) == at else (b"",) * 6
        if magic != MAGIC:
            raise ValueError("not a token file")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = np.frombuffer(self._read(at, size), kind, count)
            at += size
            return out

        self.alphabet = take("<u4", letters)
        self.lengths = take("<u4", docs).astype(np.int64)
        self.zeros = take("<u8", self.width).astype(np.int64)
        blocks = -(-self.n // BLOCK_BITS) + 1
        self.ranks = [take("<u4", blocks) for _ in range(self.width)]
        self.per_plane = -(-(-(-self.n // 8)) // (SEGMENT_BITS // 8))
        self.ends = take("<u8", self.per_plane * self.width).astype(np.int64)
        self.names, self.body = (at, names), at + names
        self.read: dict[int, np.ndarray] = {}
        self._ranks: dict[int, int] | None = None

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """The file at a path that this machine can open."""
        return cls(open(path, "rb"))  # noqa: SIM115

    @property
    def doc_ids(self) -> pa.Array:
        return pa.ipc.open_stream(pa.py_buffer(self._read(*self.names))).read_all().column(0).combine_chunks()

    def rank_of(self, token: int) -> int:
        """A token's place in the alphabet; -1 if the shard lacks it."""
        if self._ranks is None:
            self._ranks = {t: k for k, t in enumerate(self.alphabet.tolist())}
        return self._ranks.get(token, -1)

    def _segment(self, number: int) -> np.ndarray:
        if number not in self.read:
            a = self.body + (int(self.ends[number - 1]) if number else 0)
            raw = zstandard.ZstdDecompressor().decompress(self._read(a, self.body + int(self.ends[number]) - a))
            self.read[number] = np.frombuffer(raw, np.uint8)
        return self.read[number]

    def plane(self, level: int) -> np.ndarray:
        """All bits of a plane."""
        parts = [self._segment(level * self.per_plane + k) for k in range(self.per_plane)]
        return np.unpackbits(np.concatenate(parts) if parts else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def _bit(self, level: int, i: int) -> int:
        segment, bit = divmod(i, SEGMENT_BITS)
        return int(self._segment(level * self.per_plane + segment)[bit >> 3]) >> (bit & 7) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, left = divmod(i, BLOCK_BITS)
        count = int(self.ranks[level][block])
        if left:
            segment, bit = divmod(block * BLOCK_BITS, SEGMENT_BITS)
            raw = self._segment(level * self.per_plane + segment)[bit >> 3 : (bit >> 3) + -(-left // 8)].copy()
            if left & 7:
                raw[-1] &= (1 << (left & 7)) - 1
            count += int(np.bitwise_count(raw).sum())
        return count

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for level in range(self.width):
            one = self._bit(level, i)
            rank = self.ones(level, i)
            i = int(self.zeros[level]) + rank if one else i - rank
            out = out << 1 | one
        return int(self.alphabet[out])

    def _range(self, rank: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of a rank among places a to b lie below the last plane."""
        if rank < 0:
            return 0, 0
        for level in range(self.width):
            x, y = self.ones(level, a), self.ones(level, b)
            if rank >> (self.width - 1 - level) & 1:
                a, b = int(self.zeros[level]) + x, int(self.zeros[level]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token among places a to b, the end exclusive."""
        x, y = self._range(self.rank_of(token), a, self.n if b is None else b)
        return y - x

    def _select(self, level: int, one: int, k: int) -> int:
        """Place of the k-th one, or zero, of a plane."""
        low, high = 0, len(self.ranks[level]) - 1
        before = lambda block: int(self.ranks[level][block]) if one else block * BLOCK_BITS - int(self.ranks[level][block])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        k -= before(low)
        i = low * BLOCK_BITS
        segment, bit = divmod(i, SEGMENT_BITS)
        bits = np.unpackbits(self._segment(level * self.per_plane + segment)[bit >> 3 : (bit + BLOCK_BITS) >> 3], bitorder="little")
        return i + int(np.flatnonzero(bits == one)[k])

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of a token, counted from 0."""
        rank = self.rank_of(token)
        a, b = self._range(rank, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.width - 1, -1, -1):
            one = rank >> (self.width - 1 - level) & 1
            i = self._select(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest up."""
        if not self.n:
            return np.zeros(0, np.uint32)
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            ones = self.plane(level)
            zeros = int(self.zeros[level])
            up = np.empty_like(out)
            up[np.flatnonzero(~ones)] = out[:zeros]
            up[np.flatnonzero(ones)] = out[zeros:] | out.dtype.type(1 << (self.width - 1 - level))
            out = up
        return self.alphabet[out]


# ------------------------------------------------------------------- datasets
def encode_shards(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per shard: part, shard (their order is the documents' order), first, n_ids, payload.

    ``first`` counts the ids of the part's shards before this one.
    """
    given = Columns(docs)
    source = given.frame.select(given.col(id).alias("doc_id"), given.text(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    partitions = max(1, source.sparkSession.sparkContext.defaultParallelism, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = source.repartitionByRange(partitions, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(path), ["part", "shard", "first", "n_ids", "payload"]
        parts: list[np.ndarray] = []
        held: list = []
        total, shard, first, part, type_ = 0, 0, 0, 0, None

        def close() -> pa.RecordBatch:
            payload = write_matrix(np.concatenate(parts), np.array([len(p) for p in parts]), pa.array(held, type_))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], names=names)

        for batch in batches:
            type_ = batch.column(0).type
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(np.append(enc.encode(t.as_py() or ""), np.uint32(end_id)))
                held.append(i)
                total += len(parts[-1])
                if total >= shard_ids:
                    yield close()
                    parts, held, total, shard, first = [], [], 0, shard + 1, first + total
        if parts:
            yield close()

    return ordered.mapInArrow(tidied(build), "part int, shard int, first long, n_ids long, payload binary")


def write_shards(shards: DataFrame, folder: str) -> None:
    """One file per shard: folder/part=/shard=/first=/n_ids=/..., whose bytes are the payload and a line end."""
    shards.withColumn("payload", F.col("payload").cast("string")).write.mode("overwrite").partitionBy("part", "shard", "first", "n_ids").text(folder)


def read_documents(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' files."""
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(folder)
    if "part" not in files.columns:  # no shard
        return spark.createDataFrame([], schema)
    # from the folders' names: one row a range partition, of which there are as many as the session's setting says
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = per_part.select("part", before.alias("before"))
    source = files.join(F.broadcast(per_part), "part").select("content", (F.col("before") + F.col("first")).cast("long").alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                matrix = WaveletMatrix(memoryview(content.as_buffer()))
                raw = matrix.ids().astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(matrix.lengths)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([matrix.doc_ids, pa.array(at[:-1] + first), pa.array(matrix.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return source.mapInArrow(tidied(read), schema)


def write_and_read(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """``encode_shards`` written to a folder (one in the shared folder if none is given), and ``read_documents`` of what was written."""
    folder = folder or Scratch(docs.sparkSession, "tokens").path("shards")
    write_shards(encode_shards(docs, path, id, text, end_id, shard_ids), folder)
    return read_documents(docs.sparkSession, folder, Columns(docs).types[Columns(docs).at(id)].simpleString())
