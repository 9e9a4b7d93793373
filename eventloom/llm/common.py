"""What the training-data operators share: scratch tables, text buffers, word hashes and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step takes at once; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19


# --------------------------------------------------------------------- scratch
def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session where it is unset, as in tests, gets a temporary one;
    on a cluster that would be another folder on every machine, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the driver's session has ended
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


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


class Scratch:
    """Tables in the shared folder. They cut lineage, and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/eventloom/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        # results may read these tables until the driver ends
        atexit.register(_delete, spark, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``save``, in ``buckets`` buckets by ``key``, sorted within: such tables are joined by key without a shuffle."""
        table = f"eventloom_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", self.path(name)).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            _delete(self.spark, self.path(name))


# ------------------------------------------------------------------- broadcasts
_HELD: dict[str, tuple] = {}


def held(shared, kind: str):
    """A broadcast's value. A worker keeps the last one of each kind until its task ends, not those of all jobs that it ever served."""
    key = getattr(shared, "_path", None) or id(shared)
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD.pop(kind, None)
        _HELD[kind] = key, shared.value
        vars(shared).pop("_value", None)
    return _HELD[kind][1]


def released(shared: list) -> None:
    """Lets a worker forget the values of these broadcasts; they are read again where needed."""
    for b in shared:
        vars(b).pop("_value", None)


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of a task, after which its worker gives memory that it no longer needs back to the machine; idle workers would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            _HELD.clear()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


# --------------------------------------------------------------------- columns
class Columns:
    """A table with its columns named by place (c0, c1, ...), so that no name of theirs clashes with one used inside.

    ``columns`` are those to pass through, all if None; a column that is called like one of ``made``, in any case of
    letters, is replaced by that and doesn't pass. Of columns whose names differ in case only, a name means the one
    that is written alike, and else the first.
    """

    def __init__(self, df: DataFrame, columns: list[str] | None = None, made: Iterable[str] = ()):
        self.names, self.types = df.columns, [f.dataType for f in df.schema.fields]
        self.frame = df.toDF(*(f"c{k}" for k in range(len(self.names))))
        taken = {m.lower() for m in made}
        chosen = range(len(self.names)) if columns is None else map(self.at, columns)
        self.kept = [k for k in chosen if self.names[k].lower() not in taken]

    def at(self, name: str) -> int:
        """The place of a column."""
        if name in self.names:
            return self.names.index(name)
        lower = [n.lower() for n in self.names]
        if name.lower() not in lower:
            raise ValueError(f"no column {name} among {', '.join(self.names)}")
        return lower.index(name.lower())

    def col(self, name: str) -> Column:
        return F.col(f"c{self.at(name)}")

    def text(self, name: str) -> Column:
        return self.col(name).cast("string").alias(f"t{self.at(name)}")

    def passing(self) -> list[Column]:
        return [F.col(f"c{k}") for k in self.kept]

    def schema(self, *made: tuple[str, T.DataType | str]) -> T.StructType:
        """Of the passing columns by place, and the made ones."""
        out = T.StructType([T.StructField(f"c{k}", self.types[k]) for k in self.kept])
        for name, kind in made:
            out = out.add(name, kind)
        return out

    def named(self, df: DataFrame) -> DataFrame:
        """A table that begins with the passing columns, under their names again."""
        return df.toDF(*(self.names[k] for k in self.kept), *df.columns[len(self.kept) :])

    def id_type(self, name: str) -> str:
        """long for a column of whole numbers, else string."""
        return "long" if isinstance(self.types[self.at(name)], T.IntegralType) else "string"


def numbered(scratch: Scratch, ids: DataFrame) -> DataFrame:
    """(id, number) of the different non-null values of a one-column table (id), numbered in their order.

    The driver gets one count a range partition.
    """
    spark = scratch.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.where("id is not null").distinct().repartitionByRange(parts, "id").sortWithinPartitions("id")
    # within a partition the lower bits count rows from 0
    placed = scratch.save(ordered.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "numbers")
    count = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before, at = [], 0
    for k in range(max(count, default=-1) + 1):
        before.append(at)
        at += count.get(k, 0)
    return placed.select("id", (F.element_at(F.array(*map(F.lit, before or [0])), F.col("part") + 1) + F.col("row")).cast("long").alias("number"))


def by_number(scratch: Scratch, given: Columns, id: str, columns: list[Column], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over a table of id and these columns, with its id and component_id as whole numbers.

    Ids that are no whole numbers are numbered in their order for it, and put back.
    """
    rows = given.frame.select(given.col(id).alias("id"), *columns)
    if given.id_type(id) == "long":
        return run(rows.withColumn("id", F.col("id").cast("long"))).withColumnRenamed("id", id)
    numbers = numbered(scratch, rows.select("id"))
    out = run(rows.join(numbers, "id", "left").drop("id").withColumnRenamed("number", "id").select("id", *rows.columns[1:]))
    back = out.join(numbers.selectExpr("id name", "number id"), "id", "left").join(numbers.selectExpr("id component_name", "number component_id"), "component_id", "left")
    names = {"id": "name", "component_id": "component_name"}
    return back.select(*[F.col(names.get(c, c)).alias(id if c == "id" else c) for c in out.columns])


# ---------------------------------------------------------------- text buffers
def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, end to end, and where each text starts (one more entry than texts). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(starts: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text is alone."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


# ----------------------------------------------------------------- word hashes
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
_VALUES = _table(20240229)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: White space as the shingle contract has it: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All that is neither an ASCII letter or digit nor part of a longer UTF-8 sequence.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    NOT_WORD[ord(_a) : ord(_b) + 1] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, end to end."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = ~separators[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    before[cuts] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(first, starts)


def word_hashes(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and the first word of each text (one more entry than texts)."""
    first, last, bounds = word_spans(raw, starts, separators)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    up, down = _powers(len(raw) + 1)
    values = _VALUES[ASCII_LOWER] if lower else _VALUES
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), bounds


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ------------------------------------------------------------------ components
def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps on tables in the shared folder. Each step aggregates
    before it shuffles, and joins back by node, so that a node with very many edges is split by
    adaptive execution. The driver sees two numbers a step, never the links.
    """
    spark = scratch.spark
    now = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        step += 1
        new = scratch.save(small, f"{name}-{step}")
        found = tuple(new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        scratch.drop(f"{name}-{step - 1}")
        now = new
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.selectExpr("b node", "b component").distinct())


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies keep this file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Executors share their cores among tasks, so native libraries in a task keep to one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
