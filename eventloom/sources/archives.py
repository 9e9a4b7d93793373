"""Archives of text files (``.tar.gz``, ``.tar``): written from rows, and read back member by member.

A compressed archive is one stream, which a task unpacks from its beginning; many archives are many tasks. Spark decompresses the stream by
lines, and the tar format is followed in it, so neither an archive nor a member is ever held whole.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.sinks.scratch import write_named
from eventloom.sources.lines import split_lines

#: Bytes of a member that are one line at most; a longer line comes in pieces, and rows handed on at once.
PIECE, ROWS = 1 << 20, 4096
#: Fixed value: archives are made of blocks of so many bytes.
BLOCK = 512
SCHEMA = "archive string, member string, ord long, line string, more boolean, error string"


class _Stream:
    """A file over lines of bytes, as far as they go."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.left = lines, b""

    def read(self, size: int = -1) -> bytes:
        parts, n = [self.left], len(self.left)
        while n < size or size < 0:
            line = next(self.lines, None)
            if line is None:
                break
            parts += [line, b"\n"]
            n += len(line) + 1
        whole = b"".join(parts)
        self.left = whole[size:] if size >= 0 else b""
        return whole[:size] if size >= 0 else whole


def unpacked(archive: str, lines: Iterator[bytes]) -> Iterator[tuple]:
    """archive, member, ord, line, more, error of an archive's lines: a row a line of each regular member, and one with error where the archive breaks off.

    ``more`` marks pieces that the next row goes on with.
    """
    try:
        with tarfile.open(fileobj=_Stream(lines), mode="r|", bufsize=BLOCK) as tar:
            for member in tar:
                if not member.isfile():
                    continue
                # by blocks, so that all but the last block before a break is read
                inside, at, seen = tar.extractfile(member), 0, 0
                file = io.BufferedReader(inside.raw, BLOCK)
                while piece := file.readline(PIECE):
                    seen += len(piece)
                    more = not piece.endswith(b"\n") and seen < member.size
                    yield archive, member.name, at, piece.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), more, None
                    at += not more
                if seen < member.size:
                    raise tarfile.ReadError(f"{member.name} ends after {seen} of {member.size} bytes")
    except (tarfile.TarError, EOFError, OSError) as e:
        yield archive, None, None, None, None, f"{type(e).__name__}: {e}"


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """archive, member, ord, line, more, error: the lines of all text members of the archives at a path or pattern, numbered in their member.

    An archive that is cut off or damaged gives the lines before that, and a row whose ``error`` says what is wrong; so does one of which nothing can be read.
    Archives that aren't compressed may be read in splits; their lines then go to one task an archive.
    """
    read = spark.read.options(lineSep="\n", ignoreCorruptFiles="true")
    rows = split_lines(spark, path, read).withColumn("line", F.col("line").cast("binary"))
    rows = rows.select("file", "path", "split", "seq", "line")
    plain = rows.where(~F.col("path").rlike(r"\.t?gz$")).repartition("path").sortWithinPartitions("path", "split", "seq")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True)

        held: list[tuple] = []
        size = 0
        for (name, _), lines in groupby(each(), key=lambda r: r[:2]):
            stream = (line[2].as_py() for line in lines)
            for row in unpacked(name, stream):
                held.append(row)
                size += len(row[3] or "")
                if len(held) >= ROWS or size >= PIECE:
                    yield _batch(held)
                    held, size = [], 0
            for _ in stream:  # what stands behind the archive's end
                pass
        if held:
            yield _batch(held)

    found = rows.where(F.col("path").rlike(r"\.t?gz$")).mapInArrow(unpack, SCHEMA).unionByName(plain.mapInArrow(unpack, SCHEMA))
    listed = spark.createDataFrame([(f,) for f in read.text(path).inputFiles()], "path string")  # as the driver lists them for any read
    plainly = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  both spellings of a path
    blank = listed.select("path", plainly("path").alias("p")).join(rows.select(plainly("path").alias("p")).distinct(), "p", "left_anti")
    blank = blank.select(F.element_at(F.split("path", "/"), -1).alias("archive"), *[F.lit(None).cast(t).alias(c) for c, t in (("member", "string"), ("ord", "long"), ("line", "string"), ("more", "boolean"))], F.lit("nothing can be read").alias("error"))
    return found.unionByName(blank)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["archive", "member", "ord", "line", "more", "error"])


def _headers(names: pd.Series, sizes: pd.Series) -> pd.Series:
    """What stands before each member: text, for names in UTF-8 and members below 8 GB."""

    def one(name: str, size: int) -> str:
        info = tarfile.TarInfo(name)
        info.size = int(size)
        return info.tobuf(tarfile.GNU_FORMAT, "utf-8").decode("utf-8")

    return pd.Series([one(n, s) for n, s in zip(names, sizes, strict=True)], dtype="object")


def write_archives(rows: DataFrame, folder: str, *order: str) -> str:
    """A compressed archive ``folder/archive`` for each value of ``archive``, whose members hold the lines ``value`` in this order.

    Members are counted first, as their sizes stand before them; an archive is then written line by line by one task.
    """
    lines = rows.select("archive", "member", "value", *order)
    # a member's size, and the zeros that fill the last block of the one before it
    sizes = lines.groupBy("archive", "member").agg(F.sum(F.octet_length("value") + 1).alias("size"))
    zeros = lambda n: F.repeat(F.lit("\0"), n.cast("int"))
    fill = F.pmod(-F.col("size"), F.lit(BLOCK))
    place = Window.partitionBy("archive").orderBy("member")
    heads = sizes.select("archive", "member", F.concat(zeros(F.coalesce(F.lag(fill).over(place), F.lit(0))), F.pandas_udf(_headers, "string")("member", "size")).alias("head"), fill.alias("fill"), F.lead("member").over(place).isNull().alias("last"))
    first = F.row_number().over(Window.partitionBy("archive", "member").orderBy(*order)) == 1
    text = lines.withColumn("first", first).join(heads, ["archive", "member"]).select("archive", "member", F.lit(0).alias("end"), *order, F.when(F.col("first"), F.concat("head", "value")).otherwise(F.col("value")).alias("value"))
    ends = heads.where("last").select("archive", "member", F.lit(1).alias("end"), zeros(F.col("fill") + 2 * BLOCK).alias("value"))
    whole = text.unionByName(ends, allowMissingColumns=True).withColumnRenamed("archive", "name")
    return write_named(whole, folder, "member", "end", *order, compression="gzip")
