"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger holds the pairs
(blob, rule, rule version) that were scanned. A run reduces its rows to names first and asks the ledger which of them have an unseen
pair; only the texts of those are fetched, past a bitmap of their names, so that seen text is never shuffled. Each is scanned once, and only by the rules whose
pair is not in the ledger. The findings are joined back to every row that holds the blob. Changing
a rule's version has just that rule scanned anew.

A rule is a regular expression whose matches are taken leftmost and without overlap, and a test that a
match must pass. Positions are code points, ends exclusive. The text between matches, from ``split``,
and the matches themselves, from ``regexp_extract_all``, give them.

Defined results: a null text is the empty text. Rows are matched to blobs by content, so null ids,
repeated rows and ties need no care. A very long text is one value of its row, scanned whole in one task; a pattern's cost grows with its length.
Columns beyond text pass through; an output column that clashes with an
input column, in any case of letters, replaces it. An empty table gives no rows and an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import Columns, Scratch


@dataclass(frozen=True)
class Rule:
    """``test`` takes a match. ``hint`` is a cheap pattern that is found wherever a passing match is."""

    name: str
    version: int
    pattern: str
    hint: str
    test: Callable[[Column], Column] = lambda m: F.lit(True)


#: The three base kinds, in the order in which ties of start are listed. Only runs of at least 16
#: can pass as hex, and the first run of 16 or more from the left is the same with either quantifier.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN, 2)) >= 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", lambda m: F.length(m) >= 18),
    Rule("hex", 1, "[0-9a-f]{16,}", "[0-9a-f]{16}"),
)
#: Kinds that this operator adds: private-key blocks, signed web tokens and prefixed service tokens.
EXTRA_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ[A-Za-z0-9_-]{8}"),
    Rule("prefixed", 1, "(gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})", "gh[pousr]_|xox[abprs]-|sk_live_"),
)
RULES = BASE_RULES + EXTRA_RULES

SPANS = "array<struct<start:int,kind_order:int,kind:string,end:int>>"
LEDGER = "blob string, scanned array<struct<rule:string,version:int>>, spans " + SPANS


def find(text: Column, rule: Rule, order: int) -> Column:
    """The rule's passing matches in a text, as an array of spans."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    # the text before each match, and at the end, with no match beside it, the text after the last
    steps = F.zip_with(F.split(text, rule.pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), F.coalesce(m.isNotNull() & rule.test(m), F.lit(False)).alias("ok")))

    def walk(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.name).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    none = F.array().cast(SPANS)
    return F.when(text.rlike(rule.hint), F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), walk, lambda s: s["out"])).otherwise(none)


def digest(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or chain of overlapping spans, replaced by its first kind in brackets."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.when(fresh, F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    return F.when(
        F.size(spans) > 0,
        F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2147483647))),
    ).otherwise(text)


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Bits of the bitmap of names at most (a power of two); a bitmap of this size is 32 MB.
BITS = 28


def _fetched(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of (blob, text) rows one for each wanted blob. Rows whose name isn't in a bitmap of the wanted ones are left where they are."""
    n = wanted.count()
    bits = min(BITS, max(15, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("blob"), F.lit(1 << bits)).cast("long")
    marks = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    marks = marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))  # a row for 32768 bits
    rows = blobs.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring("marks", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.join(F.broadcast(marks), "bucket").where(F.getbit(byte, F.col("bit") % 8) == 1)
    return rows.groupBy("blob").agg(F.first("text").alias("text"))


def scan_unseen(scratch: Scratch, blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The new ledger rows of the blobs (blob, text) that have an unseen pair.

    Findings of pairs that the ledger holds are taken from it; spans of older versions of a rule, and of rules no longer
    given, go. A blob is scanned once, whoever holds it; the partial aggregation leaves one copy a task before texts are shuffled.
    """
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    scanned, spans = F.array().cast("array<struct<rule:string,version:int>>"), F.array().cast(SPANS)
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    else:
        names = blobs.select("blob").distinct().join(ledger.selectExpr("blob", "scanned seen", "spans old"), "blob", "left")
        wanted = scratch.save(names.where(F.col("seen").isNull() | (F.size(F.array_except(pairs, F.col("seen"))) > 0)), "wanted")
        todo = _fetched(blobs, wanted).join(wanted, "blob")
        scanned, spans = F.coalesce("seen", scanned), F.coalesce("old", spans)
    found = []
    for order, rule in enumerate(rules):
        mine = find(F.col("text"), rule, order)
        if ledger is not None:
            known = F.exists(scanned, lambda p: (p["rule"] == rule.name) & (p["version"] == rule.version))
            mine = F.when(known, F.filter(spans, lambda s: s["kind"] == rule.name)).otherwise(mine)
        found.append(mine)
    return todo.select("blob", pairs.alias("scanned"), F.array_sort(F.concat(*found)).alias("spans"))


def keep_ledger(ledger: DataFrame, path: str) -> None:
    """Writes the ledger of a run to a folder of the caller's, beside those of the runs before. A ledger from ``scan`` lies in scratch, which ends with the driver."""
    name = f"{len(_ledgers(ledger.sparkSession, path)):08d}"
    ledger.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The last ledger that was written whole to the folder, None if there is none."""
    whole = _ledgers(spark, path)
    return spark.read.schema(LEDGER).parquet(whole[-1]) if whole else None


def _ledgers(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.isDirectory())
    return [f for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``columns`` of every row with blob and its spans, the ledger for the next run).

    The ledger is read from scratch, and gone when the driver ends: ``keep_ledger`` keeps it, and ``read_ledger`` finds it again.
    Only names of blobs and their findings meet in the join; a blob that very many rows hold is a
    skewed key there, which adaptive execution splits.
    """
    scratch = Scratch(versions.sparkSession, "secrets")
    given = Columns(versions, columns, ("blob", "spans"))
    words = given.text(text)
    blobs = given.frame.select(blob_name(words).alias("blob"), F.coalesce(words, F.lit("")).alias("text"))
    fresh = scratch.save(scan_unseen(scratch, blobs, ledger, rules), "ledger")
    if ledger is not None:
        fresh = scratch.save(fresh.unionByName(ledger.select(*fresh.columns).join(fresh.select("blob"), "blob", "left_anti")), "whole")
    rows = given.frame.select(*given.passing(), blob_name(words).alias("blob"))
    now = F.filter("spans", lambda s: s["kind"].isin([r.name for r in rules]))
    found = fresh.select("blob", now.alias("spans")).where(F.size("spans") > 0)
    out = rows.join(found, "blob", "left").select(*given.passing(), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return given.named(out), fresh
