"""Values out of log lines, listings and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(line: Column, name: str) -> Column:
    """Text of ``name='...'``; null without it."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s){name}='([^']*)'", 1), F.lit(""))


def unescape(line: Column) -> Column:
    """The two character references that event logs use in names."""
    return F.replace(F.replace(line, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def stamp_ms(stamp: Column) -> Column:
    """Seconds with three decimals as milliseconds."""
    return F.replace(stamp, F.lit("."), F.lit("")).try_cast("long")


def align_us(ms: Column, offset_ms: Column) -> Column:
    """Milliseconds of one clock as microseconds of another that started ``offset_ms`` later."""
    return (ms - offset_ms) * 1000


def elapsed_seconds(line: Column, short: bool = False) -> Column:
    """Seconds of ``[h:]m:ss.ffelapsed``; with ``short`` only the last digit of the minutes is read."""
    if short:
        at = r"(\d):(\d\d.\d\d)elapsed"
        return 60 * F.regexp_extract(line, at, 1).try_cast("int") + F.replace(F.regexp_extract(line, at, 2), F.lit(":"), F.lit(".")).try_cast("double")
    at = r"(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)elapsed"
    hours = F.coalesce(F.nullif(F.regexp_extract(line, at, 1), F.lit("")).try_cast("int"), F.lit(0))
    return 3600 * hours + 60 * F.regexp_extract(line, at, 2).try_cast("int") + F.regexp_extract(line, at, 3).try_cast("double")


def shares(text: Column) -> Column:
    """``a: 0.5, b: 0.25`` as an array of (name, share), in order."""
    return F.transform(F.split(text, ", "), lambda e: F.struct(F.trim(F.split(e, ": ")[0]).alias("name"), F.split(e, ": ")[1].try_cast("double").alias("share")))


def site_key(site: Column, compile_id: Column) -> Column:
    return F.concat_ws(" - ", site, compile_id.cast("string"))


def bucket(number: Column, buckets: int = 1000) -> Column:
    """Three-digit bucket of a number."""
    return F.lpad(F.pmod(number, F.lit(buckets)).cast("string"), 3, "0")


def series_name(file: Column, prefixes: tuple[str, ...]) -> Column:
    """A file's name without its ending and these parts."""
    out = F.regexp_replace(file, r"\.[^.]*$", "")
    for p in prefixes:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
