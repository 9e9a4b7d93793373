"""The text report of a digest: written from timelines, and read back as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.text import bucket, shares
from eventloom.sinks.scratch import save
from eventloom.sources.lines import beside, carried, numbered_lines

# Fixed values of the format.
INDENT = "    "
SECTIONS = ("Changes", "Inversions", "RawWindowInformation")


def compilation_line(time: Column, kind: Column, id: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.lit("Compilation at: "), text(time), F.lit(" [kind = "), text(kind), F.lit(", id = "), text(id), F.lit("]"))


def decompilation_line(time: Column, id: Column, kind: Column, reason: Column, action: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    trap = F.when(reason.isNotNull() | action.isNotNull(), F.concat(F.lit("[trap: reason = "), text(reason), F.lit(", action = "), text(action), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("Decompilation at: "), text(time), F.lit("[compile_id = "), text(id), F.lit(", compile_kind = "), text(kind), F.lit("]"), trap)


def observation_lines(section: Column, label: Column, first: Column, second: Column) -> Column:
    """The lines of a change, an inversion or a window; ``first`` and ``second`` are share lists as text."""
    both = [F.concat(F.lit(f"{INDENT}First Window: "), first), F.concat(F.lit(f"{INDENT}Second Window: "), second)]
    change = F.array(F.format_string("window before: %d - window after: %d", label, label + 1), *both)
    inversion = F.array(F.format_string("windows: %d - %d", label, label + 1), *both)
    raw = F.array(F.format_string("window information for window: %d", label), F.concat(F.lit(INDENT), first))
    return F.when(section == "Changes", change).when(section == "Inversions", inversion).otherwise(raw)


def report_lines(rows: DataFrame, window_us: int, always_raw: bool = False) -> DataFrame:
    """bucket, callsite_id, compile_id, part, step, kind_ord, mark, nth, value: the report's lines, a row each. By these columns from
    ``part`` on the lines of a group are in order; no group is gathered.

    ``rows``: callsite_id, callsite, compile_id, t0, section, step, kind_ord, tag, and what the lines
    need: time_us, id, kind, reason, action, label, first, second. Groups without changes and inversions
    are left out; without inversions the raw windows are too, unless ``always_raw``.
    """
    keys, raw = ["callsite_id", "compile_id"], F.col("section") == SECTIONS[2]
    told = rows.where(~raw).groupBy(*keys).agg(F.max(F.col("section") == SECTIONS[1]).alias("__inverted"))
    rows = rows.join(told, keys)
    rows = rows if always_raw else rows.where(~raw | F.col("__inverted"))
    # written once, and read by titles, headings and bodies
    rows = save(rows.select(*keys, "callsite", "t0", "section", "step", "kind_ord", "tag", "time_us", "id", "kind", "reason", "action", "label", "first", "second"), "reported")
    lines = F.when(F.col("tag") == "C", F.array(compilation_line(F.col("time_us"), F.col("kind"), F.col("id"))))
    lines = lines.when(F.col("tag") == "D", F.array(decompilation_line(F.col("time_us"), F.col("id"), F.col("kind"), F.col("reason"), F.col("action"))))
    lines = lines.otherwise(observation_lines(F.col("section"), F.col("label"), F.col("first"), F.col("second")))
    part = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    place = ["callsite_id", "compile_id", "part", F.col("step").cast("long").alias("step"), F.col("kind_ord").cast("int").alias("kind_ord")]
    # rows of one step and kind are in the order of their first lines
    body = rows.withColumns({"part": part, "__lines": lines}).select(*place, F.get("__lines", F.lit(0)).alias("mark"), F.posexplode("__lines").alias("nth", "value"))
    body = body.withColumn("value", F.concat(F.lit(INDENT * 2), F.col("value")))
    first = [F.lit(None).cast(t).alias(c) for c, t in (("step", "long"), ("kind_ord", "int"), ("mark", "string"))]
    groups = rows.select(*keys, "callsite").distinct()
    title = groups.select(*keys, F.lit(0).alias("part"), *first, F.lit(0).alias("nth"), F.format_string("CCU [callsite=%s, compile_id=%d]", "callsite", "compile_id").alias("value"))
    parts = rows.select(*keys, "section", "t0").distinct()
    heads = parts.select(*keys, part.alias("part"), *first, F.lit(0).alias("nth"), F.format_string(f"{INDENT}%s[start time = %d, window size = {window_us}]:", "section", "t0").alias("value"))
    return title.unionByName(heads).unionByName(body).withColumn("bucket", bucket(F.col("callsite_id")))


#: The order of a group's lines; headings have no step and come first.
LINE_ORDER = ("callsite_id", "compile_id", "part", "step", "kind_ord", "mark", "nth")


def write_report(lines: DataFrame, folder: str) -> None:
    """The report's lines as text, in a folder for each bucket; a group's lines follow one another in one file, as they are sorted, not gathered.

    Lines are dealt by bucket: dealing by group would be left out as done already by the joins that made titles, headings and bodies, whose partitions adaptive
    execution may then join otherwise. A bucket that is never null is not sorted once more by the writer, which keeps no order among equals when it spills.
    """
    dealt = lines.withColumn("bucket", F.coalesce("bucket", F.lit(""))).repartition("bucket").sortWithinPartitions("bucket", *LINE_ORDER)
    dealt.select("value", "bucket").write.mode("overwrite").partitionBy("bucket").text(folder)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The timelines of report files, as ``parse_report`` gives them; a file of any size is read in splits."""
    return parse_report(numbered_lines(spark, path))


def parse_report(rows: DataFrame) -> DataFrame:
    """callsite, compile_id, section, window_us, file, ord, tag, id, kind, time_us, reason, action, label, first, second.

    ``rows``: file, ord, line. Each group's and section's heading holds for the lines after it; an
    observation is one row. With columns path and split, the lines of a split are scanned together, and what that needs of
    the splits before and after comes from one row a split; else those of a file are.
    """
    if "split" not in rows.columns:
        rows = rows.withColumns({"path": F.col("file"), "split": F.lit(0)})
    line, body = F.col("line"), F.trim("line")
    heads = {
        "callsite": F.when(line.startswith("CCU"), F.regexp_extract(line, r"CCU \[callsite=(.*), compile_id=.*\]", 1)),
        "compile_id": F.when(line.startswith("CCU"), F.regexp_extract(line, r"compile_id=(\d+)\]", 1).try_cast("long")),
        "section": F.when(line.startswith("CCU"), F.lit("")).otherwise(F.nullif(F.regexp_extract(body, rf"^({'|'.join(SECTIONS)})\[", 1), F.lit(""))),
        "window_us": F.nullif(F.regexp_extract(body, r"^\w+\[start time = .*size = ([\d.]+)\]:", 1), F.lit("")).try_cast("double").try_cast("long"),
    }
    order = Window.partitionBy("path", "split").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(heads).withColumn("head", F.col("section").isNotNull())
    others = carried(rows, list(heads), F.col("section").isNull(), 2).withColumnsRenamed({c: f"earlier_{c}" for c in heads})
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in heads})
    rows = rows.where("not head").withColumns({"next": F.lead("line").over(order), "after": F.lead("line", 2).over(order)})
    rows = beside(rows, others, "following")
    later = lambda k: F.get("following", F.lit(k))
    rows = rows.withColumns({c: F.coalesce(c, f"earlier_{c}") for c in heads})
    rows = rows.withColumns({"next": F.coalesce("next", later(0)), "after": F.coalesce("after", F.when(F.col("next").isNull(), later(1)).otherwise(later(0)))})
    body = F.trim("line")
    tag = F.when(body.startswith("Compilation"), "C").when(body.startswith("Decompilation"), "D").when(F.trim("line").rlike(r"^window(s| before| information)"), "W")
    got = lambda pattern: F.nullif(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), F.lit("null"))
    strip = lambda c, head: F.replace(F.trim(c), F.lit(head), F.lit(""))
    rows = rows.withColumn("tag", tag).where("tag is not null")
    return rows.select(
        "callsite",
        "compile_id",
        "section",
        "window_us",
        "file",
        "ord",
        "tag",
        F.when(F.col("tag") == "C", got(r", id = (\w+)")).otherwise(got(r"compile_id = (\w+)")).alias("id"),
        F.when(F.col("tag") == "C", got(r"\[kind = (\w+)")).otherwise(got(r"compile_kind = (\w+)")).alias("kind"),
        got(r"ompilation at: (-?\d+)").try_cast("long").alias("time_us"),
        got(r"reason = (\w+)").alias("reason"),
        got(r"action = (\w+)").alias("action"),
        F.when(F.col("tag") == "W", F.regexp_extract("line", r"(-?\d+)", 1).try_cast("long")).alias("label"),
        F.when(F.col("tag") == "W", strip("next", "First Window: ")).alias("first"),
        F.when((F.col("tag") == "W") & F.col("section").isin("Changes", "Inversions"), strip("after", "Second Window: ")).alias("second"),
    )


def parsed_shares(text: Column) -> Column:
    """A share list of a report as an array of (name, ratio)."""
    return F.transform(shares(text), lambda s: F.struct(s["name"].alias("name"), s["share"].alias("ratio")))
