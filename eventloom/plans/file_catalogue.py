"""Registered queries of the file formats: files are written from the tables, and read back by the sources."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import stats
from eventloom.plans.surrogate import table
from eventloom.sinks import files
from eventloom.sinks.scratch import drop_folder, number_rows, scratch_folder, write_named, write_ordered, write_series
from eventloom.sources import archives, eventlog, listings, reports, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Tells lines of orders apart.
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# ----------------------------------------------------------------- event logs
_V = "WITH v AS (SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS et, CAST(user_id AS BIGINT) AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST((CAST(event_id AS BIGINT) * 37) % 100000 AS BIGINT) AS ms FROM events)"
_LOG = (
    _V + ", done AS (SELECT 'U' || u || ' run ()V' AS method, CAST(k % 200 AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN 'c1' ELSE 'c2' END AS kind, ms AS time_ms FROM v WHERE et = 'signup')"
    ", tasks AS (SELECT 'U' || u || ' <init> ()V' AS method, CAST(k % 400 AS VARCHAR) AS id, CASE WHEN k % 2 = 1 THEN 'c2' END AS kind, ms AS time_ms FROM v WHERE et = 'click')"
    ", comp AS (SELECT * FROM done UNION ALL SELECT * FROM tasks WHERE id NOT IN (SELECT id FROM done))"
    ", ends AS (SELECT CAST(k % 200 AS VARCHAR) AS id, CASE WHEN k % 2 = 1 THEN 'c2' END AS kind, CASE WHEN k % 7 <> 0 THEN ms END AS time_ms, row_number() OVER (PARTITION BY k % 200 ORDER BY event_id) AS i FROM v WHERE et = 'error')"
    ", traps AS (SELECT CAST(k % 200 AS VARCHAR) AS id, 'r' || (k % 4) AS reason, 'a' || (k % 3) AS action, row_number() OVER (PARTITION BY k % 200 ORDER BY event_id) AS i FROM v WHERE et = 'purchase')"
    ", de AS (SELECT method, ends.id, ends.kind, reason, action, time_ms FROM ends LEFT JOIN traps ON traps.id = ends.id AND traps.i = ends.i JOIN (SELECT DISTINCT method, id FROM comp) m ON m.id = ends.id WHERE time_ms IS NOT NULL) "
)
_START = 1_700_000_000_000


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user, value: a compiler event log's line for each event."""
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("user_id").cast("long").alias("u"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    ms = (F.col("event_id") * 37) % 100_000
    stamp = F.format_string(" stamp='%d.%03d'/>", F.floor(ms / 1000), ms % 1000)
    id_ = lambda n: F.format_string("compile_id='%d'", F.col("k") % n)
    kind = F.when(F.col("k") % 2 == 1, " compile_kind='c2'").otherwise("")
    compiler = F.when(F.col("k") % 3 == 0, "c1").otherwise("c2")
    made = F.concat(F.lit("<nmethod "), id_(200), F.format_string(" compiler='%s' method='U%d run ()V'", compiler, "u"), stamp)
    task = F.concat(F.lit("  <task "), id_(400), kind, F.format_string(" method='U%d &lt;init&gt; ()V'", "u"), stamp)
    end = F.concat(F.lit("<make_not_entrant "), id_(200), kind, F.when(F.col("k") % 7 != 0, stamp).otherwise("/>"))
    trap = F.concat(F.format_string("<uncommon_trap reason='r%d' action='a%d' ", F.col("k") % 4, F.col("k") % 3), id_(200), stamp)
    line = F.when(F.col("event_type") == "signup", made).when(F.col("event_type") == "click", task).when(F.col("event_type") == "error", end).when(F.col("event_type") == "purchase", trap).otherwise(F.lit("<other/>"))
    return e.select("event_id", "u", line.alias("value"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.read_log(spark, _log_folder(spark, d), one=True)


def _parsed_log(spark: SparkSession, d: str) -> DataFrame:
    """The log's entries; the text is removed once they are written."""
    folder = _log_folder(spark, d)
    rows = eventlog.parsed(eventlog.read_log(spark, folder, one=True))
    drop_folder(spark, folder)
    return rows


def _log_folder(spark: SparkSession, d: str) -> str:
    lines = _log_lines(spark, d).select("event_id", "value")
    head = lines.agg(F.max("event_id").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), F.format_string("<hotspot_log version='160 1' time_ms='%d'>", F.col("m") + _START).alias("value"))
    return write_ordered(head.unionByName(lines), scratch_folder(spark, "log"), "event_id")


@_query("log_start", f"SELECT CAST({_START} + max(event_id) AS BIGINT) AS start_ms FROM events")
def log_start(spark, d):
    return spark.createDataFrame([(eventlog.vm_start_ms(_log(spark, d)),)], "start_ms long")


@_query("log_compilations", _LOG + "SELECT * FROM comp")
def log_compilations(spark, d):
    return eventlog.compilations(_parsed_log(spark, d)).select("method", "id", "kind", "time_ms")


@_query("log_decompilations", _LOG + "SELECT * FROM de")
def log_decompilations(spark, d):
    return eventlog.decompilations(_parsed_log(spark, d)).select("method", "id", "kind", "reason", "action", "time_ms")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("long").alias("u")).where("u % 3 = 0").distinct()
    folder = scratch_folder(spark, "sites")
    rows.select(F.format_string("U%d run ()V,%d", "u", "u").alias("value")).write.text(folder)
    return traces.read_dictionary(spark, folder, "descriptor", "callsite_id")


@_query("site_dictionary", "SELECT DISTINCT 'U' || user_id || ' run ()V' AS descriptor, CAST(user_id AS BIGINT) AS callsite_id FROM events WHERE user_id % 3 = 0")
def site_dictionary(spark, d):
    return _sites(spark, d)


@_query(
    "log_site_events",
    _LOG + ", s AS (SELECT DISTINCT u AS callsite_id, 'U' || u || ' run ()V' AS method FROM v WHERE u % 3 = 0) "
    "SELECT callsite_id, 'C' AS tag, id, kind, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS action, (time_ms - 1000) * 1000 AS time_us FROM comp JOIN s USING (method) UNION ALL SELECT callsite_id, 'D', id, kind, reason, action, (time_ms - 1000) * 1000 FROM de JOIN s USING (method)",
)
def log_site_events(spark, d):
    return eventlog.state_events(_parsed_log(spark, d), _sites(spark, d), 1000).drop("ord")


def _part_sites(spark: SparkSession, d: str) -> DataFrame:
    """callsite_id, descriptor: ends of methods' names, which several methods contain, and one that none does."""
    rows = table(spark, d, "events").select((F.col("user_id").cast("long") % 100).alias("callsite_id")).distinct()
    return rows.select("callsite_id", F.format_string("%d run ()", "callsite_id").alias("descriptor")).unionByName(spark.createDataFrame([(1000, "no such method"), (1001, "<i")], "callsite_id long, descriptor string"))


@_query(
    "log_site_events_by_part",
    _LOG + ", s AS (SELECT DISTINCT CAST(user_id AS BIGINT) % 100 AS callsite_id, (CAST(user_id AS BIGINT) % 100) || ' run ()' AS descriptor FROM events UNION ALL SELECT 1000, 'no such method' UNION ALL SELECT 1001, '<i') "
    "SELECT callsite_id, 'C' AS tag, id, kind, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS action, (time_ms - 1000) * 1000 AS time_us FROM comp JOIN s ON contains(method, descriptor) UNION ALL SELECT callsite_id, 'D', id, kind, reason, action, (time_ms - 1000) * 1000 FROM de JOIN s ON contains(method, descriptor)",
)
def log_site_events_by_part(spark, d):
    return eventlog.state_events(_parsed_log(spark, d), _part_sites(spark, d), 1000, by_part=True).drop("ord")


@_query(
    "log_tier_counts",
    _V + " SELECT CASE WHEN u % 2 = 0 THEN 'default' ELSE 'instrumented' END AS variant, 'b' || (u % 5) AS bench, CAST(count(*) AS BIGINT) AS n FROM v WHERE (et = 'signup' AND k % 3 <> 0) OR (et = 'click' AND k % 2 = 1) GROUP BY ALL",
)
def log_tier_counts(spark, d):
    name = F.format_string("compiler_log_%s_ren_b%d_12.xml", F.when(F.col("u") % 2 == 0, "default").otherwise("instrumented"), F.col("u") % 5)
    folder = write_named(_log_lines(spark, d).withColumn("name", name), scratch_folder(spark, "logs"), "event_id")
    return eventlog.top_tier_counts(eventlog.read_log(spark, folder))


@_query(
    "state_lines",
    _V + " SELECT event_id, CASE WHEN et = 'signup' THEN 'Compilation at: ' || ms || ' [kind = ' || CASE WHEN k % 3 = 0 THEN 'null' ELSE 'c2' END || ', id = ' || k || ']' ELSE 'Decompilation at: ' || ms || '[compile_id = ' || k || ', compile_kind = c1]' || CASE WHEN k % 2 = 0 THEN '[trap: reason = r' || (k % 4) || ', action = null]' ELSE '' END END AS line FROM v WHERE et IN ('signup', 'error')",
)
def state_lines(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k")).where("event_type in ('signup', 'error')")
    ms, id_ = (F.col("event_id") * 37) % 100_000, F.col("k").cast("string")
    begin = reports.compilation_line(ms, F.when(F.col("k") % 3 != 0, "c2"), id_)
    end = reports.decompilation_line(ms, id_, F.lit("c1"), F.when(F.col("k") % 2 == 0, F.format_string("r%d", F.col("k") % 4)), F.lit(None).cast("string"))
    return e.select("event_id", F.when(F.col("event_type") == "signup", begin).otherwise(end).alias("line"))


# ------------------------------------------------------------------- archives
_MEMBERS = "SELECT 'pack_' || (event_id // 4000) || '.tar.gz' AS archive, 'logs/' || event_type || '_' || (user_id % 3) || '.txt' AS member, CAST(event_id AS BIGINT) AS event_id, event_id || ' é ' || coalesce(props, '') AS line FROM events"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(
        F.format_string("pack_%d.tar.gz", F.floor(F.col("event_id") / 4000)).alias("archive"),
        F.format_string("logs/%s_%d.txt", "event_type", F.col("user_id").cast("long") % 3).alias("member"),
        F.concat(F.col("event_id").cast("string"), F.lit(" é "), F.coalesce("props", F.lit(""))).alias("value"),
        "event_id",
    )
    return archives.read_archives(spark, archives.write_archives(rows, scratch_folder(spark, "packs"), "event_id"))


@_query("archive_lines", f"SELECT archive, member, CAST(row_number() OVER (PARTITION BY archive, member ORDER BY event_id) - 1 AS BIGINT) AS ord, line, CAST(NULL AS VARCHAR) AS error FROM ({_MEMBERS})")
def archive_lines(spark, d):
    """Compressed archives of 4000 events, a member for each kind and third of users, and their lines."""
    return _packed(spark, d).select("archive", "member", "ord", "line", "error")


@_query("archive_members", f"SELECT archive, member, CAST(count(*) AS BIGINT) AS lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM ({_MEMBERS}) GROUP BY ALL")
def archive_members(spark, d):
    return _packed(spark, d).groupBy("archive", "member").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))


# --------------------------------------------------------------------- traces
@_query("trace_folder", "SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2 + 1 AS compile_id, CAST(user_id AS BIGINT) AS callsite_id, CAST(length(event_type) AS BIGINT) AS class_id, CAST(event_id AS BIGINT) + 1 AS t_us FROM events")
def trace_folder(spark, d):
    """Padded binary files of 5000 records, and the folder's patterns."""
    e = table(spark, d, "events").select((F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 2 + 1).alias("compile_id"), F.col("user_id").cast("long").alias("callsite_id"), F.length("event_type").cast("long").alias("class_id"), (F.col("event_id").cast("long") + 1).alias("t_us"))

    def encode(rows):
        records = zip(*(rows.column(c).to_pylist() for c in ("compile_id", "callsite_id", "class_id", "t_us")), strict=True)
        return pa.table({"name": pa.array([f"partial_{rows.column('file')[0].as_py()}.txt"]), "value": pa.array([traces.encode_records(records, 5)], pa.binary())})

    packed = e.withColumn("file", F.floor(F.col("t_us") / 5000)).groupBy("file").applyInArrow(encode, "name string, value binary")
    folder = write_named(packed.withColumn("value", F.col("value").cast("string")), scratch_folder(spark, "traces"))
    return traces.read_traces(spark, traces.folder_paths(folder)["traces"])


@_query("trace_clock", "SELECT CAST(max(event_id) AS BIGINT) AS start_ms FROM events")
def trace_clock(spark, d):
    lines = table(spark, d, "events").agg(F.max("event_id").alias("m")).select(F.explode(F.array(F.lit("5"), F.col("m").cast("string"))).alias("value"))
    folder = write_named(lines.withColumn("name", F.lit("start_time.txt")).withColumn("at", F.length("value")), scratch_folder(spark, "clock"), "at")
    return spark.createDataFrame([(traces.read_start_ms(spark, traces.folder_paths(folder)["start"]),)], "start_ms long")


# ------------------------------------------------------------------- listings
def _cost_listing(spark: SparkSession, d: str, limit: int | None) -> DataFrame:
    p = table(spark, d, "part").select(F.format_string("listing_%d.txt", F.col("p_size") % 4).alias("name"), F.col("p_partkey").cast("long").alias("at"), F.format_string(" %d.5   %d  a.b.C%d.m(int, java.lang.String)", "p_partkey", F.col("p_size"), "p_partkey").alias("value"))
    names = p.select("name").distinct()
    head = names.select("name", F.explode(F.sequence(F.lit(-7).cast("long"), F.lit(-1).cast("long"))).alias("at"), F.lit("heading").alias("value"))
    foot = names.select("name", F.lit(1 << 60).alias("at"), F.lit("end").alias("value"))
    folder = write_named(p.unionByName(head).unionByName(foot), scratch_folder(spark, "costs"), "at")
    rows = listings.read_cost_listing(spark, f"{folder}/listing_*", limit)
    return rows.select("file", F.col("exclusive cpu sec").alias("seconds"), F.col("cpu cycles").alias("cycles"), "method_descriptor")


_COSTS = "SELECT 'listing_' || (p_size % 4) || '.txt' AS file, p_partkey + 0.5::DOUBLE AS seconds, CAST(p_size AS DOUBLE) AS cycles, 'a/b/C' || p_partkey || '.m(ILjava/lang/String;)' AS method_descriptor FROM part"


@_query("cost_listing", _COSTS)
def cost_listing(spark, d):
    return _cost_listing(spark, d, None)


@_query("cost_listing_first", f"{_COSTS} QUALIFY row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) <= 10")
def cost_listing_first(spark, d):
    return _cost_listing(spark, d, 10)


@_query("cost_table", "SELECT CAST(p_partkey AS DOUBLE) AS seconds, CAST(p_size AS DOUBLE) AS cycles, p_name AS method_descriptor FROM part")
def cost_table(spark, d):
    folder = scratch_folder(spark, "cost-table")
    files.write_csv(table(spark, d, "part").select(F.col("p_partkey").alias("exclusive cpu sec"), F.col("p_size").alias("cpu cycles"), F.col("p_name").alias("method_descriptor")), folder)
    return listings.read_costs(spark, folder).select(F.col("exclusive cpu sec").alias("seconds"), F.col("cpu cycles").alias("cycles"), "method_descriptor")


@_query(
    "elapsed_files",
    "SELECT 'ren_s' || (l_suppkey % 7) AS bench, CASE WHEN l_returnflag = 'A' THEN 'default' ELSE 'instrumented' END AS variant, CAST(row_number() OVER (PARTITION BY l_suppkey % 7, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS run_no, round(60 * (l_linenumber % 3) + l_quantity + 0.25, 2)::DOUBLE AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')",
)
def elapsed_files(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    name = F.format_string("%s_ren_s%d.txt", F.when(F.col("l_returnflag") == "A", "default").otherwise("instrumented"), F.col("l_suppkey") % 7)
    line = F.format_string("1.0user %d:%02d.25elapsed 99%%", F.col("l_linenumber") % 3, F.col("l_quantity").cast("int"))
    folder = write_series(rows.select(name.alias("name"), line.alias("value"), *_ORDER), scratch_folder(spark, "elapsed"), *_ORDER)
    return listings.read_elapsed(spark, folder).withColumn("value", F.round("value", 2))


@_query(
    "run_series",
    "SELECT 's' || b AS bench, variant, CAST(row_number() OVER (PARTITION BY b, variant ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS run_no, duration, uptime FROM (SELECT l_suppkey % 5 AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'normal' ELSE 'tweaked' END AS variant, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_partkey AS BIGINT) AS duration, CAST(l_orderkey AS BIGINT) AS uptime FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 5, l_linenumber % 2 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) <= 100)",
)
def run_series(spark, d):
    name = F.format_string("%s_s%d.csv", F.when(F.col("l_linenumber") % 2 == 0, "normal").otherwise("th"), F.col("l_suppkey") % 5)
    rows = table(spark, d, "lineitem").select(name.alias("name"), F.format_string("x,%d,%d", "l_partkey", "l_orderkey").alias("value"), *_ORDER)
    folder = write_series(rows, scratch_folder(spark, "series"), *_ORDER)
    return listings.read_run_series(spark, folder)


# ------------------------------------------------------- runs and numbered rows
@_query(
    "complete_pairs",
    "WITH r AS (SELECT l_partkey AS bench, l_returnflag AS f, l_quantity AS value, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS run_no FROM lineitem) "
    "SELECT CAST(x.bench AS BIGINT) AS bench, CAST(x.run_no AS INTEGER) AS run_no, CAST(x.value AS DOUBLE) AS a, CAST(y.value AS DOUBLE) AS b FROM r x JOIN r y ON y.bench = x.bench AND y.run_no = x.run_no AND x.f = 'N' AND y.f = 'R' WHERE x.bench IN (SELECT bench FROM r GROUP BY bench HAVING count(*) FILTER (f = 'N') = count(*) FILTER (f = 'R'))",
)
def complete_pairs(spark, d):
    """Parts as benchmarks: those whose two flags have different numbers of runs are left out whole."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_partkey", "l_returnflag").orderBy(*_ORDER))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("bench"), F.col("l_returnflag").alias("variant"), number.alias("run_no"), F.col("l_quantity").cast("double").alias("value"))
    return stats.pair_runs(rows, ["bench"], "variant", ("N", "R")).select("bench", "run_no", "a", "b")


@_query("site_numbers", "SELECT CAST(row_number() OVER (ORDER BY c_name, c_nationkey) - 1 AS BIGINT) AS id, c_name || ' ' || c_nationkey AS key FROM (SELECT DISTINCT c_name, c_nationkey FROM customer)")
def site_numbers(spark, d):
    rows = table(spark, d, "customer").select("c_name", "c_nationkey").distinct()
    return number_rows(rows, "id", "c_name", "c_nationkey").select("id", F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string")).alias("key"))
