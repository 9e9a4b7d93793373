"""Registered queries of the event-sequence operators, each with independent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import bits, descriptors, scopes, text
from eventloom.operators import attribution as at
from eventloom.operators import joins, placement, quantiles, stats
from eventloom.operators import windows as w
from eventloom.sources import eventlog, reports, traces
from eventloom.sinks import files
from eventloom.sinks.scratch import scratch_folder
from eventloom.plans import comparisons, digest, file_catalogue, incremental
from eventloom.streaming import windows as streams
from eventloom.plans.surrogate import DELTA, KEYS, dispatches, runs, states, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(file_catalogue.QUERIES)
ORACLES: dict[str, str] = dict(file_catalogue.ORACLES)

_K = "callsite_id, compile_id"
#: Shared parts of the SQL, in the order in which they build on one another.
_PARTS = {
    "e": "SELECT event_id, event_type, user_id AS callsite_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) AS t_us FROM events",
    "d": "SELECT callsite_id, k % 2 AS compile_id, event_type AS class, t_us, k FROM e",
    "a": f"SELECT {_K}, min(t_us) AS t0, max(t_us) AS t_end FROM d GROUP BY ALL",
    "c": f"SELECT {_K}, t0, (t_us - t0) // {DELTA} AS win, class, count(*) AS n FROM d JOIN a USING ({_K}) GROUP BY ALL",
    "r": f"SELECT *, sum(n) OVER (PARTITION BY {_K}, win) AS total, n / CAST(sum(n) OVER (PARTITION BY {_K}, win) AS DOUBLE) AS ratio FROM c",
    "nw": f"SELECT DISTINCT {_K}, t0, win FROM c",
    "p": f"SELECT * FROM (SELECT *, lag(win) OVER (PARTITION BY {_K} ORDER BY win) AS prev_win, t0 // {DELTA} + win - 1 AS label FROM nw) WHERE prev_win IS NOT NULL",
    "cl": f"SELECT DISTINCT {_K}, class FROM c",
    "z": f"SELECT p.*, cl.class, coalesce(x.ratio, 0) AS r1, coalesce(y.ratio, 0) AS r2 FROM p JOIN cl USING ({_K}) LEFT JOIN r x ON x.callsite_id = p.callsite_id AND x.compile_id = p.compile_id AND x.win = p.prev_win AND x.class = cl.class LEFT JOIN r y ON y.callsite_id = p.callsite_id AND y.compile_id = p.compile_id AND y.win = p.win AND y.class = cl.class",
    "ch": f"SELECT {_K}, t0, prev_win, win, label FROM z GROUP BY ALL HAVING max(abs(r1 - r2)) > CAST(0.1 AS DOUBLE)",
    "rk": f"SELECT {_K}, win, list(class ORDER BY ratio DESC, class) AS names FROM r GROUP BY ALL",
    "iv": f"SELECT p.*, x.names AS prev_rank, y.names AS rank FROM p JOIN rk x ON x.callsite_id = p.callsite_id AND x.compile_id = p.compile_id AND x.win = p.prev_win JOIN rk y ON y.callsite_id = p.callsite_id AND y.compile_id = p.compile_id AND y.win = p.win WHERE x.names[1:least(len(x.names), len(y.names))] <> y.names[1:least(len(x.names), len(y.names))]",
    "st": "SELECT callsite_id, CASE WHEN event_type = 'signup' THEN 'C' ELSE 'D' END AS tag, CAST(k % 5 AS VARCHAR) AS id, CASE WHEN k % 3 = 0 THEN 'c1' ELSE 'c2' END AS kind, t_us // 1000 * 1000 AS time_us, event_id FROM e WHERE event_type IN ('signup', 'error')",
    "sp": f"SELECT {_K}, min(t0) AS t0, max(win) + 1 AS n_windows FROM c GROUP BY ALL",
    "sf": f"SELECT st.*, compile_id, t0, n_windows, row_number() OVER (PARTITION BY {_K}, tag ORDER BY time_us, event_id) - 1 AS j, CASE WHEN time_us // 1000 - t0 // 1000 + 1 <= 0 THEN 0 ELSE ((time_us // 1000 - t0 // 1000 + 1) * 1000 + {DELTA} - 1) // {DELTA} END AS f FROM st JOIN sp USING (callsite_id)",
    "pl": f"SELECT *, j + max(f - j) OVER (PARTITION BY {_K}, tag ORDER BY time_us, event_id ROWS UNBOUNDED PRECEDING) AS step FROM sf",
    "tc": f"SELECT {_K}, win - 1 AS step, 'W' AS tag, 2 AS kind_ord, NULL AS id, NULL AS kind FROM ch UNION ALL SELECT {_K}, step, tag, CASE tag WHEN 'C' THEN 0 ELSE 1 END, id, kind FROM pl WHERE step <= n_windows - 2",
    "ti": f"SELECT {_K}, win - 1 AS step, 'W' AS tag, 2 AS kind_ord, NULL AS id, NULL AS kind, prev_win, win, prev_rank, rank FROM iv UNION ALL SELECT {_K}, step, tag, CASE tag WHEN 'C' THEN 0 ELSE 1 END, id, kind, NULL, NULL, NULL, NULL FROM pl WHERE step <= n_windows - 2",
    "tr": f"SELECT {_K}, win AS step, 'W' AS tag, 2 AS kind_ord, NULL AS id, NULL AS kind FROM nw UNION ALL SELECT {_K}, step, tag, CASE tag WHEN 'C' THEN 0 ELSE 1 END, id, kind FROM pl WHERE step <= n_windows - 1",
}


def _attributed(name: str, begins: str = "tag = 'C'") -> str:
    """SQL of a timeline with the state in force at each row."""
    part, upto = f"PARTITION BY {_K}", "ROWS UNBOUNDED PRECEDING"
    return (
        f"SELECT *, CASE WHEN own IS NULL OR max(CASE WHEN tag = 'D' AND id = own THEN 1 ELSE 0 END) OVER ({part}, epoch ORDER BY step, kind_ord {upto}) = 1 THEN 'interpreter' ELSE own END AS state "
        f"FROM (SELECT *, max(CASE WHEN {begins} THEN id END) OVER ({part}, epoch) AS own "
        f"FROM (SELECT *, sum(CASE WHEN {begins} THEN 1 ELSE 0 END) OVER ({part} ORDER BY step, kind_ord {upto}) AS epoch FROM {name}))"
    )


_PARTS |= {"ac": _attributed("tc"), "ai": _attributed("ti"), "ai2": _attributed("ti", "tag = 'C' AND kind = 'c2'"), "ar": _attributed("tr")}
_PARTS |= {
    "bd": f"SELECT x.callsite_id, x.compile_id, x.id, count(*) AS n FROM (SELECT {_K}, id, max(step * 3 + kind_ord) AS e FROM ai2 WHERE tag = 'D' GROUP BY ALL) x JOIN ai2 y ON y.callsite_id = x.callsite_id AND y.compile_id = x.compile_id AND y.tag = 'W' AND y.state = x.id AND y.step * 3 + y.kind_ord < x.e GROUP BY ALL",
    "sg": f"SELECT {_K}, state, step, array_to_string(prev_rank, ' - ') AS first_sig, array_to_string(rank, ' - ') AS second_sig, row_number() OVER (PARTITION BY {_K} ORDER BY min_step, step) AS place FROM (SELECT *, min(step) OVER (PARTITION BY {_K}, state) AS min_step FROM ai WHERE tag = 'W' AND state <> 'interpreter')",
}


def _sql(select: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _PARTS.items()) + " " + select


def _query(name: str, sql: str | None = None, parts: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _sql(sql) if parts else sql
        return f

    return add


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return w.window_counts(dispatches(spark, d), KEYS, "class", DELTA)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = w.window_pairs(w.share_vectors(_counts(spark, d), KEYS, "class"), KEYS)
    return pairs.withColumn("label", w.label(F.col("t0"), F.col("step"), DELTA))


# ------------------------------------------------------------------ windows
@_query("dispatch_counts", f"SELECT {_K}, t0, win, class, CAST(n AS BIGINT) AS n FROM c")
def dispatch_counts(spark, d):
    return _counts(spark, d).select(*KEYS, "t0", "win", "class", "n")


@_query("group_spans", f"SELECT {_K}, t0, t_end FROM a")
def group_spans(spark, d):
    return w.anchors(dispatches(spark, d), KEYS)


@_query("receiver_ratio", f"SELECT {_K}, win, class, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(ratio, 6) AS ratio FROM r")
def receiver_ratio(spark, d):
    return w.window_shares(_counts(spark, d), KEYS, "class").select(*KEYS, "win", "class", "n", "total", F.round("ratio", 6).alias("ratio"))


@_query(
    "dense_windows",
    f"SELECT g.callsite_id, g.compile_id, g.win, cl.class, CAST(coalesce(r.n, 0) AS BIGINT) AS n, round(coalesce(r.ratio, 0), 6) AS ratio FROM (SELECT {_K}, unnest(generate_series(0, max(win))) AS win FROM c GROUP BY {_K}) g JOIN cl USING ({_K}) LEFT JOIN r ON r.callsite_id = g.callsite_id AND r.compile_id = g.compile_id AND r.win = g.win AND r.class = cl.class",
)
def dense_windows(spark, d):
    return w.dense_shares(_counts(spark, d), KEYS, "class").select(*KEYS, "win", "class", "n", F.round("ratio", 6).alias("ratio"))


@_query("nonempty_lag", f"SELECT {_K}, prev_win, win, label FROM p")
def nonempty_lag(spark, d):
    return _pairs(spark, d).select(*KEYS, "prev_win", "win", "label")


@_query("ratio_changes", f"SELECT {_K}, prev_win, win, label FROM ch")
def ratio_changes(spark, d):
    return w.share_changes(_pairs(spark, d)).select(*KEYS, "prev_win", "win", "label")


@_query("rank_inversions", f"SELECT {_K}, prev_win, win, label, array_to_string(prev_rank, ',') AS prev_rank, array_to_string(rank, ',') AS rank FROM iv")
def rank_inversions(spark, d):
    return w.rank_inversions(_pairs(spark, d)).select(*KEYS, "prev_win", "win", "label", F.array_join("prev_rank", ",").alias("prev_rank"), F.array_join("rank", ",").alias("rank"))


@_query("raw_windows", f"SELECT {_K}, win, CAST(any_value(total) AS BIGINT) AS total, string_agg(class || ': ' || printf('%.6f', ratio), ', ' ORDER BY class) AS shares FROM r GROUP BY {_K}, win")
def raw_windows(spark, d):
    vectors = w.share_vectors(_counts(spark, d), KEYS, "class")
    return vectors.select(*KEYS, "win", "total", w.shares_text(F.col("shares")).alias("shares"))


@_query("class_semi", f"SELECT {_K}, (t_us - t0) // {DELTA} AS win, class, CAST(count(*) AS BIGINT) AS n FROM d JOIN a USING ({_K}) WHERE class IN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view') GROUP BY ALL")
def class_semi(spark, d):
    events = dispatches(spark, d)
    known = events.select("class").where("class <> 'view'").distinct()
    return w.window_counts(events, KEYS, "class", DELTA, known=known).select(*KEYS, "win", "class", "n")


@_query("callsite_dict_join", "SELECT d.callsite_id, c_name AS site, class, CAST(count(*) AS BIGINT) AS n FROM d LEFT JOIN customer ON c_custkey = d.callsite_id + 1 GROUP BY ALL")
def callsite_dict_join(spark, d):
    names = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("callsite_id"), F.col("c_name").alias("site"))
    counts = dispatches(spark, d).groupBy("callsite_id", "class").agg(F.count("*").alias("n"))
    return joins.decode(counts, names, "callsite_id").select("callsite_id", "site", "class", "n")


# ---------------------------------------------------------------- state events
def _placed(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return placement.place(states(spark, d), placement.spans(_counts(spark, d), KEYS), KEYS, DELTA, on=["callsite_id"], order=("event_id",), whole=whole)


@_query("jit_event_placement", f"SELECT {_K}, tag, id, time_us, event_id, CAST(step AS BIGINT) AS step FROM pl WHERE step <= n_windows - 2")
def jit_event_placement(spark, d):
    return _placed(spark, d).select(*KEYS, "tag", "id", "time_us", "event_id", F.col("step").cast("long").alias("step"))


def _timeline(spark: SparkSession, d: str, section: str) -> DataFrame:
    if section == "raw":
        rows = w.share_vectors(_counts(spark, d), KEYS, "class").withColumn("step", F.col("win"))
        rows = rows.withColumn("names", w.ranking(F.col("shares")))
        return placement.timeline(rows, _placed(spark, d, True), KEYS, ["names"])
    pairs = _pairs(spark, d)
    rows = w.share_changes(pairs) if section == "changes" else w.rank_inversions(pairs)
    return placement.timeline(rows, _placed(spark, d), KEYS, ["prev_win", "win", *(["prev_rank", "rank"] if section == "inversions" else [])])


@_query("merged_timeline", f"SELECT {_K}, CAST(step AS BIGINT) AS step, tag, CAST(kind_ord AS INTEGER) AS kind_ord, id, kind FROM ti")
def merged_timeline(spark, d):
    return _timeline(spark, d, "inversions").select(*KEYS, F.col("step").cast("long").alias("step"), "tag", "kind_ord", "id", "kind")


@_query("raw_timeline", f"SELECT {_K}, CAST(step AS BIGINT) AS step, tag, CAST(kind_ord AS INTEGER) AS kind_ord, id, kind FROM tr")
def raw_timeline(spark, d):
    return _timeline(spark, d, "raw").select(*KEYS, F.col("step").cast("long").alias("step"), "tag", "kind_ord", "id", "kind")


@_query("compile_state", f"SELECT {_K}, CAST(step AS BIGINT) AS step, tag, id, state FROM ai")
def compile_state(spark, d):
    return at.attribute_state(_timeline(spark, d, "inversions"), KEYS).select(*KEYS, F.col("step").cast("long").alias("step"), "tag", "id", "state")


def _hot(select: str) -> str:
    """SQL where one group has nine tenths of the events."""
    return _sql(select).replace("user_id AS callsite_id", "CASE WHEN user_id % 10 = 0 THEN user_id ELSE 0 END AS callsite_id", 1).replace("k % 2 AS compile_id", "0 AS compile_id", 1)


def _hot_timeline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Placed state changes, and the timeline of all windows with them, where one group has nine tenths of the events."""
    site = F.when(F.col("callsite_id") % 10 == 0, F.col("callsite_id")).otherwise(0)
    events = dispatches(spark, d).withColumns({"callsite_id": site, "compile_id": F.lit(0)})
    counts = w.window_counts(events, KEYS, "class", DELTA)
    marks = states(spark, d).withColumn("callsite_id", site)
    placed = placement.place(marks, placement.spans(counts, KEYS), KEYS, DELTA, on=["callsite_id"], order=("event_id",), whole=True, spread=True)
    return placed, placement.timeline(w.share_vectors(counts, KEYS, "class").withColumn("step", F.col("win")), placed, KEYS, [])


@_query("hot_group_placement", parts=False, sql=_hot(f"SELECT {_K}, tag, id, time_us, event_id, CAST(step AS BIGINT) AS step FROM pl WHERE step <= n_windows - 1"))
def hot_group_placement(spark, d):
    return _hot_timeline(spark, d)[0].select(*KEYS, "tag", "id", "time_us", "event_id", F.col("step").cast("long").alias("step"))


@_query("hot_group_state", parts=False, sql=_hot(f"SELECT {_K}, CAST(step AS BIGINT) AS step, tag, id, state FROM ar"))
def hot_group_state(spark, d):
    return at.attribute_state(_hot_timeline(spark, d)[1], KEYS, spread=True).select(*KEYS, F.col("step").cast("long").alias("step"), "tag", "id", "state")


def _line_sql(name: str) -> str:
    return f"SELECT {_K}, CAST(sum(CASE WHEN tag = 'W' THEN 3 ELSE 1 END) AS BIGINT) AS lines, CAST(sum(CASE WHEN tag = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS pairs, CAST(sum(CASE WHEN tag = 'C' THEN 1 ELSE 0 END) AS BIGINT) AS compilations, CAST(sum(CASE WHEN tag = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS decompilations FROM {name} GROUP BY ALL"


@_query("section_line_counts", f"SELECT 'changes' AS section, * FROM ({_line_sql('tc')}) UNION ALL SELECT 'inversions' AS section, * FROM ({_line_sql('ti')})")
def section_line_counts(spark, d):
    parts = [at.line_counts(_timeline(spark, d, s), KEYS).select(F.lit(s).alias("section"), *KEYS, "lines", "pairs", "compilations", "decompilations") for s in ("changes", "inversions")]
    return parts[0].unionByName(parts[1])


def _after_sql(name: str) -> str:
    return f"SELECT {_K}, CAST(sum(CASE WHEN tag = 'W' AND state <> 'interpreter' THEN 1 ELSE 0 END) AS BIGINT) AS after_compilation FROM {name} GROUP BY ALL"


@_query("post_compile_counts", f"SELECT 'changes' AS section, * FROM ({_after_sql('ac')}) UNION ALL SELECT 'inversions' AS section, * FROM ({_after_sql('ai')})")
def post_compile_counts(spark, d):
    parts = [at.counts_in_state(at.attribute_state(_timeline(spark, d, s), KEYS), KEYS).select(F.lit(s).alias("section"), *KEYS, "after_compilation") for s in ("changes", "inversions")]
    return parts[0].unionByName(parts[1])


@_query("reported_groups", f"SELECT DISTINCT {_K} FROM (SELECT {_K} FROM tc UNION ALL SELECT {_K} FROM ti)")
def reported_groups(spark, d):
    return _timeline(spark, d, "changes").select(*KEYS).unionByName(_timeline(spark, d, "inversions").select(*KEYS)).distinct()


@_query("inversions_before_deopt", f"SELECT {_K}, id, CAST(n AS BIGINT) AS n FROM bd")
def inversions_before_deopt(spark, d):
    return at.observations_before_end(_timeline(spark, d, "inversions"), KEYS).select(*KEYS, "id", "n")


@_query("suboptimal_time", f"SELECT {_K}, CAST(sum(n) * {DELTA} AS BIGINT) AS suboptimal_us FROM bd JOIN (SELECT DISTINCT {_K}, id FROM (SELECT {_K}, id FROM tc WHERE tag = 'D' UNION ALL SELECT {_K}, id FROM ti WHERE tag = 'D')) USING ({_K}, id) GROUP BY ALL")
def suboptimal_time(spark, d):
    inversions = _timeline(spark, d, "inversions")
    ended = _timeline(spark, d, "changes").where("tag = 'D'").select(*KEYS, "id").unionByName(inversions.where("tag = 'D'").select(*KEYS, "id"))
    return at.time_in_wrong_state(at.observations_before_end(inversions, KEYS), ended, KEYS, DELTA)


@_query("average_before_deopt", f"SELECT {_K}, round(avg(n), 6) AS mean_before_end FROM bd GROUP BY ALL")
def average_before_deopt(spark, d):
    before = at.observations_before_end(_timeline(spark, d, "inversions"), KEYS)
    return at.mean_before_end(before, KEYS).withColumn("mean_before_end", F.round("mean_before_end", 6))


_REDUCTION = f"""
, x AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY {_K} ORDER BY step, kind_ord), 'interpreter') AS was FROM ar)
, y AS (SELECT *, sum(CASE WHEN tag = 'C' OR own_end THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY step, kind_ord ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, tag = 'D' AND state = 'interpreter' AND was = id AS own_end FROM x))
, sg0 AS (SELECT {_K}, 0 AS seg FROM tr GROUP BY ALL)
, segs AS (SELECT {_K}, seg, arg_min(CASE WHEN tag = 'C' THEN id ELSE state END, step * 3 + kind_ord) AS id, max(CASE WHEN own_end THEN 1 ELSE 0 END) AS after_end FROM y GROUP BY ALL)
, seen AS (SELECT y.callsite_id, y.compile_id, seg, count(DISTINCT class) AS n FROM y JOIN c ON c.callsite_id = y.callsite_id AND c.compile_id = y.compile_id AND c.win = y.step WHERE y.tag = 'W' GROUP BY ALL)
, parts AS (SELECT s.callsite_id, s.compile_id, s.seg, coalesce(g.id, 'interpreter') AS id, coalesce(g.after_end, 0) AS after_end, coalesce(n, 0) AS n FROM (SELECT * FROM sg0 UNION SELECT {_K}, seg FROM segs) s LEFT JOIN segs g ON g.callsite_id = s.callsite_id AND g.compile_id = s.compile_id AND g.seg = s.seg LEFT JOIN seen ON seen.callsite_id = s.callsite_id AND seen.compile_id = s.compile_id AND seen.seg = s.seg)
, q AS (SELECT *, CASE WHEN after_end = 1 THEN 0 ELSE coalesce(lag(n) OVER (PARTITION BY {_K} ORDER BY seg), 0) END AS n_before, coalesce(lead(after_end) OVER (PARTITION BY {_K} ORDER BY seg) = 0, false) AS closed FROM parts)
, rd AS (SELECT {_K}, id, CAST(n_before AS BIGINT) AS n_before, CAST(n AS BIGINT) AS n_after FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, id ORDER BY closed DESC, CASE WHEN closed THEN -seg ELSE seg END) AS rn FROM q) WHERE rn = 1)
"""


@_query("receiver_reduction", _REDUCTION + "SELECT * FROM rd")
def receiver_reduction(spark, d):
    return at.category_reduction(_timeline(spark, d, "raw"), KEYS)


# ------------------------------------------------------------------ inversions
def _signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = at.attribution_order(at.attribute_state(_timeline(spark, d, "inversions"), KEYS), KEYS)
    return rows.select(*KEYS, "state", "step", "place", F.array_join("prev_rank", " - ").alias("first_sig"), F.array_join("rank", " - ").alias("second_sig"))


@_query(
    "top2_cleanup",
    f"SELECT {_K}, prev_win, win, array_to_string(list_sort(list_distinct(x[1:2])), ',') AS kept FROM (SELECT *, list_transform(list_filter([[prev_rank[1], '0'], [rank[1], '1'], [prev_rank[2], '2'], [rank[2], '3']], lambda y: y[1] IS NOT NULL), lambda y: y[1]) AS l FROM iv) t, LATERAL (SELECT list_filter(l, lambda v, i: list_position(l, v) = i) AS x)",
)
def top2_cleanup(spark, d):
    rows = w.rank_inversions(_pairs(spark, d))
    kept = at.leading_two(F.col("prev_shares"), F.col("shares"))
    return rows.select(*KEYS, "prev_win", "win", F.array_join(F.array_sort(kept), ",").alias("kept"))


@_query("inversion_signature", f"SELECT {_K}, win, array_to_string(prev_rank, ' - ') AS first_sig, array_to_string(rank, ' - ') AS second_sig FROM iv")
def inversion_signature(spark, d):
    rows = w.rank_inversions(_pairs(spark, d))
    return rows.select(*KEYS, "win", at.signature(F.col("prev_shares")).alias("first_sig"), at.signature(F.col("shares")).alias("second_sig"))


@_query("inversion_freq", f"SELECT {_K}, first_sig, second_sig, CAST(count(*) AS BIGINT) AS n FROM sg GROUP BY ALL")
def inversion_freq(spark, d):
    return at.frequencies(_signatures(spark, d), KEYS, ["first_sig", "second_sig"]).drop("first_place")


_NEXT = f"SELECT *, lead(first_sig) OVER (PARTITION BY {_K} ORDER BY place) AS next_first_sig, lead(second_sig) OVER (PARTITION BY {_K} ORDER BY place) AS next_second_sig FROM sg"


@_query("oscillation_bigrams", f"SELECT {_K}, first_sig, second_sig, next_first_sig, next_second_sig, CAST(count(*) AS BIGINT) AS n FROM ({_NEXT}) WHERE next_first_sig IS NOT NULL GROUP BY ALL")
def oscillation_bigrams(spark, d):
    steps = at.transitions(_signatures(spark, d), KEYS, ["first_sig", "second_sig"])
    return at.frequencies(steps, KEYS, ["first_sig", "second_sig", "next_first_sig", "next_second_sig"]).drop("first_place")


@_query("most_frequent_inversion", f"SELECT {_K}, first_sig, second_sig, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, fp) AS rn FROM (SELECT {_K}, first_sig, second_sig, count(*) AS n, min(place) AS fp FROM sg GROUP BY ALL)) WHERE rn = 1")
def most_frequent_inversion(spark, d):
    return at.most_frequent(at.frequencies(_signatures(spark, d), KEYS, ["first_sig", "second_sig"]), KEYS).drop("first_place")


@_query("most_frequent_oscillation", f"SELECT {_K}, first_sig, second_sig, next_first_sig, next_second_sig, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, fp) AS rn FROM (SELECT {_K}, first_sig, second_sig, next_first_sig, next_second_sig, count(*) AS n, min(place) AS fp FROM ({_NEXT}) WHERE next_first_sig IS NOT NULL GROUP BY ALL)) WHERE rn = 1")
def most_frequent_oscillation(spark, d):
    steps = at.transitions(_signatures(spark, d), KEYS, ["first_sig", "second_sig"])
    return at.most_frequent(at.frequencies(steps, KEYS, ["first_sig", "second_sig", "next_first_sig", "next_second_sig"]), KEYS).drop("first_place")


# --------------------------------------------------------------------- joins
@_query("compile_union_anti", "SELECT source, callsite_id, id, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'first' AS source, callsite_id, id FROM st WHERE tag = 'C' AND kind = 'c2' UNION ALL SELECT 'second', callsite_id, id FROM st s WHERE tag = 'D' AND NOT EXISTS (SELECT 1 FROM st t WHERE t.tag = 'C' AND t.kind = 'c2' AND t.id = s.id AND s.callsite_id = t.callsite_id)) GROUP BY ALL")
def compile_union_anti(spark, d):
    rows = states(spark, d).withColumn("key", F.concat_ws("/", F.col("callsite_id").cast("string"), "id"))
    first = rows.where("tag = 'C' and kind = 'c2'").select(F.lit("first").alias("source"), "callsite_id", "id", "key")
    second = rows.where("tag = 'D'").select(F.lit("second").alias("source"), "callsite_id", "id", "key")
    return joins.prefer(first, second, "key").groupBy("source", "callsite_id", "id").agg(F.count("*").alias("n"))


@_query("trap_zip", "SELECT a.callsite_id, a.event_id, b.id AS reason FROM (SELECT *, row_number() OVER (PARTITION BY callsite_id ORDER BY event_id) AS i FROM st WHERE tag = 'C') a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY callsite_id ORDER BY event_id) AS i FROM st WHERE tag = 'D') b ON a.callsite_id = b.callsite_id AND a.i = b.i")
def trap_zip(spark, d):
    rows = states(spark, d)
    traps = rows.where("tag = 'D'").select("callsite_id", F.col("id").alias("reason"), F.col("event_id").alias("trap_ord"))
    return joins.pair_up(rows.where("tag = 'C'").select("callsite_id", "event_id"), traps, "callsite_id", "event_id", "trap_ord").select("callsite_id", "event_id", "reason")


@_query("deopt_join", "SELECT x.callsite_id, x.id, x.event_id AS compiled, y.event_id AS ended FROM st x JOIN st y ON y.callsite_id = x.callsite_id AND y.id = x.id AND y.tag = 'D' WHERE x.tag = 'C'")
def deopt_join(spark, d):
    rows = states(spark, d)
    ends = rows.where("tag = 'D'").select("callsite_id", "id", F.col("event_id").alias("ended"))
    return rows.where("tag = 'C'").select("callsite_id", "id", F.col("event_id").alias("compiled")).join(ends, ["callsite_id", "id"])


_HOT = "SELECT c_custkey AS callsite_id, c_mktsegment AS method_descriptor, c_acctbal AS cycles FROM customer"


@_query(
    "hotness_rollup",
    f"SELECT method_descriptor, CAST(sum(n) AS BIGINT) AS inversions, round(max(cycles), 6) AS cycles, round(CASE WHEN max(cycles) = 0 THEN 0 ELSE sum(n) / max(cycles) END, 9) AS normalized FROM (SELECT c_mktsegment AS method_descriptor, count(*) AS n FROM iv JOIN customer ON c_custkey = iv.callsite_id GROUP BY ALL) LEFT JOIN (SELECT method_descriptor, arg_min(cycles, callsite_id) AS cycles FROM ({_HOT}) GROUP BY ALL) USING (method_descriptor) GROUP BY method_descriptor",
)
def hotness_rollup(spark, d):
    hot = table(spark, d, "customer").select(F.col("c_custkey").alias("callsite_id"), F.col("c_mktsegment").alias("method_descriptor"), F.col("c_acctbal").alias("cycles"))
    counts = w.rank_inversions(_pairs(spark, d)).groupBy("callsite_id").agg(F.count("*").alias("inversions")).join(hot.select("callsite_id", "method_descriptor"), "callsite_id")
    costs = hot.select("method_descriptor", "cycles", F.col("callsite_id").alias("ord"))
    joined = joins.with_costs(counts, costs, "method_descriptor", order="ord")
    out = joins.roll_up(joined, "method_descriptor", ["inversions"], ["cycles"], "callsite_id")
    return out.select("method_descriptor", "inversions", F.round("cycles", 6).alias("cycles"), F.round(text.safe_ratio(F.col("inversions"), F.col("cycles")), 9).alias("normalized"))


# ------------------------------------------------------------------ functions
_SITE = "CAST(user_id AS VARCHAR) || ' pkg/' || event_type || '/Cls.run([BII)V call/' || event_type || '.x()V'"


@_query("descriptor_convert", f"SELECT event_id, 'pkg.' || event_type || '.Cls run ([BII)V' AS descriptor, 'pkg/' || event_type || '/Cls.run([BII)' AS name, ({_SITE}) || ' - ' || CAST(event_id % 2 AS VARCHAR) AS site_key, lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS bucket FROM events", parts=False)
def descriptor_convert(spark, d):
    rows = table(spark, d, "events").withColumn("site", F.expr("concat(cast(user_id as string), ' pkg/', event_type, '/Cls.run([BII)V call/', event_type, '.x()V')"))
    return rows.select("event_id", descriptors.method_descriptor(F.col("site")).alias("descriptor"), descriptors.method_name(F.col("site")).alias("name"), text.site_key(F.col("site"), F.col("event_id") % 2).alias("site_key"), text.bucket(F.col("user_id")).alias("bucket"))


@_query(
    "hot_descriptor",
    "SELECT event_id, CASE event_type WHEN 'view' THEN '<Total>' WHEN 'click' THEN 'a/b/C.m([BI[[Ljava/lang/String;)' WHEN 'error' THEN 'a/b/C.none()' WHEN 'signup' THEN 'libc::free(int)' ELSE 'C.m(J)' END AS descriptor FROM events",
    parts=False,
)
def hot_descriptor(spark, d):
    name = F.expr("case event_type when 'view' then '<Total>' when 'click' then 'a.b.C.m(byte[], int, java.lang.String[][])' when 'error' then 'a.b.C.0x00ff.none()' when 'signup' then 'libc::free(int)' else 'C.m(long)' end")
    return table(spark, d, "events").select("event_id", descriptors.hot_descriptor(descriptors.strip_hidden(name)).alias("descriptor"))


@_query("elapsed_parse", "SELECT event_id, round(60 * (user_id % 70) + user_id % 60 + (event_id % 100) / 100.0, 6) AS seconds FROM events", parts=False)
def elapsed_parse(spark, d):
    line = F.expr("concat('0.5user ', if(user_id % 70 >= 60, concat(cast((user_id % 70) div 60 as string), ':', lpad(cast((user_id % 70) % 60 as string), 2, '0')), cast(user_id % 70 as string)), ':', lpad(cast(user_id % 60 as string), 2, '0'), '.', lpad(cast(event_id % 100 as string), 2, '0'), 'elapsed 99%CPU')")
    return table(spark, d, "events").select("event_id", F.round(text.elapsed_seconds(line), 6).alias("seconds"))


@_query("jit_attr_parse", "SELECT event_id, CAST(user_id AS VARCHAR) AS compile_id, CASE WHEN event_id % 2 = 0 THEN 'c2' END AS compiler, event_id % 100000 AS stamp_ms, ((event_id % 100000) - 7) * 1000 AS time_us, 'a<b>' AS method FROM events", parts=False)
def jit_attr_parse(spark, d):
    line = F.expr("concat('<nmethod compile_id=''', cast(user_id as string), '''', if(event_id % 2 = 0, ' compiler=''c2''', ''), ' method=''a&lt;b&gt;'' stamp=''', cast((event_id % 100000) div 1000 as string), '.', lpad(cast(event_id % 1000 as string), 3, '0'), '''/>')")
    rows = table(spark, d, "events").select("event_id", text.unescape(line).alias("line"))
    ms = text.stamp_ms(text.attribute(F.col("line"), "stamp"))
    return rows.select("event_id", text.attribute(F.col("line"), "compile_id").alias("compile_id"), text.attribute(F.col("line"), "compiler").alias("compiler"), ms.alias("stamp_ms"), text.align_us(ms, F.lit(7)).alias("time_us"), text.attribute(F.col("line"), "method").alias("method"))


@_query("bit_pack", "SELECT event_id, user_id AS high, event_id * 7 % 4294967296 AS low FROM events", parts=False)
def bit_pack(spark, d):
    packed = bits.pack(F.col("user_id"), F.col("event_id") * 7)
    return table(spark, d, "events").select("event_id", bits.high(packed).alias("high"), bits.low(packed).alias("low"))


@_query("share_list_parse", f"SELECT {_K}, win, class AS name, round(ratio, 6) AS share FROM r")
def share_list_parse(spark, d):
    vectors = w.share_vectors(_counts(spark, d), KEYS, "class")
    rows = vectors.select(*KEYS, "win", F.explode(text.shares(w.shares_text(F.col("shares")))).alias("s"))
    return rows.select(*KEYS, "win", F.col("s.name").alias("name"), F.round("s.share", 6).alias("share"))


# -------------------------------------------------------------- ranks and boxes
@_query("top30_metric", f"SELECT {_K}, CAST(count(*) AS BIGINT) AS inversions FROM iv GROUP BY ALL ORDER BY inversions DESC, callsite_id, compile_id LIMIT 30")
def top30_metric(spark, d):
    counts = w.rank_inversions(_pairs(spark, d)).groupBy(*KEYS).agg(F.count("*").alias("inversions"))
    return stats.top(counts, "inversions", 30, tuple(KEYS))


_METRICS = f"SELECT callsite_id, count(*) AS inversions, sum(CASE WHEN len(rank) > 2 THEN 1 ELSE 0 END) AS wide FROM iv GROUP BY callsite_id"


@_query("chart_points", f"SELECT metric, callsite_id, value FROM (SELECT callsite_id, 'inversions' AS metric, inversions::DOUBLE AS value FROM ({_METRICS}) UNION ALL SELECT callsite_id, 'wide', wide::DOUBLE FROM ({_METRICS})) WHERE value > 0")
def chart_points(spark, d):
    counts = w.rank_inversions(_pairs(spark, d)).groupBy("callsite_id").agg(F.count("*").alias("inversions"), F.count_if(F.size("rank") > 2).alias("wide"))
    return files.points(counts, ["inversions", "wide"], "callsite_id")


_BOX = "SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events WHERE value > 0 GROUP BY ALL"


@_query(
    "box_stats",
    f"SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_low, round(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_high, CAST(sum(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM events JOIN ({_BOX}) USING (event_type) WHERE value > 0 GROUP BY event_type, q1, median, q3",
    parts=False,
)
def box_stats(spark, d):
    out = stats.box(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


_WHISKERS = f"JOIN ({_BOX}) USING (event_type) WHERE value > 0 AND NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@_query("box_outliers", f"SELECT event_type, CAST(event_id AS BIGINT) AS event_id, value, round(median, 6) AS median FROM events {_WHISKERS}", parts=False)
def box_outliers(spark, d):
    out = stats.outliers(table(spark, d, "events").select("event_type", F.col("event_id").cast("long").alias("event_id"), "value"), ["event_type"], "value")
    return out.select("event_type", "event_id", "value", F.round("median", 6).alias("median"))


@_query(
    "price_quantiles",
    "SELECT CAST(s AS INTEGER) AS s, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.01), 4) AS p1, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.999), 4) AS p999 FROM (SELECT CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey END AS s, l_extendedprice FROM lineitem) GROUP BY s",
    parts=False,
)
def price_quantiles(spark, d):
    """One group holds nine tenths of all lines, others few; its ranges are narrowed by passes."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 10 == 0, F.col("l_suppkey")).cast("int").alias("s"), F.col("l_extendedprice").cast("double").alias("price"))
    out = quantiles.quantiles(rows, ["s"], "price", {"p1": 0.01, "p50": 0.5, "p999": 0.999}, few=1000)
    return out.select("s", "n", *[F.round(c, 4).alias(c) for c in ("p1", "p50", "p999")])


@_query("tail_100", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 100", parts=False)
def tail_100(spark, d):
    return stats.tail(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 100)


# ----------------------------------------------------------------- paired runs
_RUNS = (
    "WITH l AS (SELECT l_suppkey AS bench, CASE WHEN l_returnflag = 'A' THEN 'default' ELSE 'instrumented' END AS variant, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS run_no, l_quantity AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')), "
    "pr AS (SELECT x.bench, x.run_no, x.value AS a, y.value AS b FROM l x JOIN l y ON x.bench = y.bench AND x.run_no = y.run_no AND x.variant = 'default' AND y.variant = 'instrumented') "
)


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return stats.pair_runs(runs(spark, d), ["bench"], "variant", ("default", "instrumented"))


@_query("paired_runs", _RUNS + "SELECT bench, CAST(run_no AS INTEGER) AS run_no, a, b FROM pr", parts=False)
def paired_runs(spark, d):
    return _paired(spark, d).select("bench", "run_no", "a", "b")


@_query("paired_without", _RUNS + "SELECT bench, CAST(run_no AS INTEGER) AS run_no, a, b FROM pr WHERE bench NOT IN (2, 3)", parts=False)
def paired_without(spark, d):
    """Benchmarks left out of one side: they have no pairs."""
    kept = stats.without(runs(spark, d), [2, 3], variant="variant", side="default")
    return stats.pair_runs(kept, ["bench"], "variant", ("default", "instrumented")).select("bench", "run_no", "a", "b")


@_query("paired_summary", _RUNS + "SELECT bench, CAST(count(*) AS BIGINT) AS n, round(avg(a), 6) AS a_mean, round(stddev_pop(a), 6) AS a_std, round(avg(b), 6) AS b_mean, round(stddev_pop(b), 6) AS b_std FROM pr GROUP BY ALL", parts=False)
def paired_summary(spark, d):
    return stats.summary(_paired(spark, d), ["bench"]).select("bench", "n", *[F.round(c, 6).alias(c) for c in ("a_mean", "a_std", "b_mean", "b_std")])


@_query("cohen_d", _RUNS + "SELECT bench, round((avg(a) - avg(b)) / sqrt((pow(stddev_pop(a), 2) + pow(stddev_pop(b), 2)) / 2), 6) AS d FROM pr GROUP BY ALL HAVING stddev_pop(a) + stddev_pop(b) > 0", parts=False)
def cohen_d(spark, d):
    s = stats.summary(_paired(spark, d), ["bench"])
    return s.select("bench", F.round(stats.cohen_d(F.col("a_mean"), F.col("b_mean"), F.col("a_std"), F.col("b_std")), 6).alias("d")).where("d is not null")


@_query("geomean_ratio", _RUNS + "SELECT bench, round(exp(avg(ln(a))), 6) AS geo_a, round(exp(avg(ln(b))), 6) AS geo_b, round(exp(avg(ln(b))) / exp(avg(ln(a))), 6) AS ratio FROM pr GROUP BY ALL", parts=False)
def geomean_ratio(spark, d):
    g = _paired(spark, d).groupBy("bench").agg(stats.geometric_mean(F.col("a")).alias("x"), stats.geometric_mean(F.col("b")).alias("y"))
    return g.select("bench", F.round("x", 6).alias("geo_a"), F.round("y", 6).alias("geo_b"), F.round(F.col("y") / F.col("x"), 6).alias("ratio"))


@_query("pct_diff", _RUNS + "SELECT bench, round(100 - avg(b) / avg(a) * 100, 6) AS percent FROM pr GROUP BY ALL", parts=False)
def pct_diff(spark, d):
    s = stats.summary(_paired(spark, d), ["bench"])
    return s.select("bench", F.round(stats.percent_difference(F.col("a_mean"), F.col("b_mean")), 6).alias("percent"))


@_query(
    "wilcoxon_stat",
    _RUNS
    + ", df AS (SELECT bench, a - b AS d, abs(a - b) AS s FROM pr WHERE a <> b), rk AS (SELECT *, rank() OVER (PARTITION BY bench ORDER BY s) + (count(*) OVER (PARTITION BY bench, s) - 1) / 2.0 AS rnk FROM df) SELECT bench, CAST(count(*) AS BIGINT) AS n, round(least(sum(CASE WHEN d > 0 THEN rnk ELSE 0 END), sum(CASE WHEN d < 0 THEN rnk ELSE 0 END)), 6) AS w FROM rk GROUP BY ALL",
    parts=False,
)
def wilcoxon_stat(spark, d):
    return stats.signed_rank(_paired(spark, d), ["bench"]).select("bench", "n", F.round(F.col("w").cast("double"), 6).alias("w"))


@_query("paired_t_stat", _RUNS + "SELECT bench, CAST(count(*) AS BIGINT) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM pr GROUP BY ALL HAVING stddev_samp(a - b) > 0", parts=False)
def paired_t_stat(spark, d):
    return stats.paired_t(_paired(spark, d), ["bench"]).select("bench", "n", F.round("t", 6).alias("t")).where("t is not null")


#: In SQL the tails are sums of the densities, by Simpson's rule over 2000 steps; few differences without ties are counted out by all sums of ranks.
_SIMPSON = "list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({}))) * {} / 2000 / 3"
_TAILS = (
    _RUNS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", tt AS (SELECT bench, count(*) - 1 AS v, abs(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))) AS t FROM pr GROUP BY bench HAVING count(*) > 1 AND stddev_samp(a - b) > 0), "
    + "tp AS (SELECT bench, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * "
    + _SIMPSON.format("pow(1 + pow(t * k / 2000, 2) / v, -(v + 1) / 2)", "t")
    + " AS p FROM tt), "
    "df AS (SELECT bench, a - b AS d, abs(a - b) AS s FROM pr WHERE a <> b), "
    "rk AS (SELECT *, rank() OVER (PARTITION BY bench ORDER BY s) + (count(*) OVER (PARTITION BY bench, s) - 1) / 2.0 AS rnk, count(*) OVER (PARTITION BY bench, s) AS same FROM df), "
    "ws AS (SELECT bench, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rnk ELSE 0 END), sum(CASE WHEN d < 0 THEN rnk ELSE 0 END)) AS w, sum(same * same - 1) AS ties FROM rk GROUP BY bench), "
    "cn AS (SELECT 0 AS n, 0 AS s, 1::DOUBLE AS c UNION ALL SELECT n + 1, s + x * (n + 1), sum(c) FROM cn, (VALUES (0), (1)) v(x) WHERE n < 50 GROUP BY n, s + x * (n + 1)), "
    "wz AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws), "
    "wp AS (SELECT bench, CASE WHEN n <= 50 AND ties = 0 THEN least(1, 2 * (SELECT sum(c) FROM cn WHERE cn.n = wz.n AND cn.s <= wz.w) / pow(2, n)) ELSE 1 - 2 / sqrt(2 * pi()) * "
    + _SIMPSON.format("exp(-pow(z * k / 2000, 2) / 2)", "z")
    + " END AS p FROM wz) "
)


@_query(
    "paired_p_values",
    _TAILS + "SELECT b.bench, round(CASE WHEN tp.p IS NULL THEN 'NaN'::DOUBLE ELSE tp.p END, 6) AS t_p_value, round(wp.p, 6) AS rank_p_value, coalesce(tp.p, 1) < 0.05 AS significant FROM (SELECT DISTINCT bench FROM pr) b LEFT JOIN tp USING (bench) LEFT JOIN wp USING (bench)",
    parts=False,
)
def paired_p_values(spark, d):
    """Two-sided p-values of both tests, those of the first that are significant marked."""
    pairs = _paired(spark, d)
    t = stats.paired_t(pairs, ["bench"]).select("bench", F.col("p_value").alias("t_p_value"))
    out = t.join(stats.signed_rank(pairs, ["bench"]).select("bench", F.col("p_value").alias("rank_p_value")), "bench", "left")
    marked = stats.significant(out, "t_p_value").select("bench", F.lit(True).alias("significant"))
    out = out.join(marked, "bench", "left")
    return out.select("bench", F.round("t_p_value", 6).alias("t_p_value"), F.round("rank_p_value", 6).alias("rank_p_value"), F.coalesce("significant", F.lit(False)).alias("significant"))


_EACH = "count(*) AS n, avg(a) AS am, stddev_pop(a) AS sa, avg(b) AS bm, stddev_pop(b) AS sb"


@_query(
    "overhead_table",
    _TAILS + f", s AS (SELECT bench, {_EACH}, exp(avg(ln(b))) / exp(avg(ln(a))) AS g FROM pr GROUP BY bench) "
    "SELECT bench, CAST(s.n AS BIGINT) AS n, round(am, 6) AS a_mean, round(sa, 6) AS a_std, round(bm, 6) AS b_mean, round(sb, 6) AS b_std, round(CASE WHEN sa + sb > 0 THEN (am - bm) / sqrt((sa * sa + sb * sb) / 2) END, 6) AS d, round(ws.w, 6) AS w, round(wp.p, 6) AS p_value, round(g, 6) AS geometric_ratio FROM s LEFT JOIN ws USING (bench) LEFT JOIN wp USING (bench)",
    parts=False,
)
def overhead_table(spark, d):
    """The table of the overhead tool."""
    out = comparisons.overhead(runs(spark, d))
    return out.select("bench", "n", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("a_mean", "a_std", "b_mean", "b_std", "d", "w", "p_value", "geometric_ratio")])


@_query(
    "steady_state_table",
    _TAILS + f", s AS (SELECT bench, {_EACH} FROM pr GROUP BY bench), q AS (SELECT s.*, tt.t * sign(am - bm) AS t, tp.p FROM s JOIN tt USING (bench) JOIN tp USING (bench)) "
    "SELECT bench, round(am, 6) AS duration_a_mean, round(bm, 6) AS duration_b_mean, round(t, 6) AS duration_t, round(p, 6) AS duration_p_value, round(100 - bm / am * 100, 6) AS duration_percent_difference, "
    "round(3 * am - 1, 6) AS uptime_a_mean, round(3 * sb, 6) AS uptime_b_std, round(t, 6) AS uptime_t, round(100 - (3 * bm - 1) / (3 * am - 1) * 100, 6) AS uptime_percent_difference FROM q WHERE p < 0.3",
    parts=False,
)
def steady_state_table(spark, d):
    """The table of the steady-state tool, of benchmarks under a level of significance."""
    rows = runs(spark, d).withColumns({"duration": F.col("value"), "uptime": 3 * F.col("value") - 1})
    out = stats.significant(comparisons.steady_state(rows, variants=("default", "instrumented")), "duration_p_value", 0.3)
    columns = ("duration_a_mean", "duration_b_mean", "duration_t", "duration_p_value", "duration_percent_difference", "uptime_a_mean", "uptime_b_std", "uptime_t", "uptime_percent_difference")
    return out.select("bench", *[F.round(c, 6).alias(c) for c in columns])


@_query("c2_count", "SELECT callsite_id, CAST(count(*) AS BIGINT) AS n FROM st WHERE kind = 'c2' GROUP BY ALL")
def c2_count(spark, d):
    return states(spark, d).where("kind = 'c2'").groupBy("callsite_id").agg(F.count("*").alias("n"))


#: Patterns that leave out scopes, in the SQL as the same globs.
_SCOPES = ("pkg.view.*", "pkg.click.Cls0.*", "pkg.*.Cls1.run", "pkg.error")


@_query(
    "excluded_scopes",
    "SELECT event_id, name FROM (SELECT event_id, 'pkg.' || event_type || '.Cls' || (user_id % 3) || '.run' || (CASE WHEN event_id % 2 = 0 THEN 'ner' ELSE '' END) AS name FROM events) WHERE NOT (" + " OR ".join(f"name GLOB '{p}'" for p in _SCOPES) + ")",
    parts=False,
)
def excluded_scopes(spark, d):
    site = F.concat(F.lit("pkg/"), "event_type", F.lit("/Cls"), (F.col("user_id") % 3).cast("string"), F.lit(".run"), F.when(F.col("event_id") % 2 == 0, "ner").otherwise(""), F.lit("(I)V"))
    rows = table(spark, d, "events").select("event_id", scopes.scope_of(site).alias("name"))
    return scopes.exclude(rows, _SCOPES, F.col("name"))


# ----------------------------------------------------------------- deliveries
def _delivered(spark: SparkSession, d: str) -> tuple[incremental.WindowStore, DataFrame]:
    """All events in four deliveries: by thirds of the days, the middle one first, which moves anchors, and the last one twice."""
    events = dispatches(spark, d).select(*KEYS, "class", "t_us")
    store = incremental.WindowStore(spark, scratch_folder(spark, "store"), KEYS, "class", DELTA)
    third = F.pmod(F.floor(F.col("t_us") / DELTA), F.lit(3))
    for name, k in (("b", 1), ("a", 0), ("c", 2), ("c", 2)):
        store.deliver(name, events.where(third == k))
    return store, events


@_query("delivered_counts", f"SELECT {_K}, t0, win, class, CAST(n AS BIGINT) AS n FROM c")
def delivered_counts(spark, d):
    store, events = _delivered(spark, d)
    return store.counts(events).select(*KEYS, "t0", "win", "class", "n")


@_query("delivered_inversions", f"SELECT {_K}, prev_win, win, array_to_string(prev_rank, ',') AS prev_rank, array_to_string(rank, ',') AS rank FROM iv")
def delivered_inversions(spark, d):
    rows = w.rank_inversions(incremental.pairs(*_delivered(spark, d)))
    return rows.select(*KEYS, "prev_win", "win", F.array_join("prev_rank", ",").alias("prev_rank"), F.array_join("rank", ",").alias("rank"))


# ------------------------------------------------------------------- streaming
#: Groups of a stream whose state is one row, about.
STREAMED = 64


@_query(
    "stream_window_pairs",
    f"SELECT {_K}, prev_win, win, coalesce(c, false) AS changed, coalesce(i, false) AS inverted FROM p LEFT JOIN (SELECT {_K}, win, true AS c FROM ch) USING ({_K}, win) LEFT JOIN (SELECT {_K}, win, true AS i FROM iv) USING ({_K}, win)",
)
def stream_window_pairs(spark, d):
    """The events as a stream of four deliveries, up to a day out of order, and of one event far ahead that closes all windows."""
    events = dispatches(spark, d).select(*KEYS, "class", "t_us")
    first, last, groups = events.agg(F.min("t_us"), F.max("t_us"), F.approx_count_distinct(F.struct(*KEYS))).first()
    folder, day = scratch_folder(spark, "stream"), 86_400_000_000
    late = F.pmod(F.xxhash64("t_us", "callsite_id"), F.lit(day))
    part = F.least(F.floor((F.col("t_us") + late - F.lit(first or 0)) * 4 / F.lit(max((last or 0) - (first or 0), 1))), F.lit(3))
    ahead = events.limit(1).select(F.lit(-1).cast(events.schema["callsite_id"].dataType).alias("callsite_id"), "compile_id", "class", (F.lit(last or 0) + 40 * day).alias("t_us"))
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), groups // STREAMED)
    for rows in [*(events.where(part == k) for k in range(4)), ahead]:  # one after the other, as they would arrive
        rows.withColumn("ts", F.timestamp_micros("t_us")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in events.schema)}, ts timestamp").parquet(f"{folder}/in")
        pairs = streams.window_pairs_in_event_time(stream, KEYS, "class", DELTA, delay="26 hours", buckets=buckets)
        pairs.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    out = spark.read.schema(pairs.schema).parquet(f"{folder}/out")
    return out.select(*KEYS, "prev_win", "win", "changed", "inverted")


# ------------------------------------------------------- formats and whole plans
_CLASS_IDS = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 4000000000 END"


@_query("binary_roundtrip", f"SELECT k % 2 + 1 AS compile_id, callsite_id, CAST({_CLASS_IDS} AS BIGINT) AS class_id, t_us, event_id FROM e")
def binary_roundtrip(spark, d):
    """Records packed into files' bytes and decoded again, an event's number at its record's place."""
    class_id = F.expr(_CLASS_IDS).cast("long")
    events = table(spark, d, "events").select("event_id", (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 2 + 1).alias("compile_id"), F.col("user_id").alias("callsite_id"), class_id.alias("class_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))

    def both_ways(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(1, 5)]
            rows = traces.decode_records(traces.encode_records(zip(*columns), padding=3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)]], names=batch.schema.names)

    return events.mapInArrow(both_ways, "event_id long, compile_id long, callsite_id long, class_id long, t_us long")


@_query("event_rank", "SELECT event_id, CAST(row_number() OVER (PARTITION BY callsite_id, k % 2 ORDER BY t_us, event_id) AS INTEGER) AS place FROM e")
def event_rank(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("callsite_id"), (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 2).alias("compile_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return w.numbered(rows, KEYS, ["t_us", "event_id"]).select("event_id", "place")


@_query("readable_dump", "SELECT coalesce(c_name, 'null') || ' ' || (k % 2) || ' ' || event_type || ' ' || t_us AS value FROM e LEFT JOIN customer ON c_custkey = callsite_id + 100")
def readable_dump(spark, d):
    events = dispatches(spark, d).select("compile_id", "callsite_id", F.col("class").alias("class_id"), "t_us")
    sites = table(spark, d, "customer").select((F.col("c_custkey") - 100).alias("callsite_id"), F.col("c_name").alias("callsite"))
    classes = events.select("class_id", F.col("class_id").alias("class_name")).distinct()
    return traces.readable(events, sites, classes)


@_query("log_name_classify", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'default' ELSE 'instrumented' END AS variant, CASE event_id % 3 WHEN 0 THEN 'ren' ELSE 'dacapo' END AS suite, 'a_' || event_type AS bench FROM events WHERE event_type <> 'view'", parts=False)
def log_name_classify(spark, d):
    name = F.expr("concat('compiler_log_', if(event_id % 2 = 0, 'default', 'instrumented'), '_', if(event_id % 3 = 0, 'ren', 'dacapo'), '_a_', event_type, if(event_type = 'view', '.xml', concat('_', cast(event_id as string), '.xml')))")
    return eventlog.log_series(table(spark, d, "events").select("event_id", name.alias("file"))).select("event_id", "variant", "suite", "bench")


@_query("series_names", "SELECT event_id, 'ren_' || event_type AS name FROM events", parts=False)
def series_names(spark, d):
    name = F.expr("concat(if(event_id % 2 = 0, 'default_', 'instrumented_'), 'ren_', event_type, '.txt')")
    return table(spark, d, "events").select("event_id", text.series_name(name, ("default_", "instrumented_")).alias("name"))


@_query("count_lines", "SELECT callsite_id || ' - ' || count(*) AS value FROM st WHERE kind = 'c2' GROUP BY callsite_id")
def count_lines(spark, d):
    return files.count_lines(QUERIES["c2_count"](spark, d), "callsite_id")


@_query(
    "reduction_json",
    _REDUCTION
    + f"SELECT {_K}, '{{' || string_agg('\"' || key || '\":' || v, ',' ORDER BY key) || '}}' AS json FROM (SELECT {_K}, id || ' - before' AS key, n_before AS v FROM rd UNION ALL SELECT {_K}, id || ' - after', n_after FROM rd) GROUP BY {_K}",
)
def reduction_json(spark, d):
    rows = _timeline(spark, d, "raw").withColumn("section", F.lit("RawWindowInformation"))
    return digest.reductions(rows, KEYS)


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """The digest's timelines of the surrogate events, with the site's number as its text."""
    trap = lambda letter, *ids: F.when((F.col("tag") == "D") & F.col("id").isin(*ids), F.concat(F.lit(letter), "id"))
    marks = states(spark, d).withColumns({"reason": trap("r", "0", "2", "4"), "action": trap("a", "0", "1"), "ord": F.col("event_id")})
    rows = digest.sections(dispatches(spark, d), marks, None, DELTA, category="class")
    return rows.withColumn("callsite", F.concat(F.lit("site "), F.col("callsite_id").cast("string")))


def _tags(name: str, section: str, where: str = "true") -> str:
    return f"SELECT 'site ' || callsite_id AS callsite, compile_id, '{section}' AS section, tag, CAST(count(*) AS BIGINT) AS n FROM {name} WHERE {where} GROUP BY ALL"


@_query("report_roundtrip", " UNION ALL ".join([_tags("tc", "Changes"), _tags("ti", "Inversions"), _tags("tr", "RawWindowInformation", f"({_K}) IN (SELECT ({_K}) FROM ti)")]))
def report_roundtrip(spark, d):
    """The text report of all groups, written and parsed again: how many rows of each kind."""
    return _read_back(spark, d).groupBy("callsite", "compile_id", "section", "tag").agg(F.count("*").alias("n"))


def _read_back(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_folder(spark, "report")
    reports.write_report(reports.report_lines(_sections(spark, d), DELTA), folder)
    return reports.read_report(spark, f"{folder}/*/*.txt")


#: What a report holds of changes (sec 1), inversions (2) and raw windows (3), with share lists as text.
_REPORT = f"""
, tx AS (SELECT {_K}, win, string_agg(class || ': ' || printf('%.6f', r1), ', ' ORDER BY class) AS first, string_agg(class || ': ' || printf('%.6f', r2), ', ' ORDER BY class) AS second FROM z GROUP BY {_K}, win)
, rt AS (SELECT n.callsite_id, n.compile_id, n.win, string_agg(cl.class || ': ' || printf('%.6f', coalesce(r.ratio, 0)), ', ' ORDER BY cl.class) AS first FROM nw n JOIN cl ON cl.callsite_id = n.callsite_id AND cl.compile_id = n.compile_id LEFT JOIN r ON r.callsite_id = n.callsite_id AND r.compile_id = n.compile_id AND r.win = n.win AND r.class = cl.class GROUP BY ALL)
, st2 AS (SELECT pl.*, CASE WHEN tag = 'D' AND id IN ('0', '2', '4') THEN 'r' || id END AS reason, CASE WHEN tag = 'D' AND id IN ('0', '1') THEN 'a' || id END AS action FROM pl)
, en AS (
SELECT {_K}, 1 AS sec, win - 1 AS step, 2 AS kind_ord, 'W' AS tag, NULL AS id, NULL AS kind, NULL AS time_us, NULL AS reason, NULL AS action, label, first, second FROM ch JOIN tx USING ({_K}, win)
UNION ALL SELECT {_K}, 2, win - 1, 2, 'W', NULL, NULL, NULL, NULL, NULL, label, first, second FROM iv JOIN tx USING ({_K}, win)
UNION ALL SELECT {_K}, 3, win, 2, 'W', NULL, NULL, NULL, NULL, NULL, t0 // {DELTA} + win, first, NULL FROM nw JOIN rt USING ({_K}, win) WHERE ({_K}) IN (SELECT ({_K}) FROM ti)
UNION ALL SELECT {_K}, sec, step, CASE tag WHEN 'C' THEN 0 ELSE 1 END, tag, id, kind, time_us, reason, action, NULL, NULL, NULL FROM st2, (VALUES (1, 2), (2, 2), (3, 1)) v(sec, before) WHERE step <= n_windows - before AND (sec < 3 OR ({_K}) IN (SELECT ({_K}) FROM ti)))
"""


@_query(
    "report_rows",
    _REPORT
    + f"SELECT 'site ' || callsite_id AS callsite, compile_id, CASE sec WHEN 1 THEN 'Changes' WHEN 2 THEN 'Inversions' ELSE 'RawWindowInformation' END AS section, CAST({DELTA} AS BIGINT) AS window_us, tag, id, kind, CAST(time_us AS BIGINT) AS time_us, reason, action, CAST(label AS BIGINT) AS label, first, second FROM en",
)
def report_rows(spark, d):
    """The text report, written and parsed again: all that each row says."""
    return _read_back(spark, d).drop("file", "ord")


_TRAP = "CASE WHEN reason IS NULL AND action IS NULL THEN '' ELSE '[trap: reason = ' || coalesce(reason, 'null') || ', action = ' || coalesce(action, 'null') || ']' END"


@_query(
    "report_lines",
    _REPORT
    + f""", tl AS (SELECT *, CASE WHEN tag = 'C' THEN ['Compilation at: ' || time_us || ' [kind = ' || kind || ', id = ' || id || ']']
WHEN tag = 'D' THEN ['Decompilation at: ' || time_us || '[compile_id = ' || id || ', compile_kind = ' || kind || ']' || {_TRAP}]
WHEN sec = 1 THEN ['window before: ' || label || ' - window after: ' || (label + 1), '    First Window: ' || first, '    Second Window: ' || second]
WHEN sec = 2 THEN ['windows: ' || label || ' - ' || (label + 1), '    First Window: ' || first, '    Second Window: ' || second]
ELSE ['window information for window: ' || label, '    ' || first] END AS lines FROM en)
, fl AS (SELECT {_K}, 0 AS sec, NULL AS step, NULL AS kind_ord, NULL AS mark, 0 AS nth, 'CCU [callsite=site ' || callsite_id || ', compile_id=' || compile_id || ']' AS line FROM (SELECT DISTINCT {_K} FROM en)
UNION ALL SELECT {_K}, sec, NULL, NULL, NULL, 0, '    ' || CASE sec WHEN 1 THEN 'Changes' WHEN 2 THEN 'Inversions' ELSE 'RawWindowInformation' END || '[start time = ' || t0 || ', window size = {DELTA}]:' FROM (SELECT DISTINCT {_K}, sec FROM en) JOIN sp USING ({_K})
UNION ALL SELECT {_K}, sec, step, kind_ord, lines[1], i, '        ' || lines[i] FROM tl, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i))
SELECT callsite_id, compile_id, lpad(CAST(callsite_id % 1000 AS VARCHAR), 3, '0') AS bucket, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY sec, step NULLS FIRST, kind_ord NULLS FIRST, mark NULLS FIRST, nth) AS INTEGER) AS at, line FROM fl""",
)
def report_lines(spark, d):
    """Every line of the report at its place in its group."""
    lines = reports.report_lines(_sections(spark, d), DELTA)
    placed = w.numbered(lines, KEYS, [*reports.LINE_ORDER[2:]])
    return placed.select(*KEYS, "bucket", F.col("place").alias("at"), F.col("value").alias("line"))


_GROUPS = f"SELECT DISTINCT {_K} FROM nw"
_STATISTICS = f"""
, lc AS ({_line_sql("tc")}), li AS ({_line_sql("ti")}), xc AS ({_after_sql("ac")}), xi AS ({_after_sql("ai")})
, su AS (SELECT {_K}, sum(n) * {DELTA} AS s FROM bd JOIN (SELECT DISTINCT {_K}, id FROM (SELECT {_K}, id FROM tc WHERE tag = 'D' UNION ALL SELECT {_K}, id FROM ti WHERE tag = 'D')) USING ({_K}, id) GROUP BY ALL)
, av AS (SELECT {_K}, avg(n) AS m FROM bd GROUP BY ALL)
, zl AS (SELECT {_K}, win, list(class ORDER BY round(r1, 6) DESC, class) AS la, list(class ORDER BY round(r2, 6) DESC, class) AS lb FROM z GROUP BY {_K}, win)
, z4 AS (SELECT *, list_filter([la[1], lb[1], la[2], lb[2]], lambda y: y IS NOT NULL) AS l FROM zl)
, z2 AS (SELECT *, list_filter(l, lambda v, i: list_position(l, v) = i)[1:2] AS k FROM z4)
, zs AS (SELECT {_K}, win, array_to_string(list_filter(la, lambda y: list_contains(k, y)), ' - ') AS f, array_to_string(list_filter(lb, lambda y: list_contains(k, y)), ' - ') AS s FROM z2)
, so AS (SELECT sg.callsite_id, sg.compile_id, place, f || ' -> ' || s AS p FROM sg JOIN zs ON zs.callsite_id = sg.callsite_id AND zs.compile_id = sg.compile_id AND zs.win = sg.step + 1)
, mi AS (SELECT {_K}, p, n FROM (SELECT {_K}, p, count(*) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, min(place)) AS rn FROM so GROUP BY {_K}, p) WHERE rn = 1)
, mo AS (SELECT {_K}, p, n FROM (SELECT {_K}, p, count(*) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, min(place)) AS rn FROM (SELECT {_K}, place, p || ' -> ' || lead(p) OVER (PARTITION BY {_K} ORDER BY place) AS p FROM so) WHERE p IS NOT NULL GROUP BY {_K}, p) WHERE rn = 1)
SELECT {_K}, CAST(coalesce(lc.lines, 0) AS BIGINT) AS changes, CAST(coalesce(lc.pairs, 0) AS BIGINT) AS change_pairs, CAST(coalesce(lc.compilations, 0) AS BIGINT) AS compilations, CAST(coalesce(lc.decompilations, 0) AS BIGINT) AS decompilations,
CAST(coalesce(li.lines, 0) AS BIGINT) AS inversions, CAST(coalesce(li.pairs, 0) AS BIGINT) AS inversion_pairs, CAST(coalesce(xc.after_compilation, 0) AS BIGINT) AS changes_after_compilation, CAST(coalesce(xi.after_compilation, 0) AS BIGINT) AS inversions_after_compilation,
CAST(coalesce(su.s, 0) AS BIGINT) AS suboptimal_us, round(coalesce(av.m, 0), 6) AS average_inversions_before_decompilation,
mi.p AS most_frequent_inversion, CAST(mi.n AS BIGINT) AS most_frequent_inversion_value, mo.p AS most_frequent_oscillation, CAST(mo.n AS BIGINT) AS most_frequent_oscillation_value
FROM ({_GROUPS}) LEFT JOIN lc USING ({_K}) LEFT JOIN li USING ({_K}) LEFT JOIN xc USING ({_K}) LEFT JOIN xi USING ({_K}) LEFT JOIN su USING ({_K}) LEFT JOIN av USING ({_K}) LEFT JOIN mi USING ({_K}) LEFT JOIN mo USING ({_K})
"""


@_query("group_statistics", _STATISTICS)
def group_statistics(spark, d):
    """The statistics table of all groups. Patterns are those of share lists that hold every category, absent ones as 0."""
    out = digest.statistics(_sections(spark, d), DELTA, KEYS)
    return out.select(*[c for c in out.columns if not c.startswith("average")], F.round("average_inversions_before_decompilation", 6).alias("average_inversions_before_decompilation"))
