"""From a trace folder and an event log to timelines and reports, and from timelines to statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import scopes
from eventloom.functions.descriptors import method_descriptor, method_name
from eventloom.functions.text import safe_ratio, site_key
from eventloom.operators import attribution as at
from eventloom.operators import joins, placement
from eventloom.operators import windows as w
from eventloom.sinks.scratch import number_rows, save
from eventloom.sources import eventlog, reports, traces

KEYS = ["callsite_id", "compile_id"]


@dataclass
class Digest:
    """Timelines of all groups: changes, inversions and raw windows, in one table with a section each."""

    rows: DataFrame
    window_us: int

    def report(self, always_raw: bool = False) -> DataFrame:
        """The lines of the text report."""
        return reports.report_lines(self.rows, self.window_us, always_raw)


def sections(events: DataFrame, states: DataFrame, known: DataFrame | None, delta_us: int, category: str = "class_id", names: DataFrame | None = None) -> DataFrame:
    """The timelines of events (compile_id, callsite_id, category, t_us) and state changes of their sites.

    ``names`` gives categories names for the text columns ``first`` and ``second``; sharing lists hold
    every category of the group, absent ones as 0. Counts, vectors and placed state changes are written once, and read by all that is made of them.
    """
    counts = save(w.window_counts(events, KEYS, category, delta_us, known=known), "counts")
    vectors = save(w.share_vectors(counts, KEYS, category), "vectors")
    members = counts.groupBy(*KEYS).agg(F.array_sort(F.collect_set(category)).alias("members"))
    if names is not None:
        # categories are named once a group and category, after all counting
        label = counts.select(*KEYS, category).distinct().join(names.select(category, F.col("class_name").alias("label")), category, "left")
        members = label.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col(category).alias("name"), F.coalesce("label", F.lit("null")).alias("label")))).alias("members"))
    else:
        members = members.withColumn("members", F.transform("members", lambda m: F.struct(m.alias("name"), m.cast("string").alias("label"))))

    def text(shares):
        def one(m):
            found = F.filter(shares, lambda s: s["name"] == m["name"])
            return F.format_string("%s: %s", m["label"], w.six_digits(F.coalesce(F.get(found, F.lit(0))["ratio"], F.lit(0.0))))

        return F.array_join(F.transform("members", one), ", ")

    pairs = w.window_pairs(vectors, KEYS).withColumn("label", w.label(F.col("t0"), F.col("step"), delta_us))
    spans = save(placement.spans(counts, KEYS), "spans")
    # the steps are the same whether windows or what lies between them are counted; only where they end differs
    every = save(placement.place(states, spans, KEYS, delta_us, on=["callsite_id"], order=("ord",), whole=True), "placed")
    placed = {True: every, False: every.where(F.col("step") <= F.col("n_windows") - 2)}
    named = lambda rows: rows.join(members, KEYS)
    pair_text = {"first": text(F.col("prev_shares")), "second": text(F.col("shares"))}
    present = lambda c: F.transform(F.filter("members", lambda m: F.exists(c, lambda s: s["name"] == m["name"])), lambda m: m["label"])
    parts = {
        "Changes": named(w.share_changes(pairs)).withColumns(pair_text),
        "Inversions": named(w.rank_inversions(pairs)).withColumns(pair_text),
        "RawWindowInformation": named(vectors.withColumn("step", F.col("win"))).withColumns({"first": text(F.col("shares")), "second": F.lit(None).cast("string"), "label": w.label(F.col("t0"), F.col("win"), delta_us), "names": present(F.col("shares"))}),
    }
    out = None
    for section, rows in parts.items():
        raw = section == "RawWindowInformation"
        states_here = placed[raw]
        rows = rows if raw else rows.withColumn("names", F.lit(None).cast("array<string>"))
        marks = placement.timeline(rows, states_here, KEYS, ["label", "first", "second", "names"])
        extra = states_here.select(*KEYS, "tag", "step", "reason", "action")
        marks = marks.join(extra, [*KEYS, "tag", "step"], "left").withColumn("section", F.lit(section))
        out = marks if out is None else out.unionByName(marks)
    return out.join(spans.select(*KEYS, "t0"), KEYS)


class Progress:
    """How far a digest has got: what its stages have counted so far, from the metrics that Spark keeps as their rows pass by. No job of its own is run."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, stage: str) -> DataFrame:
        """The rows, counted as ``stage`` by the action that first reads them."""
        self._seen[stage] = Observation(stage)
        return rows.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, int]:
        """Rows by stage; to be asked after the action that read them. A stage that Spark found to be empty, and left out, has none."""
        out = {}
        for stage, seen in self._seen.items():
            try:
                out[stage] = seen.get["rows"]
            except Py4JJavaError:  # no metrics came of it
                out[stage] = 0
        return out


def digest(spark: SparkSession, folder: str, log: str, delta_us: int = 1000, by_part: bool = False, log_parts: bool = False, exclude: Iterable[str] = (), progress: Progress | None = None) -> Digest:
    """The digest of a trace folder. The event log is parsed once and joined by method; with ``log_parts`` it is a folder of parts.
    Sites in scopes that meet a pattern of ``exclude`` are left out. ``progress`` counts records and timeline rows as they are read.
    """
    paths = traces.folder_paths(folder)
    events = traces.read_traces(spark, paths["traces"])
    sites = traces.read_dictionary(spark, paths["sites"], "callsite", "callsite_id")
    if patterns := list(exclude):
        sites = scopes.exclude(sites, patterns, scopes.scope_of(method_name(F.col("callsite"))))
        events = events.join(sites.select("callsite_id"), "callsite_id", "left_semi")
    if progress is not None:
        events = progress.watch(events, "records")
    classes = traces.read_dictionary(spark, paths["classes"], "class_name", "class_id")
    lines = eventlog.read_log(spark, log, log_parts)
    offset = traces.read_start_ms(spark, paths["start"]) - (eventlog.vm_start_ms(lines) or 0)
    methods = sites.select("callsite_id", method_descriptor(F.col("callsite")).alias("descriptor"))
    states = eventlog.state_events(lines, methods, offset, by_part)
    rows = sections(events, states, classes, delta_us, names=classes)
    rows = joins.decode(rows, sites, "callsite_id", required=True)
    return Digest(rows if progress is None else progress.watch(rows, "timeline rows"), delta_us)


def statistics(rows: DataFrame, window_us: int, keys: list[str] = ["callsite", "compile_id"]) -> DataFrame:  # noqa: B006
    """One row a group: lines and pairs of both sections, what came after compilation, time in a wrong state, and frequent patterns.

    ``rows`` are timelines, with step and kind_ord, or as a report's reader gives them with ``ord``.
    """
    if "step" not in rows.columns:
        rows = rows.withColumns({"step": F.col("ord"), "kind_ord": F.lit(0)})
    rows = save(rows.where(F.col("section").isin("Changes", "Inversions", "RawWindowInformation")), "timelines")
    changes, inversions = (rows.where(F.col("section") == s) for s in ("Changes", "Inversions"))
    if "first_shares" not in rows.columns:
        inversions = inversions.withColumns({"first_shares": reports.parsed_shares(F.col("first")), "second_shares": reports.parsed_shares(F.col("second"))})
    top = at.leading_two(F.col("first_shares"), F.col("second_shares"))
    cleaned = inversions.withColumn("top", top)
    cleaned = cleaned.withColumns({"first_sig": at.signature(at.keep_names(F.col("first_shares"), F.col("top"))), "second_sig": at.signature(at.keep_names(F.col("second_shares"), F.col("top")))})
    changes_in = at.attribute_state(changes, keys)
    inversions_in = save(at.attribute_state(cleaned.select(*keys, "step", "kind_ord", "tag", "id", "kind", "first_sig", "second_sig"), keys), "states")
    seen = at.attribution_order(inversions_in, keys)
    pair, step = ["first_sig", "second_sig"], ["first_sig", "second_sig", "next_first_sig", "next_second_sig"]
    joined = lambda c: F.concat_ws(" -> ", *c)
    frequent = at.most_frequent(at.frequencies(seen, keys, pair), keys).select(*keys, joined(pair).alias("most_frequent_inversion"), F.col("n").alias("most_frequent_inversion_value"))
    often = at.most_frequent(at.frequencies(at.transitions(seen, keys, pair), keys, step), keys).select(*keys, joined(step).alias("most_frequent_oscillation"), F.col("n").alias("most_frequent_oscillation_value"))
    before = save(at.observations_before_end(inversions_in.drop("state", "epoch"), keys), "before")
    ended = rows.where("tag = 'D' and section <> 'RawWindowInformation'").select(*keys, "id")
    parts = [
        at.counts_in_state(changes_in, keys).withColumnRenamed("after_compilation", "changes_after_compilation"),
        at.counts_in_state(inversions_in, keys).withColumnRenamed("after_compilation", "inversions_after_compilation"),
        at.time_in_wrong_state(before, ended, keys, window_us),
        at.mean_before_end(before, keys).withColumnRenamed("mean_before_end", "average_inversions_before_decompilation"),
        frequent,
        often,
    ]
    # the lines of both sections in one pass: an observation takes three
    count = lambda section, **each: F.sum(F.when(F.col("section") == section, F.create_map(*[F.lit(x) for kv in each.items() for x in kv])[F.col("tag")]).otherwise(0))
    out = rows.groupBy(*keys).agg(
        count("Changes", W=3, C=1, D=1).alias("changes"),
        count("Changes", W=1, C=0, D=0).alias("change_pairs"),
        count("Changes", W=0, C=1, D=0).alias("compilations"),
        count("Changes", W=0, C=0, D=1).alias("decompilations"),
        count("Inversions", W=3, C=1, D=1).alias("inversions"),
        count("Inversions", W=1, C=0, D=0).alias("inversion_pairs"),
    )
    for part in parts:
        out = out.join(part, keys, "left")
    zero = [c for c in out.columns if c not in keys and not c.startswith("most_frequent")]
    return out.fillna(0, zero)


def with_method(rows: DataFrame) -> DataFrame:
    """id, the row's place in the order of (callsite, compile_id) from 0, key and method_descriptor."""
    return number_rows(rows, "id", "callsite", "compile_id").withColumns({"key": site_key(F.col("callsite"), F.col("compile_id")), "method_descriptor": method_name(F.col("callsite"))})


def by_cost(rows: DataFrame, costs: DataFrame, fan_out: bool = False) -> DataFrame:
    """Sums a method with its costs, and inversions after compilation per cycle, the most first.

    Of several cost rows of a method the first counts; with ``fan_out`` each joins.
    """
    sums = ["changes", "inversions", "compilations", "decompilations", "changes_after_compilation", "inversions_after_compilation"]
    costs = costs.withColumn("__ord", F.monotonically_increasing_id())
    joined = joins.with_costs(rows, costs, "method_descriptor", None if fan_out else "__ord")
    out = joins.roll_up(joined, "method_descriptor", sums, ["exclusive cpu sec", "cpu cycles"], "id")
    ratio = safe_ratio(F.col("inversions_after_compilation"), F.col("cpu cycles"))
    return out.withColumn("normalized_inversions_after_compilation", ratio).orderBy(F.desc("normalized_inversions_after_compilation"), "method_descriptor")


def reductions(rows: DataFrame, keys: list[str] = ["callsite", "compile_id"]) -> DataFrame:  # noqa: B006
    """keys, json: for each state ``{"id - before": n, "id - after": n}`` of different categories, from raw windows."""
    raw = rows.where(F.col("section") == "RawWindowInformation")
    if "step" not in raw.columns:
        raw = raw.withColumns({"step": F.col("ord"), "kind_ord": F.lit(0)})
    if "names" not in raw.columns:
        raw = raw.withColumn("names", F.transform(F.filter(reports.parsed_shares(F.col("first")), lambda s: s["ratio"] != 0), lambda s: s["name"]))
    found = at.category_reduction(raw, keys)
    pairs = F.array(F.struct(F.concat("id", F.lit(" - before")).alias("k"), F.col("n_before").alias("v")), F.struct(F.concat("id", F.lit(" - after")).alias("k"), F.col("n_after").alias("v")))
    entries = found.select(*keys, F.explode(pairs).alias("e")).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return entries.select(*keys, F.to_json(F.map_from_entries("es")).alias("json"))


def oscillations(rows: DataFrame, keys: list[str] = ["callsite", "compile_id"]) -> DataFrame:  # noqa: B006
    """keys, first and second signatures of consecutive inversions, n: one table for all groups."""
    inversions = rows.where(F.col("section") == "Inversions")
    if "step" not in inversions.columns:
        inversions = inversions.withColumns({"step": F.col("ord"), "kind_ord": F.lit(0)})
    signed = inversions.withColumns({"first_sig": at.signature(reports.parsed_shares(F.col("first"))), "second_sig": at.signature(reports.parsed_shares(F.col("second")))})
    seen = at.attribution_order(at.attribute_state(signed, keys), keys)
    return at.frequencies(at.transitions(seen, keys, ["first_sig", "second_sig"]), keys, ["first_sig", "second_sig", "next_first_sig", "next_second_sig"]).drop("first_place")
