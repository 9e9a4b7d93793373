"""Command line: ``python -m eventloom <tool> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom.operators import stats
from eventloom.plans import comparisons
from eventloom.plans import digest as plan
from eventloom.sinks import files
from eventloom.sources import archives, eventlog, listings, reports, traces


def run_digest(spark: SparkSession, a: argparse.Namespace) -> None:
    patterns = [r.value for r in spark.read.text(a.exclude).collect()] if a.exclude else []  # a short list of globs
    progress = plan.Progress()
    out = plan.digest(spark, a.input_folder, a.compile_log, a.delta, exclude=patterns, progress=progress)
    files.write_parquet(out.rows, f"{a.output_folder}/timelines", ["section"])
    # the report comes from the timelines that are written
    rows = spark.read.schema(out.rows.schema).parquet(f"{a.output_folder}/timelines")
    reports.write_report(reports.report_lines(rows, out.window_us), f"{a.output_folder}/report")
    print("".join(f"{n} {stage}\n" for stage, n in progress.counts().items()), end="")


def run_analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.archives:
        inside = archives.read_archives(spark, f"{a.input_folder}/{a.archives}").where("error is null and not more")
        rows = reports.parse_report(inside.select(F.concat_ws("/", "archive", "member").alias("file"), "ord", "line").where(F.col("file").endswith(".txt")))
    else:
        rows = reports.read_report(spark, f"{a.input_folder}/{a.pattern}")
    window = rows.agg(F.max("window_us")).first()[0] or 0
    base = f"{a.output_folder}/{a.name}"
    stat = plan.with_method(plan.statistics(rows, int(window)))
    files.write_csv(stat.orderBy(F.desc("inversions_after_compilation"), "id"), f"{base}/{a.name}_statistics")
    files.write_csv(plan.by_cost(stat, listings.read_costs(spark, a.hotness)), f"{base}/{a.name}_normalized")
    files.write_csv(stat.select("key", F.col("id").alias("value")), f"{base}/ccu_to_id")
    files.write_json(plan.reductions(rows), f"{base}/reduction")
    files.write_csv(plan.oscillations(rows), f"{base}/oscillations")
    metrics = ["changes", "inversions", "compilations", "decompilations", "changes_after_compilation", "inversions_after_compilation", "suboptimal_us"]
    files.write_csv(files.points(stat, metrics, "id"), f"{base}/charts/points")
    for m, top in files.chart_data(stat, metrics, "id").items():
        files.write_csv(top, f"{base}/charts/top_{m}")
        values = stat.select("id", F.col(m).cast("double").alias(m))
        files.write_csv(stats.box(values.drop("id"), [], m), f"{base}/charts/box_{m}")
        files.write_csv(stats.outliers(values, [], m), f"{base}/charts/outliers_{m}")


def run_overhead(spark: SparkSession, a: argparse.Namespace) -> None:
    out = comparisons.overhead(listings.read_elapsed(spark, f"{a.input_folder}/*.txt", a.short)).cache()
    files.write_text(files.paired_text(out), f"{a.output_folder}/overhead_text")
    files.write_csv(out, f"{a.output_folder}/overhead")


def run_steady_state(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = stats.without(listings.read_run_series(spark, f"{a.input_folder}/*.csv"), a.exclude, variant="variant", side="normal")
    out = comparisons.steady_state(runs)
    files.write_csv(out, f"{a.output_folder}/statistics")
    files.write_csv(stats.significant(out, "duration_p_value"), f"{a.output_folder}/statistics_sig")


def run_log_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = eventlog.top_tier_counts(eventlog.read_log(spark, f"{a.input_folder}/compiler_log*")).cache()
    for variant, name in (("default", "normal"), ("instrumented", "instrumented")):
        files.write_text(files.count_lines(counts.where(F.col("variant") == variant)), f"{a.output_folder}/{name}")


def run_hot_methods(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = listings.read_cost_listing(spark, f"{a.input_folder}/*.txt", a.limit)
    rows = rows.withColumn("bench", F.regexp_replace("file", r"\.txt$", ""))
    rows.drop("file", "ord").write.mode("overwrite").partitionBy("bench").csv(f"{a.output_folder}/hot_methods", header=True)


def run_dump(spark: SparkSession, a: argparse.Namespace) -> None:
    events = traces.read_traces(spark, a.callsite or traces.folder_paths(a.input_folder)["traces"])
    sites = traces.read_dictionary(spark, a.id, "callsite", "callsite_id")
    classes = traces.read_dictionary(spark, a.id_class, "class_name", "class_id")
    files.write_text(traces.readable(events, sites, classes), a.output_folder)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    tools = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, run, **defaults):
        t = tools.add_parser(name)
        t.set_defaults(run=run)
        t.add_argument("-i", "--input-folder", default=defaults.get("i"), required="i" not in defaults)
        t.add_argument("-o", "--output-folder", default=defaults.get("o", "./result/"))
        return t

    t = tool("digest", run_digest)
    t.add_argument("-d", "--delta", type=int, default=1000, help="window in microseconds")
    t.add_argument("-c", "--compile-log", required=True)
    t.add_argument("--exclude", help="file of glob patterns of scopes to leave out")
    t = tool("analyse", run_analyse, i="./result/")
    t.add_argument("--hotness", required=True)
    t.add_argument("--name", required=True)
    t.add_argument("--pattern", default="report/*/*.txt")
    t.add_argument("--archives", help="pattern of archives whose text members are the reports, instead")
    t = tool("overhead", run_overhead, i="./output/")
    t.add_argument("--short", action="store_true", help="read one digit of minutes")
    t.add_argument("--delta", type=int, default=1000, help="taken for compatibility; runs have no windows")
    t = tool("steady-state", run_steady_state, o="./threshold_result/")
    t.add_argument("--exclude", action="append", default=[], help="a benchmark to leave out; may be given several times")
    tool("log-compare", run_log_compare)
    t = tool("hot-methods", run_hot_methods, o="./hotness/")
    t.add_argument("--limit", type=int)
    t = tools.add_parser("dump")
    t.set_defaults(run=run_dump)
    source = t.add_mutually_exclusive_group()
    source.add_argument("-f", "--input-folder", default=".", help="folder of trace files")
    source.add_argument("-c", "--callsite", help="one trace file, instead of a folder's")
    t.add_argument("-o", "--output-folder", default="./readable/")
    t.add_argument("-i", "--id", required=True, help="site dictionary")
    t.add_argument("-k", "--id-class", required=True, help="category dictionary")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("eventloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
