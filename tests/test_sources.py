import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import joins
from eventloom.sinks import scratch
from eventloom.sources import eventlog, lines, listings, reports, traces

LOG = """<hotspot_log version='160 1' process='1' time_ms='1747217577473'>
noise
<nmethod compile_id='536' compiler='c1' method='Main getEl (I)LM1;' stamp='2.058'/>
<nmethod compile_id='630' compiler='c2' method='Main getEl (I)LM1;' stamp='2.247'/>
<make_not_entrant compile_id='536' stamp='2.247'/>
<uncommon_trap reason='unstable_if' action='reinterpret' compile_id='630' stamp='2.942'/>
<make_not_entrant compile_id='630' stamp='2.942'/>
<nmethod compile_id='705' compiler='c1' method='Main getEl (I)LM1;' stamp='2.943'/>
<nmethod compile_id='709' compiler='c2' method='Main getEl (I)LM1;' stamp='2.985'/>
<make_not_entrant compile_id='705' stamp='2.985'/>
<task compile_id='709' compile_kind='c2' method='Main getEl (I)LM1;' stamp='2.900'/>
<task compile_id='800' method='Main &lt;init&gt; ()V' stamp='0.058'/>
<make_not_entrant compile_id='800'/>
"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    (folder / "compiler_log_default_ren_some_bench_12.xml").write_text(LOG)
    (folder / "compiler_log_other.xml").write_text(LOG)
    return folder


@pytest.mark.parametrize("one", [False, True])
def test_event_log(spark, log, one):
    rows = eventlog.read_log(spark, str(log / "compiler_log_other.xml"), one)
    assert eventlog.vm_start_ms(rows) == 1747217577473
    main = eventlog.compilations(rows).where("method = 'Main getEl (I)LM1;'")
    assert sorted((r.time_ms, r.id, r.kind) for r in main.collect()) == [(2058, "536", "c1"), (2247, "630", "c2"), (2943, "705", "c1"), (2985, "709", "c2")]
    ends = eventlog.decompilations(rows)
    assert sorted((r.time_ms, r.id, r.kind, r.reason, r.action) for r in ends.collect()) == [(2247, "536", None, None, None), (2942, "630", None, "unstable_if", "reinterpret"), (2985, "705", None, None, None)]
    assert [(r.id, r.time_ms, r.kind) for r in eventlog.compilations(rows).where("method = 'Main <init> ()V'").collect()] == [("800", 58, None)]


def test_site_matching(spark, log):
    rows = eventlog.read_log(spark, str(log / "compiler_log_other.xml"))
    sites = spark.createDataFrame([(1, "Main getEl (I)LM1;"), (2, "in getEl (I)LM1;"), (3, "no such"), (4, "i"), (5, None)], "callsite_id long, descriptor string")
    exact = eventlog.state_events(rows, sites, 1000)
    assert {r.callsite_id for r in exact.collect()} == {1} and exact.where("tag = 'C'").agg(F.min("time_us")).first()[0] == 1_058_000
    parts = eventlog.state_events(rows, sites, 0, by_part=True)
    assert parts.where("callsite_id = 2").count() == 7 and {r.callsite_id for r in parts.collect()} == {1, 2, 4}


def test_parts_of_texts(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abc/") for _ in range(n))
    texts = [word(rnd.randint(0, 40)) for _ in range(300)] + ["common/prefix/" + word(9) for _ in range(200)]
    parts = [word(rnd.randint(1, 14)) for _ in range(200)] + ["common/prefix/", "prefix/a", "x", "zzzzzzzzzzzz", ""]
    found = eventlog.containing(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), spark.createDataFrame([(p,) for p in [*parts, *parts[:5], None]], "p string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.t, r.p) for r in found.collect()) == sorted({(t, p) for t in texts for p in parts if p in t})
    assert eventlog.containing(spark.createDataFrame([], "t string"), spark.createDataFrame([], "p string")).count() == 0


def test_top_tier_counts(spark, log):
    rows = eventlog.read_log(spark, str(log))
    assert [(r.variant, r.bench, r.n) for r in eventlog.top_tier_counts(rows).collect()] == [("default", "some_bench", 3)]


def test_traces_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 9), rnd.randint(-5, 2**31 - 1), rnd.randint(0, 2**32 - 1), t + 1) for t in range(1000)]
    paths = traces.write_traces(str(tmp_path), rows, per_file=300)
    assert len(paths) == 4
    got = traces.read_traces(spark, f"{tmp_path}/partial*").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert traces.decode_records(traces.encode_records([(1, 2, 3, 4), (0, 0, 0, 0), (5, 6, 7, 8)])).tolist() == [[1, 2, 3, 4]]
    assert traces.decode_records(b"").shape == (0, 4)


def test_dictionaries(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a/B.c()V x,1\nd,2\n")
    (tmp_path / "bad.csv").write_text("a,1\nb,1\n")
    (tmp_path / "start_time.txt").write_text("123\n456\n")
    (tmp_path / "short.txt").write_text("123\n")
    assert [tuple(r) for r in traces.read_dictionary(spark, str(tmp_path / "good.csv"), "callsite", "callsite_id").orderBy("callsite_id").collect()] == [("a/B.c()V x", 1), ("d", 2)]
    with pytest.raises(Exception, match="stands twice"):
        traces.read_dictionary(spark, str(tmp_path / "bad.csv"), "callsite", "callsite_id").collect()
    assert traces.read_start_ms(spark, str(tmp_path / "start_time.txt")) == 456 and traces.read_start_ms(spark, str(tmp_path / "short.txt")) == 0
    events = spark.createDataFrame([(7, 1, 9, 5)], traces.SCHEMA)
    classes = spark.createDataFrame([("K", 8)], "class_name string, class_id long")
    sites = traces.read_dictionary(spark, str(tmp_path / "good.csv"), "callsite", "callsite_id")
    assert traces.readable(events, sites, classes).first().value == "a/B.c()V x 7 null 5"


def test_listings(spark, tmp_path):
    head = "".join(f"head {k}\n" for k in range(7))
    (tmp_path / "bench.txt").write_text(head + "1.5 100 <Total>\n 0.5  40 a.b.C.m(int, java.lang.String)\n0.25 20 a.B.0x00a.x()\nend\n")
    rows = listings.read_cost_listing(spark, str(tmp_path / "bench.txt")).orderBy("ord").collect()
    assert [(r["exclusive cpu sec"], r["cpu cycles"], r.method_descriptor) for r in rows] == [(1.5, 100.0, "<Total>"), (0.5, 40.0, "a/b/C.m(ILjava/lang/String;)"), (0.25, 20.0, "a/B.x()")]
    assert listings.read_cost_listing(spark, str(tmp_path / "bench.txt"), limit=1).count() == 1


def test_run_files(spark, tmp_path):
    (tmp_path / "default_ren_x.txt").write_text("1.0user 0:05.25elapsed 99%\nnoise\n0:06.00elapsed\n0:01.00elapsed 0:02.00elapsed\n")
    (tmp_path / "instrumented_ren_x.txt").write_text("12:06.50elapsed\n0:07.25elapsed\n")
    got = listings.read_elapsed(spark, f"{tmp_path}/*.txt").collect()
    assert sorted((r.bench, r.variant, r.run_no, r.value) for r in got) == [("ren_x", "default", 1, 5.25), ("ren_x", "default", 2, 6.0), ("ren_x", "instrumented", 1, 726.5), ("ren_x", "instrumented", 2, 7.25)]
    (tmp_path / "normal_x.csv").write_text("".join(f"x,{k},{10 * k}\n" for k in range(150)))
    (tmp_path / "th_x.csv").write_text("x,5,6\n")
    got = listings.read_run_series(spark, f"{tmp_path}/*.csv").collect()
    normal = sorted((r.run_no, r.duration, r.uptime) for r in got if r.variant == "normal")
    assert len(normal) == 100 and normal[0] == (1, 50, 500) and [(r.bench, r.duration) for r in got if r.variant == "tweaked"] == [("x", 5)]


def test_report_lines(spark):
    r = spark.createDataFrame([(0,)], "t long").select(
        reports.compilation_line(F.col("t"), F.lit("c1"), F.lit("AAAA")),
        reports.decompilation_line(F.col("t"), F.lit("AAAA"), F.lit("c1"), F.lit("b"), F.lit("c")),
        reports.decompilation_line(F.col("t"), F.lit("AAAA"), F.lit("c1"), F.lit(None), F.lit(None)),
        reports.observation_lines(F.lit("Inversions"), F.col("t"), F.lit("ClassA: 0.000000, ClassB: 1.000000"), F.lit("ClassA: 1.000000, ClassB: 0.000000")),
        reports.observation_lines(F.lit("Changes"), F.col("t"), F.lit("x"), F.lit("y")),
    ).first()
    assert r[0] == "Compilation at: 0 [kind = c1, id = AAAA]"
    assert r[1] == "Decompilation at: 0[compile_id = AAAA, compile_kind = c1][trap: reason = b, action = c]"
    assert r[2] == "Decompilation at: 0[compile_id = AAAA, compile_kind = c1]"
    assert r[3] == ["windows: 0 - 1", "    First Window: ClassA: 0.000000, ClassB: 1.000000", "    Second Window: ClassA: 1.000000, ClassB: 0.000000"]
    assert r[4][0] == "window before: 0 - window after: 1"


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "4000b")
    spark.conf.set(names[1], "1b")
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_of_splits(small_splits, tmp_path):
    spark = small_splits
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(5000)))
    (tmp_path / "b.txt").write_text("one\r\ntwo")
    (tmp_path / "c.txt").write_text("")
    rows = lines.numbered_lines(spark, str(tmp_path))
    got = rows.collect()
    assert sorted((r.ord, r.line, r.lines) for r in got if r.file == "a.txt") == [(k, str(k), 5000) for k in range(5000)]
    assert sorted((r.ord, r.line) for r in got if r.file == "b.txt") == [(0, "one"), (1, "two")] and len(got) == 5002
    assert rows.select("split").where("file = 'a.txt'").distinct().count() > 4
    kept = lines.numbered_lines(spark, str(tmp_path / "a.txt"), F.col("line").endswith("7")).collect()
    assert sorted((r.ord, r.line, r.lines) for r in kept) == [(k, str(10 * k + 7), 500) for k in range(500)]
    assert [r.line for r in lines.read_lines(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == [str(k) for k in range(5000)]
    parts = spark.createDataFrame([(k, f"v{k}") for k in range(900)], "k long, value string")
    scratch.write_ordered(parts.repartition(5), str(tmp_path / "parts"), "k")
    assert [r.line for r in lines.read_lines(spark, str(tmp_path / "parts"), one=True).orderBy("ord").collect()] == [f"v{k}" for k in range(900)]


def test_files_cut_otherwise_are_noticed(spark):
    rows = spark.createDataFrame([("p", 0, "x"), ("p", 9, "y")], "path string, split int, line string")
    with pytest.raises(Exception, match="split otherwise"):
        lines.beside(rows, spark.createDataFrame([("p", 0, 1)], "path string, split int, n int"), "n").collect()


def test_a_large_report_is_read_in_splits(small_splits, tmp_path):
    spark, rnd, text = small_splits, random.Random(4), []
    for g in range(60):
        text.append(f"CCU [callsite=site {g}, compile_id={g % 3}]")
        for section in rnd.sample(["Changes", "Inversions", "RawWindowInformation"], rnd.randint(1, 3)):
            text.append(f"    {section}[start time = {g}, window size = 1000]:")
            for k in range(rnd.randint(0, 60)):
                kind = rnd.randrange(4)
                if kind == 0:
                    text.append(f"        Compilation at: {k} [kind = c2, id = {k}]")
                elif kind == 1:
                    text.append(f"        Decompilation at: {k}[compile_id = {k}, compile_kind = null][trap: reason = r, action = null]")
                elif section == "RawWindowInformation":
                    text += [f"        window information for window: {k}", f"            A{k}: 0.5, B: 0.5"]
                else:
                    text += [f"        windows: {k} - {k + 1}", f"            First Window: A{k}: 0.5, B: 0.5", f"            Second Window: A{k}: 1.0"]
    (tmp_path / "r.txt").write_text("\n".join(text) + "\n")
    whole = spark.createDataFrame([("r.txt", k, line) for k, line in enumerate(text)], "file string, ord long, line string")
    want = reports.parse_report(whole).orderBy("ord").collect()
    numbered = lines.numbered_lines(spark, str(tmp_path / "r.txt"))
    assert numbered.select("split").distinct().count() > 15
    got = reports.read_report(spark, str(tmp_path / "r.txt")).orderBy("ord").collect()
    assert got == want and len(want) > 1000 and any(r.second for r in want)


def workload(tmp_path):
    """A group whose mix of two categories turns over, with compilations before and after."""
    events = []
    for i in range(20_000):
        other = i % 10 > 7 if i < 10_000 else i % 10 > 3
        events.append((3, 1, 2 if other else 1, 1 + i * 10))
    traces.write_traces(str(tmp_path / "in"), events, per_file=6000)
    (tmp_path / "in" / "callsite_to_id.csv").write_text("30 Main.getEl(I)LM1; call.x()V,1\n")
    (tmp_path / "in" / "classNameMapping.csv").write_text("M1,1\nM2,2\n")
    (tmp_path / "in" / "start_time.txt").write_text("1\n1747217579473\n")
    (tmp_path / "log.xml").write_text(LOG)
    (tmp_path / "hot.csv").write_text("exclusive cpu sec,cpu cycles,method_descriptor\n1.5,200,Main.getEl(I)\n9.9,999,Main.getEl(I)\n")


def test_digest_and_analysis(spark, tmp_path):
    from eventloom.__main__ import parser

    workload(tmp_path)
    run = lambda *argv: (lambda a: a.run(spark, a))(parser().parse_args([str(x) for x in argv]))
    run("digest", "-i", tmp_path / "in", "-c", tmp_path / "log.xml", "-d", 10_000, "-o", tmp_path / "out")
    rows = spark.read.parquet(str(tmp_path / "out" / "timelines"))
    inversions = rows.where("section = 'Inversions' and tag = 'W'").collect()
    assert len(inversions) == 1
    (one,) = inversions
    assert (one.first, one.second, one.step) == ("M1: 0.800000, M2: 0.200000", "M1: 0.400000, M2: 0.600000", 9)
    text = next((tmp_path / "out" / "report" / "bucket=001").glob("*.txt")).read_text()
    assert "CCU [callsite=30 Main.getEl(I)LM1; call.x()V, compile_id=3]" in text and "windows: 9 - 10" in text and "[trap: reason = unstable_if, action = reinterpret]" not in text
    from eventloom.plans import digest as plan

    (tmp_path / "skip.lst").write_text("Other.*\nMain.get*\n")
    run("digest", "-i", tmp_path / "in", "-c", tmp_path / "log.xml", "-d", 10_000, "-o", tmp_path / "none", "--exclude", tmp_path / "skip.lst")
    assert not list((tmp_path / "none" / "timelines").glob("section=*"))
    progress = plan.Progress()
    made = plan.digest(spark, str(tmp_path / "in"), str(tmp_path / "log.xml"), 10_000, progress=progress)
    n = len(made.rows.collect())
    assert progress.counts()["timeline rows"] == n and progress.counts()["records"] > 0
    back = reports.read_report(spark, str(tmp_path / "out" / "report" / "*" / "*.txt"))
    count = lambda df: {(r.section, r.tag): r["count"] for r in df.groupBy("section", "tag").count().collect()}
    assert count(back) == count(rows)
    run("analyse", "-i", tmp_path / "out", "-o", tmp_path / "stats", "--hotness", tmp_path / "hot.csv", "--name", "w")
    stat = spark.read.csv(str(tmp_path / "stats" / "w" / "w_statistics"), header=True).first()
    assert stat.method_descriptor == "Main.getEl(I)" and stat.inversion_pairs == "1" and stat.inversions_after_compilation == "1" and stat.most_frequent_inversion == "M1 - M2 -> M2 - M1"
    cost = spark.read.csv(str(tmp_path / "stats" / "w" / "w_normalized"), header=True).first()
    assert cost["cpu cycles"] == "200.0" and float(cost.normalized_inversions_after_compilation) == 1 / 200
    reduction = spark.read.json(str(tmp_path / "stats" / "w" / "reduction")).first()
    assert json.loads(reduction.json)["interpreter - before"] == 0
    run("dump", "-f", tmp_path / "in", "-i", tmp_path / "in" / "callsite_to_id.csv", "-k", tmp_path / "in" / "classNameMapping.csv", "-o", tmp_path / "readable")
    assert spark.read.text(str(tmp_path / "readable")).count() == 20_000


def test_run_tools(spark, tmp_path):
    from eventloom.__main__ import parser

    run = lambda *argv: (lambda a: a.run(spark, a))(parser().parse_args([str(x) for x in argv]))
    rnd = random.Random(3)
    for variant, shift in (("default", 0), ("instrumented", 3)):
        (tmp_path / f"{variant}_ren_x.txt").write_text("".join(f"0:{10 + shift + rnd.randint(0, 9)}.{rnd.randint(10, 99)}elapsed\n" for _ in range(12)))
        (tmp_path / f"{'normal' if shift == 0 else 'th'}_x.csv").write_text("".join(f"a,{100 + 9 * shift + rnd.randint(0, 9)},{k}\n" for k in range(120)))
    run("overhead", "-i", tmp_path, "-o", tmp_path / "o")
    row = spark.read.csv(str(tmp_path / "o" / "overhead"), header=True).first()
    assert row.bench == "ren_x" and float(row.geometric_ratio) > 1 and 0 <= float(row.p_value) <= 1
    assert "Cohen d: -" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "o" / "overhead_text")).collect())
    run("steady-state", "-i", tmp_path, "-o", tmp_path / "none", "--exclude", "x")
    assert not [r for f in (tmp_path / "none" / "statistics").glob("*.csv") for r in f.read_text().splitlines()[1:]]
    run("steady-state", "-i", tmp_path, "-o", tmp_path / "s")
    row = spark.read.csv(str(tmp_path / "s" / "statistics_sig"), header=True).first()
    assert row.bench == "x" and float(row.duration_p_value) < 1e-6 and float(row.duration_percent_difference) < 0
    (tmp_path / "compiler_log_default_ren_b_1.xml").write_text(LOG)
    run("log-compare", "-i", tmp_path, "-o", tmp_path / "c")
    assert spark.read.text(str(tmp_path / "c" / "normal")).first().value == "b - 3"
    (tmp_path / "hot").mkdir()
    (tmp_path / "hot" / "b.txt").write_text("h\n" * 7 + "1 2 a.B.c()\nend\n")
    run("hot-methods", "-i", tmp_path / "hot", "-o", tmp_path / "h")
    assert spark.read.csv(str(tmp_path / "h" / "hot_methods"), header=True).first().method_descriptor == "a/B.c()"


@pytest.mark.parametrize("settings", [{"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}])
def test_lines_of_a_report_stay_together(spark, tmp_path, settings):
    """However many partitions the lines come in, a group is written into one file, its headings first."""
    from eventloom.plans import catalogue

    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        reports.write_report(reports.report_lines(catalogue._sections(spark, "/root/testdata/sf0.001"), catalogue.DELTA), str(tmp_path / "report"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = [f.read_text().splitlines() for f in (tmp_path / "report").glob("*/*.txt")]
    titles = [line for text in texts for line in text if line.startswith("CCU")]
    assert len(titles) == len(set(titles)) == 30
    for text in texts:
        assert text[0].startswith("CCU")
        assert all(b.startswith(("    Changes[", "    Inversions[")) for a, b in zip(text, text[1:] + [""]) if a.startswith("CCU"))


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A log of one id, under which 60 methods were compiled and 50 ends are."""
    folder = tmp_path_factory.mktemp("crowded")
    made = [f"<nmethod compile_id='7' compiler='c1' method='M{k} run ()V' stamp='1.{k:03d}'/>" for k in range(60)]
    ends = [f"<make_not_entrant compile_id='7' stamp='2.{k:03d}'/>" for k in range(50)]
    (folder / "log.xml").write_text("\n".join(made + ends) + "\n")
    return eventlog.read_log(spark, str(folder))


def spread(rows):
    """How many rows, and how many tasks make them."""
    return rows.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.countDistinct("task")).first()


def test_ends_of_one_id_are_spread(crowded, monkeypatch):
    monkeypatch.setattr(joins, "JOINED", 10)
    rows, tasks = spread(eventlog.decompilations(crowded))
    assert rows == 3000 and tasks > 2


def test_ends_of_sites_by_part_are_spread(spark, crowded, monkeypatch):
    monkeypatch.setattr(joins, "JOINED", 10)
    sites = spark.createDataFrame([(1, "run ()"), (2, "9 run"), (3, "none")], "callsite_id long, descriptor string")
    rows = eventlog.state_events(crowded, sites, 0, by_part=True).where("tag = 'D'")
    assert {tuple(r) for r in rows.groupBy("callsite_id").count().collect()} == {(1, 3000), (2, 300)}
    assert spread(rows)[1] > 2


def test_ends_of_sites_are_spread(spark, crowded, monkeypatch):
    monkeypatch.setattr(joins, "JOINED", 10)
    sites = spark.createDataFrame([(k, f"M{k} run ()V") for k in range(40)], "callsite_id long, descriptor string")
    rows, tasks = spread(eventlog.state_events(crowded, sites, 0).where("tag = 'D'"))
    assert rows == 2000 and tasks > 2


def test_series_are_written_by_several_tasks(spark, tmp_path):
    """The lines of one name are dealt to several tasks and files, and come back in their order."""
    rows = spark.range(3000).selectExpr("'normal_s1.csv' as name", "id as at", "concat('x,', id, ',', 2 * id) as value")
    folder = scratch.write_series(rows, str(tmp_path / "series"), "at")
    assert len(list((tmp_path / "series").glob("normal_s1.*"))) > 2
    got = sorted(tuple(r) for r in listings.read_run_series(spark, folder).collect())
    assert got == [("s1", "normal", k + 1, 2900 + k, 2 * (2900 + k)) for k in range(100)]
    few = sorted(tuple(r) for r in listings.read_run_series(spark, folder, 1000).select("run_no", "duration").collect())
    assert few == [(k + 1, 2000 + k) for k in range(1000)]


def test_elapsed_of_a_large_series_keeps_its_order(spark, tmp_path):
    rows = spark.range(2000).selectExpr("'default_ren_s1.txt' as name", "id as at", "format_string('1.0user %d:%02d.25elapsed 99%%', id div 60, id % 60) as value")
    folder = scratch.write_series(rows, str(tmp_path / "elapsed"), "at")
    assert len(list((tmp_path / "elapsed").glob("default_ren_s1.*"))) > 2
    got = sorted(tuple(r) for r in listings.read_elapsed(spark, folder).collect())
    assert got == [("ren_s1", "default", k + 1, k + 0.25) for k in range(2000)]


def test_a_log_is_parsed_once(crowded):
    """What is made of a log reads its entries, not the text anew for each kind of them."""
    sites = crowded.sparkSession.createDataFrame([(1, "M1 run ()V")], "callsite_id long, descriptor string")
    for rows in (eventlog.compilations(crowded), eventlog.decompilations(crowded), eventlog.state_events(crowded, sites, 0), eventlog.state_events(crowded, sites, 0, by_part=True)):
        assert "FileScan text" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["log_site_events", "log_site_events_by_part"])
def test_a_log_is_removed_once_it_is_parsed(spark, tmp_path, monkeypatch, name):
    """The log's text is most of what lies on disk, and is not kept until the result is read."""
    from eventloom.plans import file_catalogue

    monkeypatch.setattr(file_catalogue, "scratch_folder", lambda spark, name: str(tmp_path / name))
    file_catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not (tmp_path / "log").exists()


def test_lines_of_a_series_are_bounded_a_task_and_not_shuffled(spark, tmp_path, monkeypatch):
    """A large series is written by more tasks than shuffles have, and its kept lines are numbered where they are read."""
    rows = spark.range(3000).selectExpr("'default_ren_s1.txt' as name", "id as at", "if(id % 3 = 0, 'other', format_string('1.0user %d:%02d.25elapsed 99%%', id div 60, id % 60)) as value")
    monkeypatch.setattr(scratch, "SERIES_ROWS", 100)
    folder = scratch.write_series(rows, str(tmp_path / "bounded"), "at")
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "bounded").glob("default_ren_s1.*")]
    assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 300
    got = listings.read_elapsed(spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == [("ren_s1", "default", n + 1, k + 0.25) for n, k in enumerate(k for k in range(3000) if k % 3)]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
