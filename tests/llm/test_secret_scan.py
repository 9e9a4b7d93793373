import hashlib
import random
import re

from pyspark.sql import functions as F

from eventloom.llm.secret_scan import BASE_RULES, RULES, Rule, _fetched, blob_name, digest, keep_ledger, read_ledger, redact, scan

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute(text):
    spans = []
    for order, (kind, pattern, ok) in enumerate(KINDS):
        spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if ok(m)]
    return ",".join(x[2] for x in sorted(spans))


def texts():
    rnd = random.Random(2)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", ":", "=", " ", "  ", '"', "'", "abcdefghijkl", "deadbeefdeadbeef", "0123456789abcdef0", "AKIA", "ABCDEFGHIJKLMN", "é", "\U0001f600", "\n", "x.y-z", "A1", "/+="]
    return ["", None, "token: password: abcdefghijklmnop", "token=secret=abcdefghijklmnop", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(600))]


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] * 2
    out, _ = scan(spark.createDataFrame(rows, "doc_id long, text string, spans string"), rules=BASE_RULES)
    got = out.select("doc_id", digest(F.col("spans")).alias("d")).collect()
    want = {i: brute(t) for i, t, _ in rows}
    assert len(got) == len(rows) and all(want[r.doc_id] == r.d for r in got)
    assert sum(map(bool, want.values())) > 200


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([(1, "token=abcdefghijklmnop"), (2, "none")], "doc_id long, text string")
    _, ledger = scan(first)
    ledger = ledger.cache()
    assert ledger.count() == 2
    # a rule of the same version isn't asked again: a changed pattern without a new version finds nothing new
    same = tuple(Rule(r.name, r.version, "none", "none") for r in RULES)
    both = first.union(spark.createDataFrame([(3, "none"), (4, "nonenone")], "doc_id long, text string"))
    out, grown = scan(both, ledger, same)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in out.collect()}
    assert got[1] == [("assign", 0, 22)] and got[2] == [] and got[3] == [] and len(got[4]) == 2 * len(RULES)
    assert grown.count() == 3
    # a new version is
    newer = (Rule("assign", 2, "none", "none"), *same[1:])
    out, _ = scan(both, ledger, newer)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in out.collect()}
    assert got[1] == [] and got[2] == [("assign", 0, 4)]


def test_extra_kinds_and_redaction(spark):
    text = "é key -----BEGIN RSA PRIVATE KEY----- and ghp_" + "a1" * 18 + " password='deadbeefdeadbeef00' end"
    out, _ = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = out.select(digest(F.col("spans")).alias("d"), redact(F.col("text"), F.col("spans")).alias("r")).first()
    assert [x.split(":")[0] for x in row.d.split(",")] == ["pem", "prefixed", "hex", "assign", "hex"]
    assert "deadbeef" not in row.r and row.r.startswith("é key [pem] and [") and row.r.endswith(" end")


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out, ledger = scan(empty)
    assert out.count() == 0 and ledger.count() == 0 and scan(empty, ledger)[1].count() == 0


def test_digest_of_nothing(spark):
    out, _ = scan(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert out.select(F.sha2(digest(F.col("spans")), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_seen_text_is_not_fetched(spark):
    blobs = spark.range(5000).selectExpr("concat('text ', id % 2500) text").select(blob_name(F.col("text")).alias("blob"), "text")
    wanted = blobs.where("text in ('text 1', 'text 77', 'text 2499')").select("blob").distinct()
    got = _fetched(blobs, wanted)
    assert {"text 1", "text 77", "text 2499"} <= {r.text for r in got.collect()} and got.count() < 20
    assert _fetched(blobs, wanted.limit(0)).count() == 0


def test_two_deliveries_equal_one(spark):
    rows = [(i, t) for i, t in enumerate(texts())] * 2
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    once, ledger = scan(whole)
    _, first = scan(whole.where("doc_id < 200"))
    twice, both = scan(whole, first)
    show = lambda x: sorted((r.doc_id, str(r.spans)) for r in x.select("doc_id", "spans").collect())
    assert show(once) == show(twice) and sorted(map(str, ledger.collect())) == sorted(map(str, both.collect()))


def test_very_long_text_and_names_that_differ_in_case(spark):
    text = "x " * 500_000 + "token=abcdefghijklmnop"
    out, _ = scan(spark.createDataFrame([(1, text, 5, 6)], "doc_id long, text string, Spans int, BLOB int"))
    row = out.first()
    assert out.columns == ["doc_id", "text", "blob", "spans"] and [(s.kind, s.start, s.end) for s in row.spans] == [("assign", 1_000_000, 1_000_022)]


def test_a_ledger_outlives_its_session(spark, tmp_path):
    import pathlib
    import subprocess
    import sys

    path = f"file://{tmp_path}/ledger"
    assert read_ledger(spark, path) is None
    code = (
        "from pyspark.sql import SparkSession; from eventloom.llm.secret_scan import keep_ledger, scan; "
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        f"keep_ledger(scan(s.createDataFrame([(1, 'token=abcdefghijklmnop'), (2, 'none')], 'doc_id long, text string'))[1], '{path}')"
    )
    subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[2], check=True, timeout=300, capture_output=True)
    ledger = read_ledger(spark, path)
    # rules that find nothing: what was seen is taken from the ledger, and only the new text is asked
    same = tuple(Rule(r.name, r.version, "fresh", "fresh") for r in RULES)
    out, grown = scan(spark.createDataFrame([(1, "token=abcdefghijklmnop"), (3, "fresh")], "doc_id long, text string"), ledger, same)
    got = {r.doc_id: len(r.spans) for r in out.collect()}
    assert got == {1: 1, 3: len(RULES)}
    keep_ledger(grown, path)
    (tmp_path / "ledger" / "00000007").mkdir()  # one that was stopped
    assert read_ledger(spark, path).count() == 3
