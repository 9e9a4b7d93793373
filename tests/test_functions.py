import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import bits, descriptors, text
from eventloom.functions.distributions import erfc, log_gamma, signed_rank_p_value, student_p_value
from eventloom.operators import windows


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


def test_descriptors(spark):
    r = one(spark, "30 java/io/PrintStream.write([BII)V implWrite([BII)V", descriptors.method_descriptor(F.col("v")), descriptors.method_name(F.col("v")))
    assert r[0] == "java.io.PrintStream write ([BII)V" and r[1] == "java/io/PrintStream.write([BII)"


@pytest.mark.parametrize(
    "name,want,bare",
    [
        ("net.a.Lz.compress64k(byte[], int, int, byte[], int, int)", "net/a/Lz.compress64k([BII[BII)", None),
        ("a.B.c(java.lang.String[][], boolean)", "a/B.c([[Ljava/lang/String;Z)", None),
        ("a.B.none()", "a/B.none()", "a/B.none(L;)"),
        ("<Total>", "<Total>", None),
        ("<static>@0x1", "<static>@0x1", None),
        ("std::sort(int)", "std::sort(int)", None),
        ("plain", "plain", None),
    ],
)
def test_hot_descriptor(spark, name, want, bare):
    r = one(spark, name, descriptors.hot_descriptor(F.col("v")), descriptors.hot_descriptor(F.col("v"), True))
    assert r[0] == want and r[1] == (bare or want)


def test_log_values(spark):
    line = "<make_not_entrant compile_id='536' compile_kind='c2' stamp='0.058'/>"
    r = one(spark, line, text.attribute(F.col("v"), "compile_id"), text.attribute(F.col("v"), "reason"), text.stamp_ms(text.attribute(F.col("v"), "stamp")))
    assert tuple(r) == ("536", None, 58)


@pytest.mark.parametrize("line,seconds,short", [("1.0user 0:05.25elapsed", 5.25, 5.25), ("10:23.45elapsed", 623.45, 23.45), ("1:02:03elapsed", 3723.0, None)])
def test_elapsed(spark, line, seconds, short):
    assert one(spark, line, text.elapsed_seconds(F.col("v")))[0] == pytest.approx(seconds)
    if short is not None:
        assert one(spark, line, text.elapsed_seconds(F.col("v"), True))[0] == pytest.approx(short)


def test_bits(spark):
    rows = [(5, 7), (-3, 4294967295), (2147483647, 0)]
    packed = bits.pack(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "a long, b long").select(bits.high(packed), bits.low(packed)).collect()
    assert [tuple(r) for r in got] == rows


@pytest.mark.parametrize("a,b,want", [("ABCD", "ABCD", True), ("ABCD", "ABDC", False), ("ABCD", "ABD", False), ("ABCD", "AB", True), ("AB", "BA", False), ("AB", "A", True), ("AB", "B", False), ("", "A", True)])
def test_prefix_ranking(spark, a, b, want):
    row = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>").select(windows.prefix_compatible(F.col("a"), F.col("b")), windows.prefix_compatible(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (want, want)


def test_thresholds_are_doubles(spark):
    rows = [([("x", 0.6), ("y", 0.4)], [("x", 0.5), ("y", 0.5)]), ([("x", 0.8), ("y", 0.2)], [("x", 0.7), ("y", 0.3)])]
    kind = "array<struct<name:string,ratio:double>>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select(windows.share_moved(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [any(abs(p - q) > 0.1 for (_, p), (_, q) in zip(a, b)) for a, b in rows]
    assert [r[0] for r in got] == [False, True]


def density_sum(t, n):
    """The two-sided tail by summing Student's density up to t."""
    v, steps = n - 1, 20_000
    f = lambda x: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    h = abs(t) / steps
    return 1 - 2 * h / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * f(k * h) for k in range(steps + 1))


def test_p_values(spark):
    nan, inf = float("nan"), float("inf")
    ts = [(2.228, 11), (12.706, 2), (0.0, 30), (1.96, 100_000), (-0.01, 3), (5.5, 4), (0.7, 1000), (-3.2, 57), (9.0, 200)]
    rows = spark.createDataFrame([*ts, (nan, 5), (None, 5), (1.0, 1), (inf, 9)], "t double, n int").select("t", "n", student_p_value(F.col("t"), F.col("n")).alias("p")).collect()
    for r in rows[: len(ts)]:
        assert r.p == pytest.approx(density_sum(r.t, r.n), abs=1e-9)
    assert rows[0].p == pytest.approx(0.05, abs=2e-4) and rows[3].p == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-4)
    assert [math.isnan(r.p) for r in rows[len(ts) :]] == [True, True, True, False] and rows[-1].p == 0.0
    tail = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.0, 1.999, 2.0, 3.0, 6.0, 20.0)], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-13) for r in tail)
    assert all(r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.5, 400.0, 1e6)], "x double").select("x", log_gamma(F.col("x")).alias("y")).collect())
    ranks = spark.createDataFrame([(0.0, 5, 0.0), (8.0, 10, 0.0), (100 * 101 / 4, 100, 0.0), (3.0, 0, 0.0), (20.0, 12, 6.0), (1.0, 1, 0.0)], "w double, n int, t double").select(signed_rank_p_value(F.col("w"), F.col("n"), F.col("t")).alias("p")).collect()
    assert ranks[0].p == pytest.approx(2 / 32) and ranks[1].p == pytest.approx(0.048828125) and ranks[2].p == pytest.approx(1.0) and math.isnan(ranks[3].p) and ranks[5].p == 1.0
    assert ranks[4].p == pytest.approx(math.erfc(abs(20 - 39) / math.sqrt(12 * 13 * 25 / 24 - 6 / 48) / math.sqrt(2)))
    # by all sign patterns
    for n in (3, 7):
        sums = [sum(k for k in range(1, n + 1) if bits >> k - 1 & 1) for bits in range(2**n)]
        for w in range(n * (n + 1) // 4 + 1):
            p = spark.range(1).select(signed_rank_p_value(F.lit(float(w)), F.lit(n), F.lit(0.0)).alias("p")).first().p
            assert p == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_scopes(spark):
    import fnmatch

    from eventloom.functions import scopes

    patterns = ["a.b.*.*", "a.b.C.*", "x.Y.*", "x.Y", "*.Internal*", " ", "one+two"]
    names = ["a.b.C.m", "a.b.c.D.m", "a.b.m", "x.Y", "x.Y.m", "x.Yz.m", "q.InternalThing.m", "one+two", "oneetwo", "a.bC.d.e", ""]
    want = [n for n in names if not any(fnmatch.fnmatchcase(n, p.strip()) for p in patterns if p.strip())]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    assert [r.name for r in scopes.exclude(rows, patterns, F.col("name")).collect()] == [*want, None]
    assert scopes.exclude(rows, [], F.col("name")).count() == 12 and scopes.expression(["a.b", "a.c"]) == r"^a\.(?:b|c)$"
    assert spark.range(1).select(scopes.scope_of(F.lit("a/b/C.m(I)V"))).first()[0] == "a.b.C.m"
