import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import stats
from eventloom.operators.quantiles import ordered_values, quantiles

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.9999, "f": 1.0}


def same(row, values):
    want = np.quantile(np.array(values, float), list(SHARES.values()))
    return np.allclose([row[k] for k in SHARES], want, rtol=1e-12, atol=0)


def test_a_million_different_values_in_one_group(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 7.0).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("few", float(k)) for k in range(5)] + [("one", 3.0), ("none", None), ("none", float("nan"))], "g string, v double"))
    got = {r.g: r for r in quantiles(rows, ["g"], "v", SHARES).collect()}
    values = [k * 7919 % 1_000_003 / 7.0 for k in range(1_000_000)]
    assert set(got) == {"hot", "few", "one"} and got["hot"].n == 1_000_000
    assert same(got["hot"], values) and same(got["few"], range(5)) and same(got["one"], [3.0])


@pytest.mark.parametrize("bins, few", [(2, 1), (8, 3), (4096, 10_000)])
def test_values_of_every_kind(spark, bins, few):
    rng = np.random.default_rng(3)
    groups = {
        "ties": rng.integers(0, 4, 300).astype(float),
        "wide": np.exp(rng.normal(0, 200, 200)),
        "signs": np.concatenate([[-0.0, 0.0, 0.0], rng.normal(0, 1, 101)]),
        "tiny": np.array([5e-324, 1e-323, 1.0, 1e308, 1.7e308, -1.7e308]),
        None: rng.normal(5, 1, 77),
    }
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles(rows, ["g"], "v", {k: p for k, p in SHARES.items()}, bins, few).collect()}
    for g, v in groups.items():
        if g != "tiny":  # between its values the differences are no finite numbers
            assert same(got[g], v), g
    exact = ordered_values(rows, ["g"], "v", F.sequence(F.lit(0), F.col("n").cast("int") - 1), bins, few)
    for g, v in groups.items():
        assert [r.v for r in exact.where(F.col("g").eqNullSafe(g)).orderBy("rank").collect()] == sorted(v.tolist())


def test_infinite_values(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(1, x) for x in [-inf, -inf, 1.0, 2.0, 3.0, inf]], "g int, v double")
    got = ordered_values(rows, ["g"], "v", F.sequence(F.lit(0), F.lit(5)), 4, 1).orderBy("rank").collect()
    assert [r.v for r in got] == [-inf, -inf, 1.0, 2.0, 3.0, inf]
    assert quantiles(rows.limit(0), ["g"], "v", SHARES).count() == 0


def test_outliers_are_the_points_beyond_the_whiskers(spark):
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate([-5, 1, 2, 3, 4, 100, float("nan")])], "id int, v double")
    assert [(r.id, r.v, r["median"]) for r in stats.outliers(rows, [], "v").collect()] == [(5, 100.0, 3.0)]
    assert stats.box(rows, [], "v").first().outliers == 1
