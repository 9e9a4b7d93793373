"""Two-sided p-values of paired tests, as expressions of their statistics. Each is a loop of a fixed number of steps over one row a group."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fractions and series; they settle long before at the arguments given to them.
STEPS = 300
#: Differences up to which, without ties, the signed-rank distribution is counted out.
EXACT = 50
_TINY = 1e-300


def _double(c: Column) -> Column:
    return c.cast("double")


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of these values, each worked out once however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _log_gamma(x: Column) -> Column:
    z, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    series, power = F.lit(0.0), 1 / z
    for c in (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188):
        series, power = series + c * power, power / (z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight places further on."""
    return _let({"x": x}, lambda s: _log_gamma(s["x"]))


def _fraction(first: Column, c: float, step: Callable[[Column], tuple[Column, Column]]) -> Column:
    """A continued fraction by Lentz's method: 1 / (first + a1 / (b1 + a2 / (b2 + ...))), with the pair (a, b) of each step.

    ``c`` is the ratio of the numerators before the first step: beyond all bounds, or 1 where ``first`` is 1 + a0 already.
    """

    def advance(s: Column, m: Column) -> Column:
        a, b = step(_double(m))
        # a number too small to matter keeps what is divided by from being 0
        next_ = F.struct((b + a / s["c"] + _TINY).alias("c"), (1 / (b + a * s["d"] + _TINY)).alias("d"), s["h"].alias("h"))
        return _let({"n": next_}, lambda x: F.struct(x["n"]["c"].alias("c"), x["n"]["d"].alias("d"), (x["n"]["h"] * x["n"]["c"] * x["n"]["d"]).alias("h")))

    begin = 1 / (first + _TINY)
    start = F.struct(F.lit(c).alias("c"), begin.alias("d"), begin.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, advance, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; on the side where the fraction settles."""

    def side(s: Column) -> Column:
        far = s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2)
        turned = F.struct(F.lit(True).alias("far"), s["b"].alias("p"), s["a"].alias("q"), (1 - s["x"]).alias("y"))
        return F.when(far, turned).otherwise(F.struct(F.lit(False).alias("far"), s["a"].alias("p"), s["b"].alias("q"), s["x"].alias("y")))

    def value(s: Column) -> Column:
        p, q, y = s["v"]["p"], s["v"]["q"], s["v"]["y"]

        def step(k: Column) -> tuple[Column, Column]:
            m = F.floor(k / 2)
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd), F.lit(1.0)

        # steps are counted from 1: the 0th, an odd one, is in the beginning
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) / p
        part = front * _fraction(1 - (p + q) * y / (p + 1), 1.0, lambda k: step(k + 1))
        return _let({"part": part}, lambda r: F.when(s["v"]["far"], 1 - r["part"]).otherwise(r["part"]))

    def whole(s: Column) -> Column:
        inside = _let({"v": side(s)}, value)
        return F.when(s["x"] <= 0, F.lit(0.0)).when(s["x"] >= 1, F.lit(1.0)).otherwise(inside)

    return _let({"a": _double(a), "b": _double(b), "x": x}, whole)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: the series of the error function near 0, a continued fraction beyond."""

    def whole(s: Column) -> Column:
        y = s["x"]
        term = lambda r, k: F.struct((-r["t"] * y * y / k).alias("t"), (r["sum"] - r["t"] * y * y / k / (2 * k + 1)).alias("sum"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(y.alias("t"), y.alias("sum")), lambda r, k: term(r, _double(k)), lambda r: r["sum"])
        tail = F.exp(-y * y) / math.sqrt(math.pi) * _fraction(y, 1 / _TINY, lambda m: (m / 2, y))
        return F.when(y < 2, 1 - 2 / math.sqrt(math.pi) * series).otherwise(tail)

    return _let({"x": x}, whole)


def student_p_value(t: Column, n: Column) -> Column:
    """Chance of a t value at least as far from 0, for ``n`` pairs; NaN for fewer than two or no t."""
    v = _double(n) - 1
    p = F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)))
    return F.when(t.isNull() | n.isNull() | F.isnan(t) | (n < 2), F.lit(float("nan"))).otherwise(p)


def rank_sums(n: Column) -> Column:
    """Of all sign patterns of ranks 1 to n, how many give each sum of positive ranks, from 0."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), lambda counts, k: F.zip_with(F.concat(counts, zeros(k)), F.concat(zeros(k), counts), lambda a, b: a + b))


def signed_rank_p_value(w: Column, n: Column, ties: Column) -> Column:
    """Chance of a signed-rank statistic as small as ``w`` (the lesser sum), for n non-zero differences.

    Exact up to ``EXACT`` differences without ties, by the normal limit otherwise; ``ties`` is the sum of
    t^3 - t over groups of t equal differences. NaN without differences.
    """
    n, w, ties = _double(n), _double(w), F.coalesce(_double(ties), F.lit(0.0))
    few = (n <= EXACT) & (ties == 0)
    counts = F.slice(rank_sums(F.greatest(F.least(n, F.lit(float(EXACT))), F.lit(1.0)).cast("int")), F.lit(1), (F.floor(w) + 1).cast("int"))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) / F.pow(F.lit(2.0), n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    normal = F.when(variance > 0, erfc(F.abs(w - n * (n + 1) / 4) / F.sqrt(variance) / math.sqrt(2))).otherwise(F.lit(float("nan")))
    return F.when(w.isNull() | n.isNull() | (n == 0), F.lit(float("nan"))).when(few, exact).otherwise(normal)
