"""Tails of the normal and of Student's distribution as column expressions, good to about ten digits."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ln_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series eight steps up, and back down."""
    up = x + 8
    series = (up - 0.5) * F.log(up) - up + 0.5 * log(2 * pi) + 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3))) + 1 / (1260 * F.pow(up, F.lit(5))) - 1 / (1680 * F.pow(up, F.lit(7)))
    down = x
    for k in range(1, 8):
        down = down * (x + k)
    return series - F.log(down)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0: a power series below 2, above it the continued fraction from its far end."""

    def small(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))
        step = lambda s, n: _let(-s["term"] * v * v / n, lambda t: F.struct(t.alias("term"), (s["sum"] + t / (2 * n + 1)).alias("sum")))
        return 1 - 2 / pi**0.5 * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: s["sum"])

    def large(v: Column) -> Column:
        far = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), v, lambda s, n: v + n / 2 / s)
        return F.exp(-v * v) / pi**0.5 / far

    return F.when(x < 2, small(x)).otherwise(large(F.greatest(x, F.lit(2.0))))


def normal_p(z: Column) -> Column:
    """How likely a standard normal value is at least so far from 0, on either side."""
    return erfc(F.abs(z) / 2**0.5)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)

    def turn(s: Column, k: Column) -> Column:
        d, c = 1 / safe(1 + k * s["d"]), safe(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return _let(turn(s, even), lambda t: turn(t, odd))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and x within 0 and 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(F.greatest(x, F.lit(TINY))) + b * F.log(F.greatest(1 - x, F.lit(TINY))))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_p(t: Column, df: Column) -> Column:
    """How likely a value of Student's distribution with ``df`` degrees of freedom is at least so far from 0, on either side."""
    return beta_share(df / 2, F.lit(0.5), df / (df + t * t))


def t_quantile(two_sided: float, df: Column) -> Column:
    """The value that is exceeded, on either side, with probability ``two_sided``; by halving, between 0 and 2^20. Null without degrees of freedom."""

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return _let(t_p(middle, df) > two_sided, lambda far: F.struct(F.when(far, middle).otherwise(s["low"]).alias("low"), F.when(far, s["high"]).otherwise(middle).alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(float(1 << 20)).alias("high"))
    return F.when(df > 0, F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: (s["low"] + s["high"]) / 2))


#: Upper limits of the classes of significance.
SIGNIFICANCE = ((0.001, "highly significant"), (0.01, "very significant"), (0.05, "significant"), (0.1, "marginal"))


def significance(p: Column) -> Column:
    """The class of a p value."""
    out = F.when(p < SIGNIFICANCE[0][0], SIGNIFICANCE[0][1])
    for limit, name in SIGNIFICANCE[1:]:
        out = out.when(p < limit, name)
    return out.otherwise("not significant")
