"""Tails against known values and against sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlab.functions import tails
from bitlab.operators import reports


def test_normal_and_gamma(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.999, 2.0, 2.5, 4.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, e, p in df.select("x", tails.erfc(F.col("x")), tails.normal_p(-F.col("x"))).collect():
        assert e == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-14) and p == pytest.approx(math.erfc(x / 2**0.5), rel=1e-9, abs=1e-14)
    for x, g in spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.0, 3.7, 50.5, 1e6)], "x double").select("x", tails.ln_gamma(F.col("x"))).collect():
        assert g == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10)


def student(t, df, n=200_000):
    """Twice the tail, by a sum over the angle."""
    angle = (np.arange(n) + 0.5) / n
    part, whole = math.atan(abs(t) / df**0.5), math.pi / 2
    return 1 - float(np.mean(np.cos(part * angle) ** (df - 1)) * part / (np.mean(np.cos(whole * angle) ** (df - 1)) * whole))


def test_student(spark):
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 12.0) for df in (1.0, 2.0, 5.0, 30.0, 400.0)]
    for t, df, p in spark.createDataFrame(cases, "t double, df double").select("t", "df", tails.t_p(F.col("t"), F.col("df"))).collect():
        assert p == pytest.approx(student(t, df), abs=1e-8)
    known = {1.0: 12.706205, 2.0: 4.302653, 10.0: 2.228139, 100.0: 1.983972}
    for df, q in spark.createDataFrame([(d,) for d in (*known, 0.0)], "df double").select("df", tails.t_quantile(0.05, F.col("df"))).collect():
        assert q is None if df == 0 else q == pytest.approx(known[df], abs=1e-6)


def test_permutations(spark):
    null = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "null double")
    got = {r["alternative"]: r for r in reports.permutation_test(null, spark.createDataFrame([(4,)], "observed int")).collect()}
    assert {k: r["p"] for k, r in got.items()} == {"greater": 0.4, "less": 0.8, "two-sided": 1.0}
    assert got["less"]["z"] == 0 and got["greater"]["class"] == "not significant"
    far = {r["alternative"]: r["p"] for r in reports.permutation_test(null, spark.createDataFrame([(11,)], "observed int")).collect()}
    assert far == {"greater": 0.0, "less": 1.0, "two-sided": 0.0}
    same = spark.createDataFrame([(2.0,), (2.0,)], "null double")
    assert reports.permutation_test(same, spark.createDataFrame([(2,)], "observed int")).first()["z"] == 0
    assert reports.permutation_test(same, spark.createDataFrame([(3,)], "observed int")).first()["z"] is None
