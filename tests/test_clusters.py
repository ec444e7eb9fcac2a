"""Block clusters, drawn pairs and scalar indexes against brute force and by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlab.operators import clusters, indexes


def brute_clusters(points, reach, min_count):
    """Density clusters of code -> (n, first_pos), by all pairs."""
    close = {a: [b for b in points if a != b and bin(a ^ b).count("1") <= reach] for a in points}
    core = {a for a in points if points[a][0] + sum(points[b][0] for b in close[a]) >= min_count}
    cluster = {}
    for a in sorted(core, key=lambda x: points[x][1]):
        if a in cluster:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in cluster:
                cluster[x] = points[a][1]
                todo += [y for y in close[x] if y in core]
    names = dict(cluster)
    for a in points.keys() - core:
        names[a] = min((cluster[b] for b in close[a] if b in core), default=None)
    return {(a, *points[a], a in core, names[a]) for a in points}


@pytest.mark.parametrize(("size", "similarity", "n", "min_count"), [(8, 0.8, 60, 3), (16, 0.8, 300, 2), (12, 0.95, 100, 2), (10, 0.7, 150, 12)])
def test_density_clusters(spark, size, similarity, n, min_count):
    rnd = random.Random(n)
    centres = [rnd.getrandbits(size) for _ in range(6)]
    codes = {rnd.choice(centres) ^ sum(1 << rnd.randrange(size) for _ in range(rnd.randrange(4))) & ((1 << size) - 1) for _ in range(n)}
    points = {c: (rnd.choice([1, 1, 1, 2, 9]), i) for i, c in enumerate(sorted(codes, key=lambda _: rnd.random()))}
    df = spark.createDataFrame([(c, *x) for c, x in points.items()], "code long, n long, first_pos long").repartition(5)
    got = set(map(tuple, clusters.density_clusters(df, size, similarity, min_count).collect()))
    assert got == brute_clusters(points, int((1 - similarity) * size + 1e-9), min_count)


@pytest.mark.parametrize(("size", "reach"), [(1, 0), (7, 2), (9, 8), (31, 3)])
def test_neighbours_once_each(spark, size, reach):
    rnd = random.Random(size)
    codes = {rnd.getrandbits(size) for _ in range(40)} | {0, (1 << size) - 1, 1}
    codes |= {c ^ 1 << rnd.randrange(size) for c in list(codes)}
    got = [tuple(r) for r in clusters.neighbours(spark.createDataFrame([(c,) for c in codes], "code long"), size, reach).collect()]
    assert sorted(got) == sorted((a, b, (a ^ b).bit_count()) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= reach)
    with pytest.raises(ValueError, match="reach"):
        clusters.neighbours(spark.range(1).toDF("code"), size, size)


def test_labels_of_a_long_chain(spark):
    nodes = spark.range(200).select(F.col("id").alias("node"), ((F.col("id") * 77) % 200).alias("rank"))
    edges = spark.range(199).where("id <> 120").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = dict(map(tuple, clusters.labels(nodes, edges).collect()))
    assert all(got[i] == min(j * 77 % 200 for j in (range(121) if i <= 120 else range(121, 200))) for i in range(200))


def test_distant_pairs_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 5000)
    df = spark.createDataFrame([("a", i, int(b)) for i, b in enumerate(bits)], "seq_id string, pos long, bit int")
    one, two = (sorted(map(tuple, clusters.distant_information(df.repartition(k), 50, 2000).collect())) for k in (1, 7))
    assert [r[:3] for r in one] == [r[:3] for r in two] and len(one) == 200
    for distance, _, start, mi in one:
        joint = np.bincount(2 * bits[start : start + 50] + bits[start + distance : start + distance + 50], minlength=4).reshape(2, 2) / 50
        outer = np.outer(joint.sum(1), joint.sum(0))
        assert abs(mi - max(0, (joint[joint > 0] * np.log2(joint[joint > 0] / outer[joint > 0])).sum())) < 1e-9
    assert clusters.distant_information(df.where("pos < 120"), 50, 2000).count() == 0
    got = clusters.mean_and_error(spark.createDataFrame([(x,) for x in (1.0, 2.0, 6.0)], "x double"), "x").first()
    assert got["n"] == 3 and got["mean"] == 3 and abs(got["error"] - np.std([1, 2, 6]) / 3**0.5) < 1e-12


def test_indexes_by_hand(spark):
    x = lambda v: F.lit(float(v))
    out = spark.range(1).select(
        indexes.nontriviality(x(0.5), x(0.5)), indexes.nontriviality(x(0.9), x(0.25)), indexes.sci(x(0.4), x(0.5), x(0.2)), indexes.icc(x(0.36), x(0.25), x(0.5), x(0.8)), indexes.icc(x(0.36), x(0.25), x(0.5), x(0.8), x(0.5)),
        indexes.icc(x(1), x(1), x(1), x(1), x(1)), indexes.criticality(x(0.85), x(-1)), indexes.criticality(x(1.2), x(0)), indexes.normalised_lz(x(8), F.lit(16)), indexes.normalised_lz(x(1), F.lit(1)), indexes.class_of(x(0.6), indexes.SCI, "very high"), indexes.class_of(x(0.9), indexes.SCI, "very high"))
    want = (0.5, 0.05, 0.35 * 0.4 + 0.2 + 0.05, 0.12, 0.132, 1.0, 1.0, 0.5, 1.0, 0.0)
    got = out.first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(got[:10], want, strict=True)) and got[10:] == ("high", "very high")


def test_emergence_by_hand(spark):
    x = lambda v: F.lit(v).cast("double")
    cases = {  # lz, hierarchy, mean entropy, information, exponent, slope: scores
        (0.2, 0.25, 0.6, 0.05, 1.0, -1.0): (0.8, 0.9, 1.0, 0.5, 0.5, 1.0, 1.0),
        (0.85, 0.6, 0.95, 0.2, 0.7, -0.5): (0.15, 0.5, 0.75, 1.0, 0.5, 0.76, 0.45),
        (0.5, 0.1, 0.15, 0.0, 1.3, 0.5): (0.5, 1.0, 0.25, 0.0, 0.1, 0.5, 0.8),
        (1.0, 0.0, 0.5, 0.0, None, 2.0): (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    }
    names = ("order", "complexity", "criticality", "coherence", "hierarchy", "fluctuation", "non_randomness")
    for given, want in cases.items():
        parts = indexes.scores(*map(x, given))
        got = spark.range(1).select(*[parts[k] for k in names], indexes.weighted(parts, indexes.SEI_WEIGHTS), indexes.weighted(parts, indexes.ECI_WEIGHTS)).first()
        assert got[:7] == pytest.approx(want)
        assert got[7] == pytest.approx(0.3 * want[0] + 0.3 * want[4] + 0.2 * want[3] + 0.2 * want[6])
        assert got[8] == pytest.approx(0.25 * want[2] + 0.25 * want[1] + 0.2 * want[3] + 0.15 * want[4] + 0.15 * want[5])
    got = spark.range(1).select(*[indexes.slope_class(x(v)) for v in (-1.0, 0.0, -2.0, -0.5)], *[indexes.lz_class(x(v)) for v in (0.05, 0.2, 0.7, 0.71)]).first()
    assert tuple(got) == ("1/f", "white", "brownian", "intermediate", "very low", "low", "structured", "high")
