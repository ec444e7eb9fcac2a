"""Overlapping spectra, line fits, peaks and tiles against NumPy and by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlab.operators import spectra


def frame(spark, **seqs):
    rows = [(k, i, int(c)) for k, t in seqs.items() for i, c in enumerate(t)]
    return spark.createDataFrame(rows, "seq_id string, pos long, bit int").repartition(5)


@pytest.mark.parametrize(("window", "overlap"), [(64, 0.5), (50, 0.25), (16, 0.0), (7, 0.5), (20, 0.9)])
def test_welch(spark, window, overlap):
    rng = np.random.default_rng(window)
    seqs = {"a": rng.integers(0, 2, 500), "b": rng.integers(0, 2, 70), "short": rng.integers(0, 2, 6)}
    got = {(r["seq_id"], r["bin"]): (r["windows"], r["power"]) for r in spectra.welch(frame(spark, **seqs), window, overlap).collect()}
    hop, want = max(1, int(window * (1 - overlap))), {}
    for k, x in seqs.items():
        power = [np.abs(np.fft.rfft(w - w.mean())) ** 2 for i in range(0, len(x) - window + 1, hop) for w in [x[i : i + window]]]
        want |= {(k, b): (len(power), np.mean(power, axis=0)[b]) for b in range(1, window // 2 + 1) if power}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    with pytest.raises(ValueError, match="overlap"):
        spectra.welch(frame(spark, a="01"), 8, 1.0)


def test_slope_and_segments(spark):
    f = np.arange(1, 4001) / 8000
    steep = np.where(f < 0.02, f**-2.0, 0.02**-1.5 * f**-0.5)
    rows = [(k, float(x), float(y)) for k, p in (("one", f**-1.3), ("two", steep)) for x, y in zip(f, p, strict=True)]
    df = spark.createDataFrame(rows, "seq_id string, freq double, power double")
    got = {r["seq_id"]: r for r in spectra.slope(df, 1e-3, 0.4).collect()}
    assert got["one"]["beta"] == pytest.approx(1.3) and got["one"]["accepted"] and got["one"]["r2"] == pytest.approx(1)
    assert not spectra.slope(df.where("freq < 0.005"), 1e-3, 0.4).where("accepted").count()  # too few points
    binned = spectra.log_bins(df).orderBy("seq_id", "x").collect()
    edges = np.linspace(np.log10(f.min()), np.log10(f.max()), 81)
    for k in ("one", "two"):
        mine = [r for r in binned if r["seq_id"] == k]
        inside = [(np.log10(f) >= a) & (np.log10(f) < b) for a, b in zip(edges, edges[1:], strict=False)]
        assert [r["points"] for r in mine] == [m.sum() for m in inside if m.sum() >= 3]
    fits = spectra.segmented(spectra.log_bins(df)).orderBy("seq_id", "segment").collect()
    assert [(r["model"], r["beta"]) for r in fits if r["seq_id"] == "one"] == [(1, 1.3)]
    two = [r for r in fits if r["seq_id"] == "two"]
    assert two[0]["model"] == len(two) >= 1 and two[-1]["beta"] < 1


def test_segments_find_the_break(spark):
    x = np.arange(40) / 10
    y = np.where(np.arange(40) < 20, -2 * x, -2 * x[20] + 3 * (x - x[20]))
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y, strict=True)], "seq_id string, x double, y double")
    got = [(r["model"], r["segment"], r["first"], r["last"], r["beta"]) for r in spectra.segmented(df).orderBy("segment").collect()]
    assert got == [(2, 1, 0, 19, 2.0), (2, 2, 20, 39, -3.0)]


def test_peaks_and_tiles(spark):
    df = frame(spark, four="0011" * 100, flat="0" * 300, mixed="01101" * 60)
    found = spectra.peaks(spectra.welch(df, 40)).orderBy("seq_id", "period").collect()
    assert [(r["seq_id"], r["period"]) for r in found] == [("four", 4), ("mixed", 2), ("mixed", 5)]
    periods = spark.createDataFrame([("four", 4), ("mixed", 5), ("mixed", 5), ("mixed", 1024), ("none", 3), ("four", 0)], "seq_id string, period int")
    for size in (1024, 8):
        got = spectra.periodic_tiles(df, periods, size=size).collect()
        assert sorted(map(tuple, got)) == [("four", 4, "0011", 100), ("mixed", 5, "01101", 60)]
    assert spectra.peaks(spectra.welch(df.where("pos < 3"), 40)).agg(F.count(F.lit(1))).first()[0] == 0


def test_equal_powers_are_equal_whatever_the_rounding(spark):
    texts = {f"{i:016b}": np.array([int(c) for c in f"{i:016b}"]) for i in range(1, 1 << 16, 7)}
    whole = lambda x, *signs: int(np.tile(signs, 16 // len(signs)) @ x)
    ties = {}
    for t, x in texts.items():  # at a quarter and at a half of the frequency powers are whole numbers, and so is the sum of all
        quarter, half, n = whole(x, 1, 0, -1, 0) ** 2 + whole(x, 0, 1, 0, -1) ** 2, whole(x, 1, -1) ** 2, int(x.sum())
        if 8 * quarter == 16 * n - n * n + half > 0:  # exactly twice the mean
            ties[t] = t
    found = spectra.peaks(spectra.welch(frame(spark, **ties), 16)).where("bin = 4").collect()
    assert len(ties) > 20 and found == []
