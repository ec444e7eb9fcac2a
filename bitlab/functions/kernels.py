"""Measures of one bounded chunk of bits that are sequential by nature; each runs per chunk within Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lz76(text: str) -> int:
    """Phrases of the 1976 parsing: each is the longest match wholly within what came before, and one symbol more."""
    n, i, count = len(text), 0, 0
    while i < n:
        length = 0
        while i + length < n and text.find(text[i : i + length + 1], 0, i) >= 0:
            length += 1
        i += length + 1
        count += 1
    return count


def spectral_slope(bits: np.ndarray) -> float:
    """Slope of log power over log frequency, of the centred, Hann-windowed sequence; NaN with fewer than three bins."""
    power = np.abs(np.fft.rfft((bits - bits.mean()) * np.hanning(len(bits)))) ** 2
    f = np.arange(1, len(power))
    use = power[1:] > 1e-18
    return float(np.polyfit(np.log10(f[use]), np.log10(power[1:][use]), 1)[0]) if use.sum() >= 3 else float("nan")


def peaks(power: np.ndarray, most: int = 20, apart: int = 5) -> np.ndarray:
    """Local maxima above twice the mean, the highest first, none within ``apart`` of a higher one."""
    inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:]) & (power[1:-1] > 2 * power.mean())) + 1
    kept: list[int] = []
    for i in inner[np.argsort(-power[inner], kind="stable")]:
        if all(abs(i - k) >= apart for k in kept):
            kept.append(int(i))
    return np.array(kept[:most], int)


def autocorrelation(bits: np.ndarray, lags: int) -> np.ndarray:
    """Of the centred sequence at lags 0 to ``lags``, over that at 0; zeros if constant."""
    x = bits - bits.mean()
    f = np.fft.rfft(x, 2 * len(x))
    r = np.fft.irfft(f * np.conj(f))[: lags + 1]
    return r / r[0] if r[0] > 1e-12 else np.zeros(lags + 1)


def sample_entropy(bits: np.ndarray, m: int = 2, most: float = 2.5) -> float:
    """-log of matches of m + 1 over matches of m symbols (exact matches of bits), at most ``most``."""
    def matches(k: int) -> int:
        codes = sum(bits[i : len(bits) - m + i].astype(np.int64) << i for i in range(k))
        n = np.bincount(codes)
        return int((n * (n - 1) // 2).sum())

    if len(bits) <= m + 1:
        return float("nan")
    a, b = matches(m + 1), matches(m)
    return min(most, float(-np.log(a / b))) if a and b else most


def recurrence_rates(bits: np.ndarray, dim: int = 3, shortest: int = 2) -> tuple[float, float]:
    """(recurrence rate, determinism): equal embedded states off the diagonal, and those on diagonals of ``shortest`` or more."""
    n = len(bits) - dim + 1
    if n < 2:
        return float("nan"), float("nan")
    code = sum(bits[i : n + i].astype(np.int64) << i for i in range(dim))
    total = on_lines = 0
    for k in range(1, n):
        same = np.concatenate([[False], code[k:] == code[:-k], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        runs = edge[1::2] - edge[::2]
        total += int(runs.sum())
        on_lines += int(runs[runs >= shortest].sum())
    return 2 * total / (n * n), on_lines / total if total else 0.0


def persistence_h0(points: np.ndarray) -> np.ndarray:
    """Lifespans of components under growing distance: the edges of a minimal spanning tree, in order."""
    n = len(points)
    best, inside = np.full(n, np.inf), np.zeros(n, bool)
    out, at = [], 0
    for _ in range(max(0, n - 1)):
        inside[at] = True
        best = np.minimum(best, np.linalg.norm(points - points[at], axis=1))
        at = int(np.argmin(np.where(inside, np.inf, best)))
        out.append(best[at])
    return np.sort(np.array(out))


def per_chunk(chunked: DataFrame, measure: Callable[[str], dict[str, float]], schema: str) -> DataFrame:
    """(seq_id, chunk, n, ...) with ``measure`` of each chunk's own text; chunks are bounded, so any task's memory is."""

    def run(batches):
        for b in batches:
            rows = [measure(t[:n]) for t, n in zip(b["text"], b["n"], strict=True)]
            yield pd.concat([b[["seq_id", "chunk", "n"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return chunked.where("n > 0").select("seq_id", "chunk", "n", "text").mapInPandas(run, f"seq_id string, chunk long, n int, {schema}")


def complexity(text: str) -> dict[str, float]:
    """LZ76 phrases and their number over n / log2 n, spectral slope, sample entropy, recurrence of a chunk."""
    bits = np.frombuffer(text.encode(), np.uint8) - 48
    c, n = lz76(text), len(text)
    rate, determinism = recurrence_rates(bits)
    return {"phrases": c, "lz": min(1.0, c / (n / np.log2(n))) if n > 1 else float("nan"), "slope": spectral_slope(bits) if n > 8 else float("nan"), "sampen": sample_entropy(bits), "rate": rate, "determinism": determinism}


def phrases(text: str) -> dict[str, float]:
    """LZ76 phrases of a chunk."""
    return {"phrases": lz76(text)}


COMPLEXITY = "phrases long, lz double, slope double, sampen double, rate double, determinism double"


def takens(text: str, dim: int = 8, tau: int = 2, most: int = 200) -> dict[str, float]:
    """H0 of the delay embedding of a chunk at ``most`` evenly spaced landmarks: components, mean and median lifespan, those above it."""
    bits = np.frombuffer(text.encode(), np.uint8).astype(float) - 48
    n = len(bits) - (dim - 1) * tau
    if n < 2:
        return {"points": max(n, 0), "mean_life": float("nan"), "longer": 0}
    at = np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
    life = persistence_h0(np.stack([bits[at + i * tau] for i in range(dim)], axis=1))
    return {"points": len(at), "mean_life": float(life.mean()), "longer": int((life > np.median(life)).sum())}


def spectrum(chunked: DataFrame, size: int) -> DataFrame:
    """(bin, freq, windows, power): mean Hann-windowed power of all whole chunks of ``size`` bits by frequency bin."""
    window = np.hanning(size)

    def run(batches):
        for b in batches:
            for text in b["text"]:
                bits = np.frombuffer(text[:size].encode(), np.uint8) - 48.0
                power = np.abs(np.fft.rfft((bits - bits.mean()) * window)) ** 2 / (window**2).sum()
                yield pd.DataFrame({"bin": np.arange(1, len(power)), "p": power[1:]})

    each = chunked.where(F.col("n") == size).select("text").mapInPandas(run, "bin long, p double")
    return each.groupBy("bin").agg(F.count(F.lit(1)).alias("windows"), F.avg("p").alias("power")).select("bin", (F.col("bin") / size).alias("freq"), "windows", "power")


def spectrum_peaks(spec: DataFrame, most: int = 20, apart: int = 5) -> DataFrame:
    """(bin, freq, power, period): bins above twice the mean and above all others within ``apart``, the highest ``most``."""
    mean = spec.agg((2 * F.avg("power")).alias("limit"))
    near = spec.select(F.explode(F.sequence(F.col("bin") - apart, F.col("bin") + apart)).alias("bin"), F.col("power").alias("other"))
    top = near.groupBy("bin").agg(F.max("other").alias("highest"))
    out = spec.join(top, "bin").crossJoin(F.broadcast(mean)).where((F.col("power") >= F.col("highest")) & (F.col("power") > F.col("limit")) & (F.col("freq") < 0.5))  # one row
    return out.orderBy(F.desc("power"), "bin").limit(most).select("bin", "freq", "power", F.floor(1 / F.col("freq")).cast("int").alias("period"))
