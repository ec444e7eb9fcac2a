"""Spectra of sequences of any length by overlapping windows, and straight lines through them on logarithmic scales."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitlab.operators.chunks import SIZE, chunks


def welch(bits: DataFrame, window: int, overlap: float = 0.5) -> DataFrame:
    """(seq_id, bin, freq, windows, power): mean power of all whole windows, each less its mean, by frequency bin from 1 on.

    Windows begin at every multiple of window * (1 - overlap) positions; a tail too short for a window is in no further one. A
    chunk has all windows that begin in it, with a halo. Powers are summed over the windows of a batch before the shuffle.
    """
    if not 0 <= overlap < 1 or window < 2:
        raise ValueError("windows must have 2 or more positions and overlap by less than all")
    hop = max(1, int(window * (1 - overlap)))
    size = hop * -(-max(window, SIZE) // hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            count: dict[str, int] = {}
            for k, n, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(text.encode(), np.uint8) - 48.0
                starts = np.arange(0, min(n, len(x) - window + 1), hop)
                if len(starts):
                    rows = np.lib.stride_tricks.sliding_window_view(x, window)[starts]
                    power = np.abs(np.fft.rfft(rows - rows.mean(axis=1, keepdims=True))) ** 2
                    sums[k] = sums.get(k, 0) + power[:, 1:].sum(axis=0)
                    count[k] = count.get(k, 0) + len(starts)
            for k, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(s)), pa.array(np.arange(1, len(s) + 1)), pa.array(np.full(len(s), count[k])), pa.array(s)], names=["seq_id", "bin", "windows", "power"])

    cut = chunks(bits, size=size, halo=window - 1).select("seq_id", "n", "text")
    sums = cut.mapInArrow(run, "seq_id string, bin long, windows long, power double").groupBy("seq_id", "bin").agg(F.sum("windows").alias("windows"), F.sum("power").alias("power"))
    return sums.select("seq_id", "bin", (F.col("bin") / window).alias("freq"), "windows", (F.col("power") / F.col("windows")).alias("power"))


def slope(spectrum: DataFrame, low: float, high: float, min_points: int = 50, betas: tuple[float, float] = (0.2, 2.5), min_r2: float = 0.95) -> DataFrame:
    """(seq_id, points, beta, r2, accepted): power falls with the ``beta``-th power of frequency, between two frequencies.

    Accepted: from so many points, with beta within ``betas`` and so much of the variance explained.
    """
    inside = spectrum.where((F.col("freq") > low) & (F.col("freq") < high) & (F.col("power") > 0))
    x, y = F.log10("freq"), F.log10("power")
    out = inside.groupBy("seq_id").agg(F.count(F.lit(1)).alias("points"), (-F.regr_slope(y, x)).alias("beta"), F.regr_r2(y, x).alias("r2"))
    good = (F.col("points") >= min_points) & F.col("beta").between(*betas) & (F.col("r2") >= min_r2)
    return out.select("seq_id", "points", F.round("beta", 5).alias("beta"), F.round("r2", 5).alias("r2"), F.coalesce(good, F.lit(False)).alias("accepted"))


def log_bins(spectrum: DataFrame, bins: int = 80, min_points: int = 3) -> DataFrame:
    """(seq_id, bin, points, x, y, spread): mean log10 frequency and log10 power, and its deviation, in even bins of log frequency.

    Bins run from the smallest to the largest frequency of some power, which is in none itself; those of fewer than ``min_points`` are left out.
    """
    logs = spectrum.where((F.col("freq") > 0) & (F.col("power") > 0)).select("seq_id", F.log10("freq").alias("x"), F.log10("power").alias("y"))
    ends = logs.groupBy("seq_id").agg(F.min("x").alias("from_"), F.max("x").alias("to_"))
    at = F.floor((F.col("x") - F.col("from_")) / (F.col("to_") - F.col("from_")) * bins)
    placed = logs.join(ends, "seq_id").where("x < to_").withColumn("bin", at)
    out = placed.groupBy("seq_id", "bin").agg(F.count(F.lit(1)).alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_pop("y").alias("spread"))
    return out.where(F.col("points") >= min_points)


def segmented(binned: DataFrame, edge: int = 10, stride: int = 5, penalty: float = 0.02) -> DataFrame:
    """(seq_id, model, score, segment, first, last, points, beta, r2): the best of one, two or three straight lines through the bins.

    A model's score is the mean of its lines' R2 by points, less ``penalty`` for every break. Breaks keep ``edge`` bins from the ends and
    from each other; pairs of breaks are tried every ``stride`` bins. Of equal scores the fewer lines, then the earlier breaks win.
    The bins of a sequence, of which there are few, are one row.
    """
    rows = binned.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p")).withColumn("n", F.size("p"))
    some = lambda a, b, step: F.when(b > a, F.sequence(a, b - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    lit = F.lit
    one = F.array(F.array(lit(0), F.col("n")))
    two = F.transform(some(lit(edge), F.col("n") - edge, 1), lambda s: F.array(lit(0), s, F.col("n")))
    three = F.flatten(F.transform(some(lit(edge), F.col("n") - 2 * edge, stride), lambda s: F.transform(some(s + edge, F.col("n") - edge, stride), lambda t: F.array(lit(0), s, t, F.col("n")))))
    tried = rows.select("seq_id", "p", F.explode(F.concat(one, two, three)).alias("cuts"))
    lines = tried.select("seq_id", "cuts", "p", F.posexplode(F.slice("cuts", 2, 3)).alias("segment", "to_"))
    lines = lines.withColumn("from_", F.get("cuts", F.col("segment")))
    points = lines.select("seq_id", "cuts", "segment", "from_", "to_", F.explode(F.slice("p", F.col("from_") + 1, F.col("to_") - F.col("from_"))).alias("q"))
    x, y = F.col("q.x"), F.col("q.y")
    fits = points.groupBy("seq_id", "cuts", "segment", "from_", "to_").agg(F.count(lit(1)).alias("points"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"))
    fit = F.struct("segment", "from_", "to_", "points", "b", "r2")
    models = fits.groupBy("seq_id", "cuts").agg(F.sort_array(F.collect_list(fit)).alias("fits"), F.sum(F.col("r2") * F.col("points")).alias("r"), F.sum("points").alias("n"))
    score = F.round(F.col("r") / F.col("n") - penalty * (F.size("cuts") - 2), 9)
    best = models.where("fits[0].points >= 5").groupBy("seq_id").agg(F.min(F.struct((-score).alias("less"), F.size("cuts").alias("k"), "cuts", "fits")).alias("m"))
    out = best.select("seq_id", (F.col("m.k") - 1).alias("model"), F.round(-F.col("m.less"), 5).alias("score"), F.inline("m.fits"))
    return out.select("seq_id", "model", "score", (F.col("segment") + 1).alias("segment"), F.col("from_").alias("first"), (F.col("to_") - 1).alias("last"), "points", F.round(-F.col("b"), 4).alias("beta"), F.round("r2", 5).alias("r2"))


def peaks(spectrum: DataFrame, most: int = 50, apart: int = 5, times: float = 2.0) -> DataFrame:
    """(seq_id, bin, freq, power, period): bins above ``times`` the mean power and above all others less than ``apart`` bins away, the ``most`` highest.

    Of equal neighbours the first counts. The period is the whole part of 1 / freq; the last bin has none. Powers are compared in
    steps of 2^-30 of the sequence's mean, so that sums taken in another order do not decide between equal ones.
    """
    mean = spectrum.groupBy("seq_id").agg(F.avg("power").alias("mean"))
    told = spectrum.join(mean, "seq_id").withColumn("steps", F.floor(F.try_divide("power", "mean") * (1 << 30) + 1 / np.pi))  # no simple ratio lies between two steps
    near = told.select("seq_id", F.explode(F.sequence(F.col("bin") - apart + 1, F.col("bin") + apart - 1)).alias("bin"), F.struct("steps", (-F.col("bin")).alias("b")).alias("other"))
    top = near.groupBy("seq_id", "bin").agg(F.max("other").alias("highest"))
    high = told.join(top, ["seq_id", "bin"]).where((F.col("highest.b") == -F.col("bin")) & (F.col("steps") > floor(times * (1 << 30) + 1 / np.pi)) & (F.col("freq") < 0.5))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("less"), "bin", "freq", "power"))), 1, most)
    return high.groupBy("seq_id").agg(ranked.alias("p")).select("seq_id", F.inline("p")).select("seq_id", "bin", "freq", "power", F.floor(1 / F.col("freq")).cast("int").alias("period"))


def periodic_tiles(bits: DataFrame, periods: DataFrame, min_count: int = 2, size: int = 1 << 10) -> DataFrame:
    """(seq_id, period, tile, n): identical tiles of each sequence at its own ``periods`` (seq_id, period), counted at multiples of them.

    All periods are served by one reading: a tile is found in the chunk in which it begins, and the halo is as long as the longest period.
    Periods come from data, so there is no list of them; only ``size`` bounds them.
    """
    cut = chunks(bits, size=size, halo=size)
    each = cut.join(periods.where((F.col("period") > 0) & (F.col("period") <= size)).distinct(), "seq_id")
    first = F.pmod(-F.col("start"), F.col("period")).cast("int")
    last = F.least(F.col("n") - 1, F.length("text") - F.col("period"))
    at = each.withColumn("first", first).withColumn("last", last).where("first <= last").select("seq_id", "period", F.expr("transform(sequence(first, last, period), i -> substring(text, i + 1, period))").alias("tiles"))
    found = at.select("seq_id", "period", F.explode("tiles").alias("tile")).groupBy("seq_id", "period", "tile").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= min_count)
