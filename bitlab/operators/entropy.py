"""Entropies and mutual information of blocks, at one scale and many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import blocks, entropy_of, ratio
from bitlab.operators.codes import gram_codes
from bitlab.operators.patterns import tiles

PHI = (1 + 5**0.5) / 2


def block_entropy(bits: DataFrame, sizes: list[int]) -> DataFrame:
    """(seq_id, size, blocks, states, entropy, rate): Shannon entropy of disjoint blocks, and per bit."""
    counts = tiles(bits, sizes, 1).select("seq_id", F.col("period").alias("size"), "tile", "n")
    out = entropy_of(counts, ["seq_id", "size"])
    return out.select("seq_id", "size", F.col("total").alias("blocks"), "states", F.round("entropy", 6).alias("entropy"), F.round(F.col("entropy") / F.col("size"), 6).alias("rate"))


def hierarchy(blocked: DataFrame) -> DataFrame:
    """(seq_id, scales, cv, slope) of block entropies, each over log2(min(2^size, blocks))."""
    most = F.log2(F.least(F.pow(F.lit(2.0), F.col("size").cast("double")), F.col("blocks").cast("double")))
    norm = blocked.where("blocks > 1").select("seq_id", F.log2(F.col("size").cast("double")).alias("x"), (F.col("entropy") / most).alias("y"))
    out = norm.groupBy("seq_id").agg(F.count(F.lit(1)).alias("scales"), ratio(F.stddev_pop("y"), F.avg("y")).alias("cv"), F.regr_slope("y", "x").alias("slope"))
    return out.select("seq_id", "scales", F.round("cv", 6).alias("cv"), F.round("slope", 6).alias("slope"))


def density_entropy(bits: DataFrame, sizes: list[int], bins: int = 10) -> DataFrame:
    """(seq_id, size, blocks, entropy): entropy of the histogram of block densities in ``bins`` equal bins."""
    per = blocks(bits, sizes)
    hist = per.groupBy("seq_id", "size", F.least(F.floor(F.col("ones") * bins / F.col("size")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return entropy_of(hist, ["seq_id", "size"]).select("seq_id", "size", F.col("total").alias("blocks"), F.round("entropy", 6).alias("entropy"))


def scale_preference(golden: DataFrame, doubling: DataFrame) -> DataFrame:
    """(seq_id, golden_strength, doubling_strength, preference): 1 / (1 + variance of the entropies) at two kinds of scales."""
    def strength(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("seq_id").agg((1 / (1 + F.var_pop("entropy"))).alias(name))

    out = strength(golden, "g").join(strength(doubling, "d"), "seq_id")
    return out.select("seq_id", F.round("g", 6).alias("golden_strength"), F.round("d", 6).alias("doubling_strength"), F.round(F.col("g") / F.col("d"), 6).alias("preference"))


def lagged_information(bits: DataFrame, block: int, lags: list[int]) -> DataFrame:
    """(seq_id, lag, pairs, mi): mutual information of majority blocks ``lag`` blocks apart."""
    state = blocks(bits, [block]).select("seq_id", "block", F.when(2 * F.col("ones") > block, 1).otherwise(0).alias("x"))
    left = state.withColumn("lag", F.explode(F.array(*[F.lit(n) for n in lags]))).withColumn("to", F.col("block") + F.col("lag"))
    right = state.select("seq_id", F.col("block").alias("to"), F.col("x").alias("y"))
    return information(left.join(right, ["seq_id", "to"]).groupBy("seq_id", "lag", "x", "y").agg(F.count(F.lit(1)).alias("n")), ["seq_id", "lag"])


def information(joint: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pairs, mi) from joint counts (x, y, n); not below zero."""
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    n = joint.withColumn("t", over()).withColumn("nx", over("x")).withColumn("ny", over("y"))
    p = F.col("n").cast("double") / F.col("t")
    out = n.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.sum(p * F.log2(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))).alias("mi"))
    return out.select(*keys, "pairs", F.round(F.greatest(F.lit(0.0), "mi"), 6).alias("mi"))


def transfer_entropy(bits: DataFrame, scales: list[int], k: int = 3, digits: int | None = 6) -> DataFrame:
    """(seq_id, src, dst, n, te): transfer entropy between coarse-grained scales, aligned on block index; ``digits`` None: not rounded.

    TE = sum p(y, yp, xp) log2(p(y | yp, xp) / p(y | yp)), with pasts of ``k`` majority blocks; not below zero.
    """
    state = blocks(bits, scales).select("seq_id", "size", "block", F.when(2 * F.col("ones") > F.col("size"), 1).otherwise(0).alias("x"))
    # pasts are windows of the block states, read off packed words of them
    seen = gram_codes(state.withColumnRenamed("block", "pos"), k + 1, ("seq_id", "size"), "x")
    hist = seen.select("seq_id", "size", (F.col("pos") + k).alias("block"), F.call_function("shiftright", F.col("code"), F.lit(1)).alias("past"), (F.col("code") % 2).alias("x"))
    src = hist.select("seq_id", "block", F.col("size").alias("src"), F.col("past").alias("xp"))
    dst = hist.select("seq_id", "block", F.col("size").alias("dst"), F.col("past").alias("yp"), F.col("x").alias("y"))
    joint = src.join(dst, ["seq_id", "block"]).where("src <> dst").groupBy("seq_id", "src", "dst", "yp", "xp", "y").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("seq_id", "src", "dst", *c))
    n = joint.withColumn("t", over()).withColumn("n_yx", over("yp", "xp")).withColumn("n_y", over("yp")).withColumn("n_yy", over("yp", "y"))
    c = lambda x: F.col(x).cast("double")
    te = F.sum(c("n") / c("t") * F.log2(c("n") * c("n_y") / (c("n_yx") * c("n_yy"))))
    out = n.groupBy("seq_id", "src", "dst").agg(F.sum("n").alias("n"), te.alias("te"))
    te = F.greatest(F.lit(0.0), "te")
    return out.select("seq_id", "src", "dst", "n", (te if digits is None else F.round(te, digits)).alias("te"))


def directions(te: DataFrame, margin: float = 0.01) -> DataFrame:
    """(seq_id, up, down, asymmetry, direction): mean transfer from small to large scales, and back."""
    out = te.groupBy("seq_id").agg(F.avg(F.when(F.col("src") < F.col("dst"), F.col("te"))).alias("up"), F.avg(F.when(F.col("src") > F.col("dst"), F.col("te"))).alias("down"))
    diff = F.col("up") - F.col("down")
    kind = F.when(diff > margin, "bottom-up").when(diff < -margin, "top-down").otherwise("balanced")
    return out.select("seq_id", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), F.round(diff, 6).alias("asymmetry"), kind.alias("direction"))
