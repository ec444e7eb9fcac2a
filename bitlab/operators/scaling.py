"""Runs, boxes, fluctuations and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitlab.functions.tails import normal_p
from bitlab.operators.chunks import blocks, correlation, ratio, running_sum

PHI = (1 + 5**0.5) / 2


def runs(bits: DataFrame) -> DataFrame:
    """(seq_id, run, bit, start, len): stretches of equal bits, numbered from 1.

    A run starts where the bit before differs, looked up by position, so that no window spans a
    sequence; its number is a two-level running sum. Both sides of that join are as long as the sequences, so it is merged:
    of exploded rows Spark's estimate is too low, and it would send millions of them through the driver.
    """
    before = bits.select("seq_id", (F.col("pos") + 1).alias("pos"), F.col("bit").alias("was"))
    change = bits.join(before.hint("merge"), ["seq_id", "pos"], "left").withColumn("new", F.when(F.col("was").isNull() | (F.col("was") != F.col("bit")), 1).otherwise(0))
    numbered = running_sum(change, F.col("new"), "run")
    return numbered.groupBy("seq_id", "run").agg(F.min("bit").alias("bit"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("len"))


def run_histogram(run: DataFrame) -> DataFrame:
    """(seq_id, bit, len, n)."""
    return run.groupBy("seq_id", "bit", "len").agg(F.count(F.lit(1)).alias("n"))


def run_ratios(run: DataFrame, margin: float = 0.3) -> DataFrame:
    """(seq_id, ratios, mean_ratio, near_phi): lengths of a run over the one before, and the share within ``margin`` of phi or 1 / phi."""
    nxt = run.select("seq_id", (F.col("run") + 1).alias("run"), F.col("len").alias("was"))
    r = run.join(nxt, ["seq_id", "run"]).select("seq_id", (F.col("len").cast("double") / F.col("was")).alias("r"))
    near = (F.abs(F.col("r") - PHI) < margin) | (F.abs(F.col("r") - 1 / PHI) < margin)
    return r.groupBy("seq_id").agg(F.count(F.lit(1)).alias("ratios"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.avg(near.cast("double")), 6).alias("near_phi"))


def persistence(run: DataFrame) -> DataFrame:
    """(seq_id, death, n): lifespans as run length over the longest run of the sequence."""
    top = run.groupBy("seq_id").agg(F.max("len").alias("top"))
    return run.join(top, "seq_id").groupBy("seq_id", F.round(F.col("len").cast("double") / F.col("top"), 6).alias("death")).agg(F.count(F.lit(1)).alias("n"))


def betti(bits: DataFrame, scales: list[int]) -> DataFrame:
    """(seq_id, scale, components, alternations): stretches of ones among majority blocks, and changes between neighbours."""
    state = blocks(bits, scales).select("seq_id", F.col("size").alias("scale"), "block", F.when(F.col("ones") > F.floor(F.col("size") / 2), 1).otherwise(0).alias("x"))
    before = state.select("seq_id", "scale", (F.col("block") + 1).alias("block"), F.col("x").alias("was"))
    both = state.join(before, ["seq_id", "scale", "block"], "left")
    return both.groupBy("seq_id", "scale").agg(F.count_if((F.col("x") == 1) & (F.coalesce("was", F.lit(0)) == 0)).alias("components"), F.count_if(F.col("was") != F.col("x")).alias("alternations"))


def box_counts(bits: DataFrame, sizes: list[int], partial: bool = False) -> DataFrame:
    """(seq_id, size, boxes, filled): boxes with a one; ``partial`` counts a shorter last box too."""
    each = bits.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    per = each.groupBy("seq_id", "size", F.floor(F.col("pos") / F.col("size")).alias("box")).agg(F.count(F.lit(1)).alias("n"), F.max("bit").alias("one"))
    return (per if partial else per.where("n = size")).groupBy("seq_id", "size").agg(F.count(F.lit(1)).alias("boxes"), F.sum("one").alias("filled"))


def box_dimension(counts: DataFrame) -> DataFrame:
    """(seq_id, dimension): less the slope of log filled boxes over log size, within 0 and 2."""
    x, y = F.ln(F.col("size").cast("double")), F.ln(F.col("filled").cast("double"))
    out = counts.where("filled > 0").groupBy("seq_id").agg((-F.regr_slope(y, x)).alias("d"))
    return out.select("seq_id", F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.0), "d")), 6).alias("dimension"))


def fluctuations(bits: DataFrame, sizes: list[int], order: float = 2.0) -> DataFrame:
    """(seq_id, size, boxes, f): detrended fluctuation of the centred profile in whole boxes.

    A box's residual is var(y) - cov(x, y)^2 / var(x) of its profile; f is the mean of its ``order`` / 2
    power, to the power 1 / ``order``.
    """
    mean = bits.groupBy("seq_id").agg(F.avg("bit").alias("mean"))
    profile = running_sum(bits.join(mean, "seq_id"), F.col("bit") - F.col("mean"), "y").select("seq_id", "pos", "y")
    each = profile.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn("x", (F.col("pos") % F.col("size")).cast("double"))
    per = each.groupBy("seq_id", "size", F.floor(F.col("pos") / F.col("size")).alias("box")).agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"))
    rest = F.greatest(F.lit(0.0), F.col("vy") - F.col("cxy") * F.col("cxy") / F.col("vx"))
    out = per.where("n = size AND vx > 0").groupBy("seq_id", "size").agg(F.count(F.lit(1)).alias("boxes"), F.avg(F.pow(rest, F.lit(order / 2))).alias("m"))
    return out.select("seq_id", "size", "boxes", F.round(F.pow("m", F.lit(1 / order)), 6).alias("f"))


def exponent(fluct: DataFrame) -> DataFrame:
    """(seq_id, h, r2): slope of log f over log size."""
    x, y = F.ln(F.col("size").cast("double")), F.ln("f")
    out = fluct.where("f > 0").groupBy("seq_id").agg(F.regr_slope(y, x).alias("h"), F.regr_r2(y, x).alias("r2"))
    return out.select("seq_id", F.round("h", 5).alias("h"), F.round("r2", 5).alias("r2"))


def multifractal(bits: DataFrame, sizes: list[int], orders: list[float]) -> DataFrame:
    """(seq_id, q, h, tau): generalised exponents for each order q (not 0), and tau = q h - 1."""
    parts = [exponent(fluctuations(bits, sizes, q)).select("seq_id", F.lit(float(q)).alias("q"), "h", F.round(q * F.col("h") - 1, 5).alias("tau")) for q in orders]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def growth(series: DataFrame) -> DataFrame:
    """(seq_id, slope, r2, median_ratio) of log length over iteration, and the median of later differences' ratios."""
    w = Window.partitionBy("seq_id").orderBy("iteration")
    fit = series.groupBy("seq_id").agg(F.regr_slope(F.ln(F.col("length").cast("double")), F.col("iteration").cast("double")).alias("slope"), F.regr_r2(F.ln(F.col("length").cast("double")), F.col("iteration").cast("double")).alias("r2"))
    diff = series.withColumn("d", F.col("length") - F.lag("length").over(w)).withColumn("r", ratio(F.col("d"), F.lag("d").over(w)))
    mid = diff.groupBy("seq_id").agg(F.percentile("r", 0.5).alias("m"))
    return fit.join(mid, "seq_id").select("seq_id", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("m", 6).alias("median_ratio"))


def trend(series: DataFrame, value: str) -> DataFrame:
    """(seq_id, slope, intercept, r, to_unity): straight line of ``value`` over iteration, and where it reaches one."""
    x, y = F.col("iteration").cast("double"), F.col(value).cast("double")
    out = series.groupBy("seq_id").agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), correlation(y, x).alias("r"))
    return out.select("seq_id", F.round("s", 6).alias("slope"), F.round("i", 6).alias("intercept"), F.round("r", 6).alias("r"), F.round(F.when(F.col("s") != 0, (1 - F.col("i")) / F.col("s")), 3).alias("to_unity"))


#: Constants that ratios are held against.
CONSTANTS = {"phi": PHI, "1/phi": 1 / PHI, "sqrt2": 2**0.5, "1/sqrt2": 0.5**0.5, "sqrt3": 3**0.5, "1/sqrt3": 3**-0.5, "e": 2.718281828459045, "1/e": 1 / 2.718281828459045, "pi/3": 1.0471975511965976, "ln2": 0.6931471805599453, "2": 2.0, "1/2": 0.5, "1": 1.0}


def constant_tests(values: DataFrame, value: str) -> DataFrame:
    """(name, n, mean, distance, z, p, effect, rank): how far the mean of ``value`` lies from each constant, in standard errors.

    p: of so large a z or a larger one, on either side; 0 from 6 standard errors on. effect: how much nearer the nearest constant is than 1,
    in standard deviations; the same in every row.
    """
    one = values.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    nearest = F.least(*[F.abs(F.col("mean") - v) for v in CONSTANTS.values()])
    one = one.withColumn("effect", F.coalesce(ratio(F.abs(F.col("mean") - CONSTANTS["1"]) - nearest, F.col("sd")), F.lit(0.0)))
    each = one.select("*", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in CONSTANTS]), F.array(*[F.lit(v) for v in CONSTANTS.values()]))).alias("name", "c"))
    d = F.abs(F.col("mean") - F.col("c"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d", "name"))  # a row per constant
    ranked = each.withColumn("d", d).withColumn("z", ratio(F.col("d"), ratio(F.col("sd"), F.sqrt("n")))).withColumn("rank", rank)
    # told before the rounded z takes its name, which lambdas would see
    ranked = ranked.withColumn("p", F.when(F.col("z") < 6, normal_p(F.col("z"))).otherwise(0.0))
    return ranked.select("name", "n", F.round("mean", 6).alias("mean"), F.round("d", 6).alias("distance"), F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), F.round("effect", 6).alias("effect"), "rank")


def singularity(spectrum: DataFrame) -> DataFrame:
    """(seq_id, q, alpha, f): slope of tau over q (one-sided at the ends), and q alpha - tau."""
    w = Window.partitionBy("seq_id").orderBy("q")  # a row per order
    before, after = F.coalesce(F.lag("tau").over(w), F.col("tau")), F.coalesce(F.lead("tau").over(w), F.col("tau"))
    q0, q1 = F.coalesce(F.lag("q").over(w), F.col("q")), F.coalesce(F.lead("q").over(w), F.col("q"))
    alpha = ratio(after - before, q1 - q0)
    return spectrum.select("seq_id", "q", F.round(alpha, 5).alias("alpha"), F.round(F.col("q") * alpha - F.col("tau"), 5).alias("f"))
