"""Reports, tests and composites over patterns, rules and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.functions.tails import significance, t_p, t_quantile
from bitlab.operators.chunks import bit_ngrams, ratio
from bitlab.operators.codes import text_of, tile_counts

PHI = (1 + 5**0.5) / 2


def pair_balance(bits: DataFrame, halves: int = 2) -> DataFrame:
    """(seq_id, part, n01, n10, ratio, density): rises, falls and share of ones in equal parts."""
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    part = F.least(F.floor(F.col("pos") * halves / F.col("size")), F.lit(halves - 1)).cast("int")
    grams = bit_ngrams(bits, [2]).join(size, "seq_id").groupBy("seq_id", part.alias("part")).agg(F.count_if(F.col("pattern") == "01").alias("n01"), F.count_if(F.col("pattern") == "10").alias("n10"))
    ones = bits.join(size, "seq_id").groupBy("seq_id", part.alias("part")).agg(F.round(F.avg("bit"), 6).alias("density"))
    return grams.join(ones, ["seq_id", "part"]).select("seq_id", "part", "n01", "n10", F.round(ratio(F.col("n01"), F.col("n10")), 6).alias("ratio"), "density")


def pattern_report(counts: DataFrame) -> DataFrame:
    """(len, patterns, occurrences, mean, highest) by length."""
    return counts.groupBy("len").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("occurrences"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("highest"))


def confidence_histogram(trans: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, rules, support): confidences in equal bins of 0 to 1."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return trans.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("rules"), F.sum("support").alias("support"))


def rule_report(trans: DataFrame) -> DataFrame:
    """(rules, mean_confidence, sure, likely, cv_support, diversity): shares at .99 and .9, spread of supports, distinct contexts over rules."""
    return trans.agg(
        F.count(F.lit(1)).alias("rules"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg((F.col("confidence") >= 0.99).cast("double")), 6).alias("sure"), F.round(F.avg((F.col("confidence") >= 0.9).cast("double")), 6).alias("likely"),
        F.round(ratio(F.stddev_pop("support"), F.avg("support")), 6).alias("cv_support"), F.round(ratio(F.count_distinct("ctx"), F.count(F.lit(1))), 6).alias("diversity"),
    )


def contexts_around(bits: DataFrame, pattern: str, width: int, min_count: int = 2) -> DataFrame:
    """(seq_id, side, ctx, n, confidence): what stands before and after a pattern, as shares of its occurrences that have so much room."""
    grams = bit_ngrams(bits, [len(pattern) + width])
    before = grams.where(F.expr(f"right(pattern, {len(pattern)})") == pattern).select("seq_id", F.lit("before").alias("side"), F.expr(f"left(pattern, {width})").alias("ctx"))
    after = grams.where(F.expr(f"left(pattern, {len(pattern)})") == pattern).select("seq_id", F.lit("after").alias("side"), F.expr(f"right(pattern, {width})").alias("ctx"))
    per = before.unionByName(after).groupBy("seq_id", "side", "ctx").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("seq_id", "side"))
    return per.withColumn("confidence", F.round(F.col("n").cast("double") / total, 6)).where(F.col("n") >= min_count)


def common_substrings(contexts: DataFrame, lengths: range) -> DataFrame:
    """(side, part, n): in how many contexts (weighted by their counts) each substring occurs, once each."""
    def cut(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("ctx") - (k - 1)), lambda i: F.substring(F.col("ctx"), i, F.lit(k)))

    parts = [cut(k) for k in lengths]
    usable = contexts.where(F.length("ctx") >= max(lengths))
    return usable.select("side", "n", F.explode(F.array_distinct(F.concat(*parts))).alias("part")).groupBy("side", "part").agg(F.sum("n").alias("n"))


def block_similarity(bits: DataFrame, size: int) -> DataFrame:
    """(a, b, match): share of equal bits between all distinct blocks of a size up to 10, of which there are at most 1,024."""
    if size > 10:
        raise ValueError("blocks of more than 10 bits are too many to be compared with each other")
    code = tile_counts(bits, [size]).select(F.col("code").alias("ca")).distinct().select(text_of(F.col("ca"), F.lit(size)).alias("a"), "ca")
    other = code.toDF("b", "cb")
    return code.join(F.broadcast(other), F.col("a") < F.col("b")).select("a", "b", F.round(1 - F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))).cast("double") / size, 6).alias("match"))


def similar_groups(pairs: DataFrame, min_match: float) -> DataFrame:
    """(a, neighbours): how many others are as similar as ``min_match``; two or more make a core of a cluster."""
    near = pairs.where(F.col("match") >= min_match)
    both = near.select("a").unionAll(near.select(F.col("b").alias("a")))
    return both.groupBy("a").agg(F.count(F.lit(1)).alias("neighbours"))


def phi_coherence(gaps: DataFrame, length: int) -> DataFrame:
    """(patterns, coherence): mean of 1 - |mean gap / length - phi| / phi over patterns, weighted by their number of gaps."""
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.col("mean_gap") / length - PHI) / PHI)
    return gaps.agg(F.count(F.lit(1)).alias("patterns"), F.round(ratio(F.sum(score * F.col("gaps")), F.sum("gaps")), 6).alias("coherence"))


def position_torsion(bits: DataFrame, length: int, segments: int, flag: float = 0.1, most: int = 50) -> DataFrame:
    """(seq_id, pattern, torsion, flagged): variance over squared mean of a pattern's counts in segments, the highest first."""
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    seg = F.least(F.floor(F.col("pos") * segments / F.col("size")), F.lit(segments - 1))
    per = bit_ngrams(bits, [length]).join(size, "seq_id").groupBy("seq_id", "pattern", seg.alias("seg")).count()
    sums = per.groupBy("seq_id", "pattern").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("ss"))
    mean = F.col("s").cast("double") / segments
    t = F.round((F.col("ss").cast("double") / segments - mean * mean) / (mean * mean), 6)
    return sums.select("seq_id", "pattern", t.alias("torsion"), (t > flag).alias("flagged")).orderBy(F.desc("torsion"), "pattern").limit(most)


def scaling_exponent(points: DataFrame) -> DataFrame:
    """(points, exponent): sample covariance over population variance of the logs of (n, t), as the published rule has it."""
    x, y = F.ln(F.col("n").cast("double")), F.ln(F.col("t").cast("double"))
    return points.where("n > 0 AND t > 0").agg(F.count(F.lit(1)).alias("points"), F.round(ratio(F.covar_samp(y, x), F.var_pop(x)), 6).alias("exponent"))


def position_scores(bits: DataFrame, ctx: str, prediction: int) -> DataFrame:
    """(seq_id, tp, fp, fn, precision, recall, f1) of "after ctx comes prediction" against the positions of that bit."""
    k = len(ctx)
    grams = bit_ngrams(bits, [k + 1])
    said, is_so = F.expr(f"left(pattern, {k})") == ctx, F.expr("right(pattern, 1)") == str(prediction)
    out = grams.groupBy("seq_id").agg(F.count_if(said & is_so).alias("tp"), F.count_if(said & ~is_so).alias("fp"), F.count_if(~said & is_so).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("seq_id", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def autocorrelation(bits: DataFrame, lags: int) -> DataFrame:
    """(seq_id, lag, n, r): mean product of centred bits some positions apart over their variance."""
    mean = bits.groupBy("seq_id").agg(F.avg("bit").alias("m"), F.var_pop("bit").alias("v"))
    x = bits.join(mean, "seq_id").select("seq_id", "pos", (F.col("bit") - F.col("m")).alias("x"), "v")
    left = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select("seq_id", "lag", (F.col("pos") + F.col("lag")).alias("pos"), F.col("x").alias("y"))
    out = x.join(left, ["seq_id", "pos"]).groupBy("seq_id", "lag").agg(F.count(F.lit(1)).alias("n"), ratio(F.avg(F.col("x") * F.col("y")), F.first("v")).alias("r"))
    return out.select("seq_id", "lag", "n", F.round("r", 6).alias("r"))


def forecast(series: DataFrame, value: str, ahead: int, outside: float = 0.05) -> DataFrame:
    """(seq_id, n, target, expected, error, low, high, p): a straight line carried ``ahead`` iterations on.

    error is the standard error of prediction; low and high bound all but ``outside`` of it, by Student's distribution with n - 2
    degrees of freedom; p is how likely so steep a slope is without a trend. All four are null for fewer than three iterations.
    """
    x, y = F.col("iteration").cast("double"), F.col(value).cast("double")
    fit = series.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max("iteration").alias("last"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mx"))
    at = F.col("last") + ahead
    mse = ratio(F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"), F.col("n") - 2)
    far = (at - F.col("mx")) * (at - F.col("mx"))
    fit = fit.withColumn("mse", F.when(F.col("n") > 2, F.greatest(F.lit(0.0), mse)))
    fit = fit.withColumn("se", F.sqrt(F.col("mse") * (1 + 1 / F.col("n") + ratio(far, F.col("sxx"))))).withColumn("expected", F.col("a") + F.col("b") * at)
    df = (F.col("n") - 2).cast("double")
    reach = t_quantile(outside, df) * F.col("se")
    slope_se = F.sqrt(ratio(F.col("mse"), F.col("sxx")))
    p = F.when(slope_se > 0, t_p(F.col("b") / slope_se, df))
    return fit.select("seq_id", "n", at.alias("target"), F.round("expected", 4).alias("expected"), F.round("se", 4).alias("error"), F.round(F.col("expected") - reach, 3).alias("low"), F.round(F.col("expected") + reach, 3).alias("high"), F.round(p, 6).alias("p"))


def permutation_test(nulls: DataFrame, observed: DataFrame, null: str = "null", value: str = "observed") -> DataFrame:
    """(observed, alternative, n, null_mean, z, p, class): ``observed``, one row, against values under the null hypothesis.

    p is the share of null values at least as large ("greater"), at most as large ("less"), or at least as far from their mean ("two-sided").
    z is null where null values do not vary and the observed one is not theirs, and 0 where it is.
    """
    mean = nulls.agg(F.count(null).alias("n"), F.avg(null).alias("m"), F.stddev_pop(null).alias("sd"))
    every = nulls.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(observed.select(F.col(value).cast("double").alias("o"))))  # one row each
    x, o, m = F.col(null), F.col("o"), F.col("m")
    share = {"greater": x >= o, "less": x <= o, "two-sided": F.abs(x - m) >= F.abs(o - m)}
    sums = every.groupBy("o", "n", "m", "sd").agg(*[F.avg(c.cast("double")).alias(k) for k, c in share.items()])
    out = sums.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("alternative"), F.col(k).alias("p")) for k in share])).alias("x"))
    z = F.when(F.col("sd") < 1e-10, F.when(F.abs(o - m) < 1e-10, 0.0)).otherwise((o - m) / F.col("sd"))
    return out.select(o.alias("observed"), "x.alternative", "n", F.round(m, 6).alias("null_mean"), F.round(z, 6).alias("z"), F.round("x.p", 6).alias("p"), significance(F.col("x.p")).alias("class"))


def bootstrap_mean(values: DataFrame, value: str, key: list[str], replicates: int = 96) -> DataFrame:
    """(n, mean, low, high): 95 % interval of the mean; each row enters a replicate a Poisson(1) number of times.

    The numbers come from MD5 of the row's ``key``, eight replicates from each, so they do not depend on partitions. Rows of a replicate
    are summed where they are; only sums are shuffled.
    """
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    digest = F.explode(F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // 8) - 1)), lambda g: F.struct(g.alias("g"), F.md5(F.concat_ws("|", name, g.cast("string")).cast("binary")).alias("h"))))
    each = values.select(F.col(value).alias("v"), digest.alias("d"))

    def weight(i: int) -> Column:
        u = F.conv(F.substring("d.h", 4 * i + 1, 4), 16, 10).cast("int")  # of 65,536
        return F.when(u < 24109, 0).when(u < 48219, 1).when(u < 60273, 2).when(u < 64292, 3).when(u < 65296, 4).otherwise(5)

    sums = each.groupBy("d.g").agg(*[x for i in range(8) for x in (F.sum(F.col("v") * weight(i)).alias(f"a{i}"), F.sum(weight(i)).alias(f"w{i}"))])
    means = sums.select(F.explode(F.array(*[ratio(F.col(f"a{i}"), F.col(f"w{i}")) for i in range(8)])).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return values.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).crossJoin(F.broadcast(ends))  # one row each


def sensitivity(parts: DataFrame, weights: dict[str, float], step: float = 0.1, floor: float = 0.05) -> DataFrame:
    """(weight, change, index): an index of the row's parts as one weight at a time is moved and all are scaled back to one."""
    rows = []
    for k in weights:
        for change in (-step, step):
            moved = {**weights, k: max(floor, weights[k] + change)}
            total = sum(moved.values())
            index: Column = sum((F.col(p) * (w / total) for p, w in moved.items()), F.lit(0.0))
            rows.append(F.struct(F.lit(k).alias("weight"), F.lit(change).alias("change"), F.round(index, 6).alias("index")))
    return parts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def classify(value: Column, bands: list[tuple[float, str]], top: str, closed: bool = False) -> Column:
    """The name of the first band whose upper bound exceeds the value; if ``closed``, the last bound belongs to its band. Null for null."""
    out = F.lit(top)
    for i, (bound, name) in enumerate(reversed(bands)):
        out = F.when(value <= bound if closed and i == 0 else value < bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


#: Upper bounds of classes of scaling exponents and of mutual information.
HURST = [(0.4, "anti-persistent"), (0.6, "uncorrelated"), (0.85, "persistent"), (1.1, "critical")]
INFORMATION = [(0.01, "none"), (0.05, "weak"), (0.1, "moderate")]


def complexity_index(h: Column, entropy_rate: Column, te_up: Column) -> Column:
    """A composite of criticality (Hurst exponent near 0.5 to 1), structure (less than full entropy) and transfer, within 0 and 1."""
    critical = F.greatest(F.lit(0.0), 1 - F.abs(h - 0.75) / 0.75)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * critical + 0.3 * (1 - entropy_rate) + 0.3 * F.least(F.lit(1.0), te_up * 10)))


def energy(steps: DataFrame, curvature: float = 1.0, torsion: float = 1.0, loss: float = 1.0) -> DataFrame:
    """``steps`` (curvature, t, rate) with energy: weighted squares of curvature and torsion t, and the share that is lost."""
    return steps.withColumn("energy", curvature * F.col("curvature") * F.col("curvature") + torsion * F.col("t") * F.col("t") + loss * (1 - F.col("rate")))
