"""Rules held against many sequences, advice from their metrics, and what a sequence's length allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import bit_ngrams, ratio
from bitlab.operators.patterns import gaps
from bitlab.operators.rules import transitions

#: Structure factor, least share and Poisson expectation of a reliable sample.
STRUCTURE_FACTOR, LEAST_SHARE, LEAST_EXPECTED = 50.0, 0.05, 5
#: Bits for each cell and smallest side of a square map.
CELL_BITS, LEAST_GRID = 8, 64


def _deviation(s1: Column, s2: Column, n: Column) -> Column:
    """The population deviation from a sum, a sum of squares and a count."""
    mean = s1 / n
    return F.sqrt(F.greatest(F.lit(0.0), s2 / n - mean * mean))


def periodicity_validation(bits: DataFrame, length: int, min_count: int = 2) -> DataFrame:
    """(pattern, period, tests, accuracy, stability): how often a pattern comes again after exactly its period.

    Accuracy is over all recurrences in all sequences; stability is 1 less the deviation of the sequences' own
    shares, where sequences in which the pattern recurs but never at this period count as 0.
    """
    own = Window.partitionBy("seq_id", "pattern")
    hits = gaps(bits, length).groupBy("seq_id", "pattern", F.col("gap").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    hits = hits.withColumn("score", F.col("n").cast("double") / F.sum("n").over(own)).withColumn("one", F.when(F.row_number().over(own.orderBy("period")) == 1, 1).otherwise(0))
    per = hits.groupBy("pattern", "period").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2"))
    every = Window.partitionBy("pattern")
    out = per.withColumn("tests", F.sum("n").over(every)).withColumn("m", F.sum("one").over(every)).where(F.col("n") >= min_count)
    stability = 1 - _deviation(F.col("s1"), F.col("s2"), F.col("m"))
    return out.select("pattern", "period", "tests", F.round(F.col("n").cast("double") / F.col("tests"), 6).alias("accuracy"), F.round(stability, 6).alias("stability"))


def generic_validation(bits: DataFrame, order: int) -> DataFrame:
    """(ctx, prediction, tests, accuracy, stability) of rules "after ``ctx`` comes ``prediction``".

    Accuracy is the mean of the shares of all sequences that have the context with a bit after it; stability is 1 less
    their deviation, one half for a single sequence.
    """
    per = transitions(bits, [order])
    total = F.sum("support").over(Window.partitionBy("seq_id", "ctx"))
    scored = per.withColumn("total", total).withColumn("score", F.col("support").cast("double") / F.col("total"))
    # a bit that never follows in a sequence has the share 0 there
    other = F.when(F.col("support") == F.col("total"), F.array(F.struct("nxt", "score"), F.struct((1 - F.col("nxt")).alias("nxt"), F.lit(0.0).alias("score"))))
    each = scored.select("ctx", "total", F.explode(F.coalesce(other, F.array(F.struct("nxt", "score")))).alias("r")).select("ctx", "total", "r.*")
    out = each.groupBy("ctx", F.col("nxt").alias("prediction")).agg(
        F.sum("total").alias("tests"), F.count(F.lit(1)).alias("m"), F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2")
    ).where("s1 > 0")
    stability = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - _deviation(F.col("s1"), F.col("s2"), F.col("m")))).otherwise(0.5)
    return out.select("ctx", "prediction", "tests", F.round(F.col("s1") / F.col("m"), 6).alias("accuracy"), F.round(stability, 6).alias("stability"))


def composition_validation(bits: DataFrame, rules: DataFrame, lengths: list[int], reach: int = 20) -> DataFrame:
    """(left, right, whole, tests, accuracy, stability) of rules (left, right, whole): where ``left`` and ``right``
    follow one another, is ``whole`` within ``reach`` bits around?

    ``lengths``: those of left and right together; rules of others, and rules that never apply, have no row.
    Stability is 1 less the deviation of the sequences' shares, one half for a single sequence.
    """
    # ``reach`` blanks at both ends of each sequence, so that every occurrence has its whole surroundings
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    blank = size.select("seq_id", F.explode(F.concat(F.sequence(F.lit(0), F.lit(reach - 1)).cast("array<bigint>"), F.sequence(F.col("size") + reach, F.col("size") + 2 * reach - 1))).alias("pos"), F.lit("-").alias("bit"))
    padded = bits.select("seq_id", (F.col("pos") + reach).alias("pos"), F.col("bit").cast("string").alias("bit")).unionByName(blank)
    around = bit_ngrams(padded, [n + 2 * reach for n in lengths])
    own = F.expr(f"substring(pattern, {reach + 1}, len - {2 * reach})")
    met = around.select("seq_id", "pattern", own.alias("both")).join(rules.select("left", "right", "whole", F.concat("left", "right").alias("both")), "both")
    per = met.groupBy("left", "right", "whole", "seq_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("pattern", "whole")).alias("hits"))
    score = F.col("hits").cast("double") / F.col("n")
    out = per.groupBy("left", "right", "whole").agg(
        F.sum("n").alias("tests"), F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("m"), F.sum(score).alias("s1"), F.sum(score * score).alias("s2")
    )
    stability = F.when(F.col("m") > 1, 1 - _deviation(F.col("s1"), F.col("s2"), F.col("m"))).otherwise(0.5)
    return out.select("left", "right", "whole", "tests", F.round(F.col("hits").cast("double") / F.col("tests"), 6).alias("accuracy"), F.round(stability, 6).alias("stability"))


def stability_split(rules: DataFrame, max_drop: float = 0.1) -> DataFrame:
    """(stable, rules, mean, std, lowest, highest): stabilities on both sides of 1 - ``max_drop``."""
    return rules.groupBy((F.col("stability") >= 1 - max_drop).alias("stable")).agg(
        F.count(F.lit(1)).alias("rules"), F.round(F.avg("stability"), 6).alias("mean"), F.round(F.stddev_pop("stability"), 6).alias("std"),
        F.min("stability").alias("lowest"), F.max("stability").alias("highest"),
    )


def recommendations(rules: DataFrame, threshold: float = 0.6, max_drop: float = 0.1) -> DataFrame:
    """(rules, poor, excellent, unstable, advice): what to do about a set of rules, joined by "; ". No rules: no row."""
    out = rules.agg(
        F.count(F.lit(1)).alias("rules"), F.avg("precision").alias("mean"), F.count_if(F.col("precision") < threshold).alias("poor"),
        F.count_if((F.col("precision") > 0.9) & (F.col("stability") > 0.9)).alias("excellent"), F.count_if(F.col("stability") < 1 - max_drop).alias("unstable"),
    ).where("rules > 0")
    advice = F.concat_ws(
        "; ",
        F.when(F.col("mean") < threshold, "adjust detection"),
        F.when(F.col("poor") > 0, "drop or refine poor rules"),
        F.when(F.col("excellent") > 0, "build on excellent rules"),
        F.when(F.col("unstable") > F.col("rules") * 0.3, "widen contexts"),
    )
    return out.select("rules", "poor", "excellent", "unstable", advice.alias("advice"))


def lengths(bits: DataFrame) -> DataFrame:
    """(seq_id, length) of every sequence."""
    return bits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("length"))


def sample_plan(sizes: DataFrame, max_length: int, min_count: int = 3) -> DataFrame:
    """(seq_id, length, optimal, share, minimum, max_reliable): the sample in which patterns of ``max_length`` are met
    reliably, the least sample, and the longest pattern that the whole sequence shows reliably."""
    wanted = int(max(2 * min_count, LEAST_EXPECTED) / (2.0**-max_length * STRUCTURE_FACTOR))
    n = F.col("length")
    best = F.least(F.lit(wanted).cast("long"), n)
    return sizes.select(
        "seq_id", "length", best.alias("optimal"), F.round(ratio(best, n) * 100, 6).alias("share"), F.floor(n * LEAST_SHARE).cast("long").alias("minimum"),
        F.floor(F.log2(n * STRUCTURE_FACTOR / (2 * min_count))).cast("int").alias("max_reliable"),
    )


def grid_plan(sizes: DataFrame, most: int = 4096) -> DataFrame:
    """(seq_id, length, grid): the side of a square map with eight bits a cell, a power of two from 64 to ``most``."""
    side = F.greatest(F.lit(LEAST_GRID), F.least(F.floor(F.sqrt(F.col("length") / CELL_BITS)), F.lit(most)))
    grid = F.pow(F.lit(2), F.length(F.bin(side.cast("long"))) - 1)
    return sizes.select("seq_id", "length", grid.cast("long").alias("grid"))


def consecutive(catalog: DataFrame, needed: int = 3) -> DataFrame:
    """(seq_id, iterations, runs, ready): whether a sequence has ``needed`` iterations in a row, and how many such runs."""
    order = Window.partitionBy("seq_id").orderBy("iteration")
    found = catalog.select("seq_id", "iteration").distinct().withColumn("hit", F.lag("iteration", needed - 1).over(order) == F.col("iteration") - (needed - 1))
    out = found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("iterations"), F.count_if("hit").alias("runs"))
    return out.withColumn("ready", F.col("runs") > 0)


def growth_ratios(series: DataFrame) -> DataFrame:
    """(seq_id, iteration, ratio): each length over the one before."""
    before = F.lag("length").over(Window.partitionBy("seq_id").orderBy("iteration"))
    return series.withColumn("before", before).where("before > 0").select("seq_id", "iteration", (F.col("length").cast("double") / F.col("before")).alias("ratio"))


def ratio_histogram(ratios: DataFrame, width: float = 0.5) -> DataFrame:
    """(low, n): ratios by bins of ``width``, each from ``low`` up to the next."""
    return ratios.groupBy((F.floor(F.col("ratio") / width) * width).cast("double").alias("low")).agg(F.count(F.lit(1)).alias("n"))


def ratio_proximity(ratios: DataFrame, constants: dict[str, float]) -> DataFrame:
    """(constant, n, distance): the mean absolute distance of ratios to each constant."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("constant"), F.lit(v).alias("value")) for k, v in constants.items()]))
    far = ratios.select("ratio", each.alias("c")).select("c.constant", F.abs(F.col("ratio") - F.col("c.value")).alias("far"))
    return far.groupBy("constant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("far"), 6).alias("distance"))


def entropy_trend(strata: DataFrame) -> DataFrame:
    """(depths, mean, variance, slope) of the entropies of strata by depth; the slope is 0 for a single depth."""
    return strata.agg(
        F.count(F.lit(1)).alias("depths"), F.round(F.avg("entropy"), 6).alias("mean"), F.round(F.var_pop("entropy"), 6).alias("variance"),
        F.round(F.coalesce(F.regr_slope("entropy", "depth"), F.lit(0.0)), 6).alias("slope"),
    )
