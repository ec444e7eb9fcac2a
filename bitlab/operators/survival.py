"""Patterns over successive iterations: survival, core, gains, losses, growth; and the first place where sequences part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import ratio
from bitlab.operators.codes import gram_counts, text_of


def iteration_patterns(bits: DataFrame, lengths: range, min_count: int = 2) -> DataFrame:
    """(iteration, pattern, n) of the patterns with at least ``min_count`` occurrences in an iteration."""
    counts = gram_counts(bits, lengths, ("iteration", "seq_id")).groupBy("iteration", "len", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return counts.select("iteration", text_of(F.col("code"), F.col("len")).alias("pattern"), "n")


def survival(patterns: DataFrame) -> DataFrame:
    """(iteration, survived, lost, gained, rate) from each iteration to the next."""
    now = patterns.select("pattern", "iteration", F.lit(1).alias("here"))
    nxt = patterns.select("pattern", (F.col("iteration") - 1).alias("iteration"), F.lit(1).alias("there"))
    last = patterns.agg(F.max("iteration").alias("last"), F.min("iteration").alias("first"))
    both = now.join(nxt, ["iteration", "pattern"], "full_outer").crossJoin(F.broadcast(last)).where("iteration < last AND iteration >= first")  # one row
    out = both.groupBy("iteration").agg(F.count_if(F.col("here").isNotNull() & F.col("there").isNotNull()).alias("survived"), F.count_if(F.col("there").isNull()).alias("lost"), F.count_if(F.col("here").isNull()).alias("gained"))
    return out.withColumn("rate", F.round(ratio(F.col("survived"), F.col("survived") + F.col("lost")), 6))


def core(patterns: DataFrame) -> DataFrame:
    """(pattern, iterations, total) of the patterns that every iteration has."""
    every = patterns.agg(F.count_distinct("iteration").alias("all"))
    per = patterns.groupBy("pattern").agg(F.count_distinct("iteration").alias("iterations"), F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(every)).where(F.col("iterations") == F.col("all")).drop("all")  # one row


def growth_ratios(patterns: DataFrame) -> DataFrame:
    """(pattern, iteration, n, ratio): a pattern's count over that in the iteration before, where that is the one just before."""
    w = Window.partitionBy("pattern").orderBy("iteration")
    out = patterns.withColumn("was", F.lag("n").over(w)).withColumn("it", F.lag("iteration").over(w)).where("it = iteration - 1")
    return out.select("pattern", "iteration", "n", F.round(F.col("n").cast("double") / F.col("was"), 6).alias("ratio"))


def lifespans(patterns: DataFrame) -> DataFrame:
    """(span, patterns, mean_total): patterns by number of iterations from first to last, and their mean occurrences."""
    per = patterns.groupBy("pattern").agg((F.max("iteration") - F.min("iteration") + 1).cast("int").alias("span"), F.sum("n").alias("total"))
    return per.groupBy("span").agg(F.count(F.lit(1)).alias("patterns"), F.round(F.avg("total"), 6).alias("mean_total"))


def best_threshold(patterns: DataFrame) -> DataFrame:
    """(threshold, accuracy, lost_below, lost_above, survived_below, survived_above): the count that tells best which patterns survive to the next iteration.

    Every count is a candidate; a pattern is told rightly if it is lost and below, or survives and is not. Of equals the smallest.
    """
    nxt = patterns.select("pattern", (F.col("iteration") - 1).alias("iteration"), F.lit(1).alias("there"))
    last = patterns.agg(F.max("iteration").alias("last"))
    flagged = patterns.crossJoin(F.broadcast(last)).where("iteration < last").join(nxt, ["iteration", "pattern"], "left")  # one row
    per = flagged.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.count("there").alias("s"))
    every, below = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct count
    sums = per.select("n", *[F.coalesce(F.sum(x).over(below), F.lit(0)).alias(f"{x}_below") for x in "ks"], *[F.sum(x).over(every).alias(f"{x}_all") for x in "ks"])
    lost_below, survived_above = F.col("k_below") - F.col("s_below"), F.col("s_all") - F.col("s_below")
    rated = sums.withColumn("right", lost_below + survived_above).orderBy(F.desc("right"), "n").limit(1)
    lost_above = F.col("k_all") - F.col("s_all") - lost_below
    return rated.select(F.col("n").alias("threshold"), F.round(F.col("right").cast("double") / F.col("k_all") * 100, 6).alias("accuracy"), lost_below.alias("lost_below"), lost_above.alias("lost_above"), F.col("s_below").alias("survived_below"), survived_above.alias("survived_above"))


def curvature(steps: DataFrame) -> DataFrame:
    """(iteration, curvature): change of gains from one step to the next over all changes of the two."""
    w = Window.partitionBy(F.lit(0)).orderBy("iteration")  # a row per iteration
    now, nxt = F.col("gained") - F.col("lost"), F.lead(F.col("gained") - F.col("lost")).over(w)
    every = F.col("gained") + F.col("lost") + F.lead(F.col("gained") + F.col("lost")).over(w)
    return steps.withColumn("c", F.when(every > 0, F.abs(nxt - now).cast("double") / every)).where("c IS NOT NULL").select("iteration", F.round("c", 6).alias("curvature"))


def first_divergence(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(*on, first, same): the first position where two sequences differ or one ends, and the length of the equal prefix.

    A full outer join on position; nothing is ordered globally.
    """
    a = left.select(*on, "pos", F.col("bit").alias("a"))
    b = right.select(*on, "pos", F.col("bit").alias("b"))
    both = a.join(b, [*on, "pos"], "full_outer")
    out = both.groupBy(*on).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos"))).alias("first"), F.count(F.lit(1)).alias("size"))
    return out.select(*on, "first", F.coalesce("first", "size").alias("same"))
