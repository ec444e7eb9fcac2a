"""Patterns: n-gram mining, recurrence, tiles and periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import bit_ngrams
from bitlab.operators.codes import WORD, gram_counts, text_of, tile_counts


def pattern_counts(bits: DataFrame, lengths: range, min_count: int = 2, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, len, pattern, n, first_pos) of the patterns that occur at least ``min_count`` times."""
    if max(lengths) <= WORD:
        counts = gram_counts(bits, lengths, keys).where(F.col("n") >= min_count)
        return counts.select(*keys, "len", text_of(F.col("code"), F.col("len")).alias("pattern"), "n", "first_pos")
    grams = bit_ngrams(bits, lengths, keys=keys)
    return grams.groupBy(*keys, "len", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).where(F.col("n") >= min_count)


def saturation(bits: DataFrame, lengths: range) -> DataFrame:
    """(seq_id, len, windows, patterns, ratio): how many windows of a length are distinct."""
    out = pattern_counts(bits, lengths, 1).groupBy("seq_id", "len").agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("patterns"))
    return out.withColumn("ratio", F.round(F.col("patterns").cast("double") / F.col("windows"), 6))


def top_patterns(counts: DataFrame, total: DataFrame, n: int) -> DataFrame:
    """The ``n`` patterns of highest recurrence, with density n * len / N and an id of the pattern's hash."""
    best = counts.orderBy(F.desc("n"), "len", "pattern").limit(n)
    ident = F.concat(F.lit("sw_"), F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8))
    return best.join(total, "seq_id").select(ident.alias("pattern_id"), "len", "pattern", "n", F.round(F.col("n").cast("double") * F.col("len") / F.col("size"), 6).alias("density"))


def gaps(bits: DataFrame, length: int, size: int = 1 << 16) -> DataFrame:
    """(seq_id, pattern, pos, gap): distance to the next occurrence of the same pattern.

    Within parts of ``size`` positions first; a part's last occurrence takes the first of the next part that has any.
    """
    grams = bit_ngrams(bits, [length]).withColumn("part", F.floor(F.col("pos") / size))
    inside = F.lead("pos").over(Window.partitionBy("seq_id", "pattern", "part").orderBy("pos"))
    first = grams.groupBy("seq_id", "pattern", "part").agg(F.min("pos").alias("first"))
    later = first.withColumn("then", F.lead("first").over(Window.partitionBy("seq_id", "pattern").orderBy("part"))).drop("first")
    out = grams.withColumn("nxt", inside).join(later, ["seq_id", "pattern", "part"])
    return out.select("seq_id", "pattern", "pos", (F.coalesce("nxt", "then") - F.col("pos")).alias("gap")).where("gap IS NOT NULL")


def periodicity(bits: DataFrame, length: int, min_count: int = 2) -> DataFrame:
    """(seq_id, pattern, period, n, confidence): gaps that recur, of patterns with three occurrences or more."""
    per = gaps(bits, length).groupBy("seq_id", "pattern", F.col("gap").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(Window.partitionBy("seq_id", "pattern"))
    out = per.withColumn("gaps", every).where(F.col("gaps") >= 2).where(F.col("n") >= min_count)
    return out.select("seq_id", "pattern", "period", "n", F.round(F.col("n").cast("double") / F.col("gaps"), 6).alias("confidence"))


def recurrence(bits: DataFrame, length: int) -> DataFrame:
    """(seq_id, pattern, gaps, mean_gap, std_gap) of each pattern's recurrences."""
    out = gaps(bits, length).groupBy("seq_id", "pattern").agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))
    return out.withColumn("mean_gap", F.round("mean_gap", 6)).withColumn("std_gap", F.round("std_gap", 6))


def positions(bits: DataFrame, lengths: range, most: int = 100) -> DataFrame:
    """(seq_id, pattern, n, positions): each pattern's count and its first ``most`` positions, a sample for reading; counts are of all."""
    grams = bit_ngrams(bits, lengths)
    n = grams.groupBy("seq_id", "pattern").agg(F.count(F.lit(1)).alias("n"))
    first = grams.withColumn("r", F.row_number().over(Window.partitionBy("seq_id", "pattern").orderBy("pos"))).where(F.col("r") <= most)
    return first.groupBy("seq_id", "pattern").agg(F.sort_array(F.collect_list("pos")).alias("positions")).join(n, ["seq_id", "pattern"]).select("seq_id", "pattern", "n", "positions")


def merged(*found: DataFrame, min_length: int = 2, min_count: int = 2) -> DataFrame:
    """(pattern, method, n): the patterns of several methods as one set; of equal patterns the one of highest count, then the first method by name."""
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    best = F.min(F.struct((-F.col("n")).alias("less"), "method")).alias("b")
    out = every.groupBy("pattern").agg(best).select("pattern", "b.method", (-F.col("b.less")).alias("n"))
    return out.where((F.length("pattern") >= min_length) & (F.col("n") >= min_count))


def autosimilarity(counts: DataFrame) -> DataFrame:
    """``counts`` with the mean autocorrelation of each pattern of four bits or more over its lags, in shares of its ones; 0 for shorter ones or none."""
    bits = F.transform(F.split("pattern", ""), lambda x: x.cast("int"))
    n = F.length("pattern")
    lag = lambda k: F.aggregate(F.zip_with(F.slice("bits", 1, n - k), F.slice("bits", k + 1, n), lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda a, b: a + b)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), lag), F.lit(0), lambda a, b: a + b)
    ones = F.aggregate("bits", F.lit(0), lambda a, b: a + b)
    mean = total.cast("double") / F.greatest(ones, F.lit(1)) / (n - 1)
    return counts.withColumn("bits", bits).withColumn("autosimilarity", F.round(F.when(n >= 4, mean).otherwise(0.0), 6)).drop("bits")


def tiles(bits: DataFrame, periods: list[int], min_count: int = 2) -> DataFrame:
    """(seq_id, period, tile, n): identical tiles when the sequence is cut at multiples of a period."""
    short = [p for p in periods if p <= WORD]
    per = [tile_counts(bits, short).select("seq_id", F.col("len").alias("period"), text_of(F.col("code"), F.col("len")).alias("tile"), "n")] if short else []
    for p in periods:
        if p > WORD:
            per.append(bit_ngrams(bits, [p], step=p).groupBy("seq_id", F.col("len").alias("period"), F.col("pattern").alias("tile")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, per).where(F.col("n") >= min_count)


def compositions(counts: DataFrame) -> DataFrame:
    """(seq_id, left, right, whole, n_left, n_right, n_whole): counted patterns that join to a counted pattern.

    All splits of each whole are generated and looked up twice; no pairs of patterns are formed.
    """
    split = counts.select("seq_id", F.col("pattern").alias("whole"), F.col("n").alias("n_whole"), F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("cut"))
    split = split.select("seq_id", "whole", "n_whole", F.col("whole").substr(F.lit(1), F.col("cut")).alias("left"), F.expr("substring(whole, cut + 1)").alias("right")).where("left <> right")
    left = counts.select("seq_id", F.col("pattern").alias("left"), F.col("n").alias("n_left"))
    right = counts.select("seq_id", F.col("pattern").alias("right"), F.col("n").alias("n_right"))
    return split.join(left, ["seq_id", "left"]).join(right, ["seq_id", "right"]).select("seq_id", "left", "right", "whole", "n_left", "n_right", "n_whole")


def overlaps(counts: DataFrame) -> DataFrame:
    """(seq_id, left, right, overlap, whole): the longest proper overlap by which two counted patterns make a counted one.

    Suffixes of the left are equi-joined with prefixes of the right on the overlap's text.
    """
    each = counts.select("seq_id", "pattern", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("overlap"))
    suffix = each.select("seq_id", "overlap", F.col("pattern").alias("left"), F.expr("right(pattern, overlap)").alias("shared"))
    prefix = each.select("seq_id", "overlap", F.col("pattern").alias("right"), F.expr("left(pattern, overlap)").alias("shared"))
    whole = counts.select("seq_id", F.col("pattern").alias("whole"))
    pairs = suffix.join(prefix, ["seq_id", "overlap", "shared"]).where("left <> right").select("seq_id", "left", "right", "overlap", F.expr("concat(left, substring(right, overlap + 1))").alias("whole"))
    best = F.row_number().over(Window.partitionBy("seq_id", "left", "right").orderBy(F.desc("overlap")))
    return pairs.join(whole, ["seq_id", "whole"]).withColumn("r", best).where("r = 1").select("seq_id", "left", "right", "overlap", "whole")


def torsion(bits: DataFrame, patterns: list[str], segments: int) -> DataFrame:
    """(seq_id, pattern, mean, torsion): variance over mean of a pattern's counts in equal segments, windows inside one only."""
    size = bits.groupBy("seq_id").agg(F.floor((F.max("pos") + 1) / segments).cast("long").alias("seg_size")).where("seg_size > 0")
    lengths = sorted({len(p) for p in patterns})
    grams = bit_ngrams(bits, lengths).where(F.col("pattern").isin(patterns)).join(size, "seq_id")
    seg = F.floor(F.col("pos") / F.col("seg_size")).cast("int")
    inside = grams.withColumn("seg", seg).where((F.col("seg") < segments) & (F.col("pos") + F.col("len") <= (F.col("seg") + 1) * F.col("seg_size")))
    per = inside.groupBy("seq_id", "pattern", "seg").count()
    sums = per.groupBy("seq_id", "pattern").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("ss"))
    mean = F.col("s").cast("double") / segments
    var = F.col("ss").cast("double") / segments - mean * mean
    return sums.select("seq_id", "pattern", F.round(mean, 6).alias("mean"), F.round(var / mean, 6).alias("torsion"))
