"""Rules: transitions, context index, precision, stability and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.codes import gram_counts, text_of


def transitions(bits: DataFrame, orders: list[int], min_total: int = 1, min_confidence: float = 0.0, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, ord, ctx, nxt, support, confidence): which bit follows the ``ord`` bits of a context."""
    counts = gram_counts(bits, [o + 1 for o in orders], keys)
    per = counts.select(*keys, (F.col("len") - 1).alias("ord"), _context().alias("ctx"), (F.col("code") % 2).cast("int").alias("nxt"), F.col("n").alias("support"))
    total = F.sum("support").over(Window.partitionBy(*keys, "ord", "ctx"))
    out = per.withColumn("total", total).withColumn("confidence", F.col("support").cast("double") / F.col("total"))
    return out.where((F.col("total") >= min_total) & (F.col("confidence") >= min_confidence)).select(*keys, "ord", "ctx", "nxt", "support", F.round("confidence", 6).alias("confidence"))


def _context() -> Column:
    """All bits of a window but the last, as a string."""
    return text_of(F.call_function("shiftright", F.col("code"), F.lit(1)), F.col("len") - 1)


def transition_matrix(trans: DataFrame) -> DataFrame:
    """(seq_id, ctx, p0, p1): confidences by next bit."""
    return trans.groupBy("seq_id", "ctx").pivot("nxt", [0, 1]).agg(F.max("confidence")).select("seq_id", "ctx", F.col("0").alias("p0"), F.col("1").alias("p1"))


def context_index(bits: DataFrame, lengths: list[int], segments: int = 4) -> DataFrame:
    """(seq_id, ctx_len, ctx, segment, n, c0, c1), and segment -1 for the total over all segments.

    Segments are equal parts by position, what is left belonging to the last one.
    """
    rows = gram_counts(bits, [n + 1 for n in lengths], segments=segments).select("seq_id", (F.col("len") - 1).alias("ctx_len"), _context().alias("ctx"), "segment", (F.col("code") % 2).alias("nxt"), "n")
    ones = F.sum(F.col("n") * F.col("nxt"))
    per = rows.groupBy("seq_id", "ctx_len", "ctx", "segment").agg(F.sum("n").alias("n"), (F.sum("n") - ones).alias("c0"), ones.alias("c1"))
    total = per.groupBy("seq_id", "ctx_len", "ctx").agg(F.sum("n").alias("n"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).withColumn("segment", F.lit(-1))
    return per.unionByName(total)


def rule_metrics(index: DataFrame) -> DataFrame:
    """(seq_id, ctx_len, ctx, prediction, support, precision, stability, reproducibility) of the rule that each context makes.

    The prediction is the commoner next bit (0 in a tie); stability is the mean less the population
    deviation of its share over segments, not below zero; reproducibility the share of all segments in which
    the prediction comes true at least once.
    """
    segments = index.where("segment >= 0").groupBy("seq_id").agg((F.max("segment") + 1).alias("segments"))
    total = index.where("segment = -1").select("seq_id", "ctx_len", "ctx", F.when(F.col("c1") > F.col("c0"), 1).otherwise(0).alias("prediction"), F.col("n").alias("support"), (F.greatest("c0", "c1").cast("double") / F.col("n")).alias("precision"))
    per = index.where("segment >= 0").join(total.select("seq_id", "ctx_len", "ctx", "prediction"), ["seq_id", "ctx_len", "ctx"])
    share = F.when(F.col("prediction") == 1, F.col("c1")).otherwise(F.col("c0")).cast("double") / F.col("n")
    stable = per.groupBy("seq_id", "ctx_len", "ctx").agg(F.greatest(F.lit(0.0), F.avg(share) - F.stddev_pop(share)).alias("stability"), F.count_if(share > 0).alias("true_in"))
    out = total.join(stable, ["seq_id", "ctx_len", "ctx"]).join(segments, "seq_id")
    reproduced = F.col("true_in").cast("double") / F.col("segments")
    return out.select("seq_id", "ctx_len", "ctx", "prediction", "support", *[F.round(x, 6).alias(x) for x in ("precision", "stability")], F.round(reproduced, 6).alias("reproducibility"))


def rule_complexity(rules: DataFrame) -> DataFrame:
    """Rules with a description, complexity (text length / 100 + 1 + half the order), quality and whether they are trivial."""
    text = F.concat(F.lit("after "), F.col("ctx"), F.lit(" comes "), F.col("prediction").cast("string"))
    complexity = F.length(text) / 100.0 + 1.0 + 0.5 * F.col("ctx_len")
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 * F.col("reproducibility") + 0.25 * F.col("stability") + 0.25 * F.col("precision") + 0.2 * F.greatest(F.lit(0.0), 1.0 - complexity / 10.0)))
    trivial = ((F.col("precision") == 1) & (F.col("support") <= 1)) | (F.col("precision") < 0.8)
    return rules.select("seq_id", "ctx", text.alias("description"), F.round(complexity, 6).alias("complexity"), F.round(quality, 6).alias("quality"), trivial.alias("trivial"))


def validation_summary(rules: DataFrame, threshold: float = 0.6, max_drop: float = 0.1) -> DataFrame:
    """(seq_id, rules, mean_precision, std_precision, mean_stability, valid, stable, weakest)."""
    out = rules.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("rules"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.stddev_pop("precision"), 6).alias("std_precision"),
        F.round(F.avg("stability"), 6).alias("mean_stability"), F.count_if(F.col("precision") >= threshold).alias("valid"),
        F.count_if(F.col("stability") >= 1 - max_drop).alias("stable"), F.min("stability").alias("weakest"),
    )
    return out


def kfold(bits: DataFrame, order: int, folds: int) -> DataFrame:
    """(ctx, mean_accuracy, std_accuracy, folds): rules learned on all sequences, tested on folds of whole sequences.

    Sequences are dealt to folds by the MD5 of their id; a fold's accuracy is how often a context's overall commoner bit follows.
    """
    trans = transitions(bits, [order])
    fold = (F.conv(F.substring(F.md5(F.col("seq_id").cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")
    per = trans.groupBy("ctx").agg(F.sum(F.col("support") * F.col("nxt")).alias("ones"), F.sum("support").alias("n")).select("ctx", F.when(2 * F.col("ones") > F.col("n"), 1).otherwise(0).alias("prediction"))
    test = trans.withColumn("fold", fold).join(per, "ctx").groupBy("ctx", "fold").agg((F.sum(F.when(F.col("nxt") == F.col("prediction"), F.col("support")).otherwise(0)).cast("double") / F.sum("support")).alias("acc"))
    return test.groupBy("ctx").agg(F.round(F.avg("acc"), 6).alias("mean_accuracy"), F.round(F.stddev_pop("acc"), 6).alias("std_accuracy"), F.count(F.lit(1)).alias("folds"))


def conditional(bits: DataFrame, k: int = 5) -> DataFrame:
    """(seq_id, h, h_given): entropy of a bit, and given the ``k`` bits before it, in bits."""
    trans = transitions(bits, [k])
    total = F.sum("support").over(Window.partitionBy("seq_id"))
    p, q = F.col("support").cast("double") / F.col("t"), F.col("support").cast("double") / F.col("c")
    cond = trans.withColumn("t", total).withColumn("c", F.sum("support").over(Window.partitionBy("seq_id", "ctx"))).groupBy("seq_id").agg((-F.sum(p * F.log2(q))).alias("h_given"))
    one = F.avg(F.col("bit").cast("double"))
    flat = bits.groupBy("seq_id").agg(one.alias("p1")).select("seq_id", (-F.when((F.col("p1") > 0) & (F.col("p1") < 1), F.col("p1") * F.log2("p1") + (1 - F.col("p1")) * F.log2(1 - F.col("p1"))).otherwise(0.0)).alias("h"))
    return flat.join(cond, "seq_id")


def causality(bits: DataFrame, k: int = 5) -> DataFrame:
    """(seq_id, h, h_given, predictability): entropy of a bit, and given the ``k`` bits before it."""
    share = F.when(F.col("h") > 0, F.greatest(F.lit(0.0), 1 - F.col("h_given") / F.col("h"))).otherwise(1.0)
    return conditional(bits, k).select("seq_id", F.round("h", 6).alias("h"), F.round("h_given", 6).alias("h_given"), F.round(share, 6).alias("predictability"))


def distinct_rules(trans: DataFrame, most: int = 10_000) -> DataFrame:
    """(ctx, nxt, support, confidence): of equal rules of several sequences the one of highest confidence, then support; the ``most`` most confident, a report's limit."""
    best = F.max(F.struct("confidence", "support")).alias("b")
    rules = trans.groupBy("ctx", "nxt").agg(best).select("ctx", "nxt", "b.support", "b.confidence")
    return rules.orderBy(F.desc("confidence"), F.desc("support"), "ctx", "nxt").limit(most)
