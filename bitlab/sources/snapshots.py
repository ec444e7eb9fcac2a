"""Snapshots: sequences by (variant, iteration) as partitioned Parquet, with their metadata; scans and samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(symbols: DataFrame, path: str) -> None:
    """Write (variant, iteration, pos, sym); one folder for each variant and iteration."""
    symbols.repartition("variant", "iteration", F.floor(F.col("pos") / 1_000_000)).sortWithinPartitions("pos").write.partitionBy("variant", "iteration").mode("append").parquet(path)


def load(spark: SparkSession, path: str, variant: str | None = None, first: int | None = None, last: int | None = None, limit: int | None = None, clean: bool = False) -> DataFrame:
    """A variant's iterations from ``first`` to ``last``, the first ``limit`` symbols of each, without parentheses if ``clean``.

    All but the last are filters that reach the scan.
    """
    out = spark.read.parquet(path)
    if variant is not None:
        out = out.where(F.col("variant") == variant)
    if first is not None:
        out = out.where(F.col("iteration") >= first)
    if last is not None:
        out = out.where(F.col("iteration") <= last)
    if limit is not None:
        out = out.where(F.col("pos") < limit)
    return out.where(F.col("sym").isin("0", "1")) if clean else out


def catalog(symbols: DataFrame) -> DataFrame:
    """(variant, iteration, length, ones, zeros, opens, balanced) of each snapshot."""
    n = lambda s: F.count_if(F.col("sym") == s)
    return symbols.groupBy("variant", "iteration").agg(F.count(F.lit(1)).alias("length"), n("1").alias("ones"), n("0").alias("zeros"), n("(").alias("opens"), (n("(") == n(")")).alias("balanced"))


def latest(cat: DataFrame) -> DataFrame:
    """(variant, iteration): the last iteration of each variant."""
    return cat.groupBy("variant").agg(F.max("iteration").alias("iteration"))


def common_iterations(cat: DataFrame, variants: list[str]) -> DataFrame:
    """Iterations that all of ``variants`` have."""
    return cat.where(F.col("variant").isin(variants)).groupBy("iteration").agg(F.count_distinct("variant").alias("k")).where(F.col("k") == len(variants)).select("iteration")


def retained(cat: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` latest iterations of each variant."""
    return cat.withColumn("r", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("iteration")))).where(F.col("r") <= keep).drop("r")


def segments(bits: DataFrame, k: int, length: int) -> DataFrame:
    """(seq_id, segment, pos, bit): ``k`` evenly spaced segments; segment i starts at int(i / k * (N - length))."""
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    starts = size.select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("segment"), "size").select("seq_id", "segment", F.floor(F.col("segment") / F.lit(float(k)) * F.greatest(F.col("size") - length, F.lit(0))).cast("long").alias("start"))
    # each segment touches few blocks of its own length: an equi-join on them, not a range join
    touched = starts.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + length - 1) / length))))
    keyed = bits.withColumn("b", F.floor(F.col("pos") / length))
    return keyed.join(touched, ["seq_id", "b"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + length)).select("seq_id", "segment", "pos", "bit")


def every(bits: DataFrame, steps: list[int]) -> DataFrame:
    """(seq_id, step, idx, bit): each ``step``-th bit, at several scales."""
    each = bits.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).where(F.col("pos") % F.col("step") == 0)
    return each.select("seq_id", "step", F.floor(F.col("pos") / F.col("step")).cast("long").alias("idx"), "bit")


def centre(bits: DataFrame, n: int) -> DataFrame:
    """The ``n`` bits in the middle of each sequence."""
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    start = F.greatest(F.floor((F.col("size") - n) / 2), F.lit(0))
    return bits.join(size, "seq_id").where((F.col("pos") >= start) & (F.col("pos") < start + n)).select("seq_id", "pos", "bit")


def stratified(bits: DataFrame, most: int, length: int, seed: int = 42) -> DataFrame:
    """(seq_id, segment, pos, bit): one segment in each of max(1, floor(0.6 most / length)) equal regions, its place drawn from the seed."""
    k = max(1, int(0.6 * most / length))
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    region = F.greatest(F.floor(F.col("size") / k), F.lit(1))
    starts = size.withColumn("region", region).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    room = F.greatest(F.col("region") - length, F.lit(0)) + 1
    starts = starts.select("seq_id", "segment", (F.col("segment") * F.col("region") + F.pmod(F.xxhash64("seq_id", "segment", F.lit(seed)), room)).cast("long").alias("start"))
    touched = starts.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + length - 1) / length))))
    return bits.withColumn("b", F.floor(F.col("pos") / length)).join(touched, ["seq_id", "b"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + length)).select("seq_id", "segment", "pos", "bit")


def three_parts(bits: DataFrame, length: int) -> DataFrame:
    """(seq_id, part, pos, bit): ``length`` bits from the start, the middle and the end; shorter sequences give overlapping parts."""
    size = bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size"))
    at = F.array(*[F.struct(F.lit(name).alias("part"), F.greatest(F.lit(0), start).cast("long").alias("start")) for name, start in (("start", F.lit(0)), ("middle", F.floor((F.col("size") - length) / 2)), ("end", F.col("size") - length))])
    keyed = bits.join(size, "seq_id").withColumn("x", F.explode(at))
    return keyed.where((F.col("pos") >= F.col("x.start")) & (F.col("pos") < F.col("x.start") + length)).select("seq_id", "x.part", "pos", "bit")
