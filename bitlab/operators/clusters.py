"""Blocks of bits as points under the Hamming distance: neighbours by segments, density clusters, distant pairs.

Of two blocks that differ in at most k bits, cut into k + 1 segments, at least one segment is equal. So neighbours are
found by equi-joins on (segment, value) of the distinct blocks, and compared once, at the first segment that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlab.operators.codes import gram_codes
from bitlab.operators.staging import checkpointed


def stepped_blocks(bits: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """(code, n, first_pos) of the distinct blocks of ``size`` bits (at most 32) at multiples of ``step``, half the size if not given."""
    step = step or max(1, size // 2)
    at = gram_codes(bits, size).where(F.col("pos") % step == 0)
    return at.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def _segments(size: int, reach: int) -> list[tuple[int, int]]:
    """(shift, mask) of reach + 1 segments of ``size`` bits, as even as they can be."""
    cuts = [size * i // (reach + 1) for i in range(reach + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def neighbours(codes: DataFrame, size: int, reach: int) -> DataFrame:
    """(a, b, bits) of the pairs a < b of distinct codes (code) that differ in at most ``reach`` of ``size`` bits, once each.

    With ``reach`` of ``size`` or more every pair is a neighbour, and there are no segments: that is an error.
    """
    if not 0 <= reach < size:
        raise ValueError("reach must lie within 0 and the size less one")
    parts = _segments(size, reach)
    value = lambda code, i: F.call_function("shiftright", code, F.lit(parts[i][0])).bitwiseAND(F.lit(parts[i][1]))
    dealt = codes.select("code", F.posexplode(F.array(*[value(F.col("code"), i) for i in range(len(parts))])).alias("segment", "value"))
    met = dealt.select(F.col("code").alias("a"), "segment", "value").join(dealt.select(F.col("code").alias("b"), "segment", "value"), ["segment", "value"]).where("a < b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    # equal segments are zero in the difference; the pair counts at the first of them
    first = F.coalesce(*[F.when(value(apart, i) == 0, F.lit(i)) for i in range(len(parts))])
    return met.withColumn("bits", F.bit_count(apart)).where((F.col("bits") <= reach) & (F.col("segment") == first)).select("a", "b", "bits")


def labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label): the smallest rank of the connected nodes, from nodes (node, rank) and undirected edges (a, b) between them.

    Every round takes the smallest label of the neighbours and then the label of the label's own node. Each is a written table.
    """
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = checkpointed(nodes.select("node", F.col("rank").alias("label"), "rank"))
    for _ in range(max_rounds):
        least = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        told = now.join(least, "node", "left").select("node", "rank", F.least("label", F.coalesce("l", "label")).alias("to"), F.col("label").alias("was"))
        up = told.select(F.col("rank").alias("to"), F.col("to").alias("further"))
        new = checkpointed(told.join(up, "to", "left").select("node", "rank", F.least("to", F.coalesce("further", "to")).alias("label"), "was"))
        now = new.drop("was")
        if new.where("label < was").isEmpty():
            return now.select("node", "label")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def density_clusters(blocks: DataFrame, size: int, similarity: float, min_count: int) -> DataFrame:
    """(code, n, first_pos, core, cluster) of blocks (code, n, first_pos) clustered by density; cluster is null for noise.

    Neighbours are blocks that share at least ``similarity`` of their bits. A block is a core if it and its
    neighbours occur ``min_count`` times or more. Connected cores are one cluster, named by the first position of any of them; another
    block goes to the first cluster by name of which it neighbours a core.
    """
    reach = int((1 - similarity) * size + 1e-9)
    blocks = checkpointed(blocks)
    near = checkpointed(neighbours(blocks.select("code"), size, reach))
    both = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(blocks.select(F.col("code").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("code")).agg(F.sum("m").alias("m"))
    dense = F.col("n") + F.coalesce("m", F.lit(0)) >= min_count
    told = checkpointed(blocks.join(around, "code", "left").select("code", "n", "first_pos", dense.alias("core")))
    cores = told.where("core").select(F.col("code").alias("node"), F.col("first_pos").alias("rank"))
    inside = near.join(cores.select(F.col("node").alias("a")), "a", "left_semi").join(cores.select(F.col("node").alias("b")), "b", "left_semi")
    named = checkpointed(labels(cores, inside).withColumnRenamed("label", "cluster"))
    border = both.join(named.select(F.col("node").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("code")).agg(F.min("cluster").alias("border"))
    out = told.join(named.withColumnRenamed("node", "code"), "code", "left").join(border, "code", "left")
    return out.select("code", "n", "first_pos", "core", F.when(F.col("core"), F.col("cluster")).otherwise(F.col("border")).alias("cluster"))


def distant_pairs(length: int, block: int, most: int, distances: int = 20, samples: int = 10, seed: int = 42) -> list[tuple[int, int]]:
    """(distance, nth) of the pairs of blocks to draw from a sequence: even distances up to ``most``, and so many pairs at each."""
    most = most if length >= 2 * block + most else (length - 2 * block) // 2
    if most < block:
        return []
    n = min(distances, most // block)
    steps = [int(block + (most - block) * i / max(1, n - 1)) for i in range(n)]
    return [(d, k) for d in steps for k in range(max(1, min(samples, (length - block - d) // (2 * block))))]


def drawn(seed: int, distance: Column, nth: Column, below: Column) -> Column:
    """A whole number from 0 to below - 1 that depends on its arguments alone: from the MD5 of seed, distance and number."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), distance.cast("string"), nth.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def distant_information(bits: DataFrame, block: int = 100, most: int = 10_000, seed: int = 42) -> DataFrame:
    """(distance, nth, start, mi): mutual information of the bits of two blocks at a distance, for all drawn pairs.

    Draws depend on seed, distance and number alone, not on partitions. Positions of both blocks meet by an equi-join.
    """
    length = bits.agg(F.max("pos") + 1).first()[0] or 0
    pairs = distant_pairs(length, block, most)
    if not pairs:
        return bits.sparkSession.createDataFrame([], "distance long, nth int, start long, mi double")
    table = bits.sparkSession.createDataFrame(pairs, "distance long, nth int")  # at most 200 rows
    starts = table.withColumn("start", drawn(seed, F.col("distance"), F.col("nth"), F.lit(length - block) - F.col("distance")))
    places = starts.select("*", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i"))
    one = bits.select(F.col("pos").alias("p1"), F.col("bit").alias("x"))
    two = bits.select(F.col("pos").alias("p2"), F.col("bit").alias("y"))
    both = places.withColumn("p1", F.col("start") + F.col("i")).withColumn("p2", F.col("start") + F.col("distance") + F.col("i")).join(one, "p1").join(two, "p2")
    cells = both.groupBy("distance", "nth", "start").agg(*[F.count_if((F.col("x") == a) & (F.col("y") == b)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n = F.lit(float(block))

    def term(a: int, b: int) -> Column:
        c, row, column = F.col(f"n{a}{b}"), F.col(f"n{a}0") + F.col(f"n{a}1"), F.col(f"n0{b}") + F.col(f"n1{b}")
        return F.when(c > 0, c / n * F.log2(c * n / (row * column))).otherwise(0.0)

    return cells.select("distance", "nth", "start", F.greatest(F.lit(0.0), term(0, 0) + term(0, 1) + term(1, 0) + term(1, 1)).alias("mi"))


def mean_and_error(values: DataFrame, value: str) -> DataFrame:
    """(n, mean, error): the mean and its standard error, of the population's deviation."""
    return values.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(F.lit(1)))).alias("error"))
