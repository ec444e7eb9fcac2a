"""Nesting structure of symbol sequences over ``0 1 ( )``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.chunks import SIZE, carried, correlation, entropy_of, previous, ranked, ratio


def depths(symbols: DataFrame, size: int = SIZE) -> DataFrame:
    """(seq_id, pos, sym, depth, ones, zeros, closes): unmatched closes dropped, running depth, counts of bits and of closes kept.

    depth is that after an open and before a close, so both ends of a group have its depth. A chunk of
    positions is summed up by its net depth and its lowest one; from these of all chunks before, each
    chunk knows the depth in which it begins, and the lowest so far.
    """
    w = Window.partitionBy("seq_id", "_c").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("sym") == "(", 1).when(F.col("sym") == ")", -1).otherwise(0)
    count = lambda x: F.sum(F.when(F.col("sym") == x, 1).otherwise(0)).over(run)
    cut = symbols.select("seq_id", "pos", "sym", F.floor(F.col("pos") / size).cast("long").alias("_c"))
    inside = cut.select("*", F.sum(delta).over(run).alias("s"), count("1").alias("ones"), count("0").alias("zeros"), count(")").alias("closes"))
    inside = inside.withColumn("dip", F.min("s").over(run))
    is_ = lambda x: F.sum(F.when(F.col("sym") == x, 1).otherwise(0))
    totals = inside.groupBy("seq_id", "_c").agg(F.sum(delta).alias("net"), F.min("s").alias("lowest"), is_("1").alias("n1"), is_("0").alias("n0"), is_(")").alias("nc"))
    totals = carried(totals, "_c", {"net": "s0", "n1": "ones0", "n0": "zeros0", "nc": "closes0"}).withColumn("lowest", F.col("s0") + F.col("lowest"))
    totals = carried(totals, "_c", lows={"lowest": "low0"}).select("seq_id", "_c", "s0", "ones0", "zeros0", "closes0", F.least(F.lit(0), "low0").alias("low0"))
    low = inside.join(totals, ["seq_id", "_c"]).withColumn("low", F.least("low0", F.col("s0") + F.col("dip")))
    kept = low.withColumn("was", F.coalesce(F.lag("low").over(w), F.col("low0"))).where("low = was")
    depth = F.col("s0") + F.col("s") - F.col("low") + F.when(F.col("sym") == ")", 1).otherwise(0)
    so_far = lambda c: (F.col(f"{c}0") + F.col(c)).alias(c)
    return kept.select("seq_id", "pos", "sym", depth.cast("int").alias("depth"), so_far("ones"), so_far("zeros"), (F.col("closes0") + F.col("closes") + F.col("low")).alias("closes"))


def nodes(deep: DataFrame, size: int = SIZE) -> DataFrame:
    """(seq_id, open_pos, close_pos, depth, n_ones, n_zeros, size, parent_pos): the closed groups.

    The k-th open at a depth closes with the k-th close at that depth. The parent is the last
    open one level up, whether it closes or not, as on a stack; bits are those of all levels within, size counts
    the groups within, itself included. Ranks and last opens are told within chunks and carried over chunks.
    """
    opens = deep.where("sym = '('")
    roles = opens.select("seq_id", "pos", "depth", "ones", "zeros", "closes", F.floor(F.col("pos") / size).cast("long").alias("_c"), F.explode(F.array(F.col("depth"), F.col("depth") - 1)).alias("level"))
    roles = roles.withColumn("as_parent", F.when(F.col("level") == F.col("depth"), F.col("pos")))
    before = carried(roles.groupBy("seq_id", "level", "_c").agg(F.max("as_parent").alias("_l")), "_c", highs={"_l": "earlier"}, keys=("seq_id", "level")).drop("_l")
    last = F.max("as_parent").over(Window.partitionBy("seq_id", "level", "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    opens = roles.withColumn("near", last).where("level = depth - 1").join(before, ["seq_id", "level", "_c"]).withColumn("parent_pos", F.when(F.col("depth") > 1, F.coalesce("near", "earlier")))
    opens = ranked(opens.drop("_c"), "k", size, ("seq_id", "depth")).select("seq_id", "depth", "k", F.col("pos").alias("open_pos"), F.col("ones").alias("o1"), F.col("zeros").alias("o0"), F.col("closes").alias("oc"), "parent_pos")
    closes = ranked(deep.where("sym = ')'"), "k", size, ("seq_id", "depth")).select("seq_id", "depth", "k", F.col("pos").alias("close_pos"), F.col("ones").alias("c1"), F.col("zeros").alias("c0"), F.col("closes").alias("cc"))
    both = opens.join(closes, ["seq_id", "depth", "k"])
    return both.select("seq_id", "open_pos", "close_pos", "depth", (F.col("c1") - F.col("o1")).alias("n_ones"), (F.col("c0") - F.col("o0")).alias("n_zeros"), (F.col("cc") - F.col("oc")).alias("size"), "parent_pos")


def depth_stats(deep: DataFrame) -> DataFrame:
    """(seq_id, opens, closes, max_depth, bits) of each sequence."""
    return deep.groupBy("seq_id").agg(F.count_if(F.col("sym") == "(").alias("opens"), F.count_if(F.col("sym") == ")").alias("closes"), F.max("depth").alias("max_depth"), F.count_if(F.col("sym").isin("0", "1")).alias("bits"))


def depth_histogram(deep: DataFrame) -> DataFrame:
    """(depth, opens) over all sequences."""
    return deep.where("sym = '('").groupBy("depth").agg(F.count(F.lit(1)).alias("opens"))


def depth_transitions(deep: DataFrame, n: int = 1000) -> DataFrame:
    """(prev_depth, depth, n): the commonest steps between parentheses' depths."""
    steps = previous(deep.where("sym in ('(', ')')"), "depth", "prev_depth").where("prev_depth IS NOT NULL")
    return steps.groupBy("prev_depth", "depth").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prev_depth", "depth").limit(n)


def containment(groups: DataFrame) -> DataFrame:
    """(length, groups, mean_entropy): groups by the number of bits they hold, with the mean entropy of those."""
    n = F.col("n_ones") + F.col("n_zeros")
    p = F.col("n_ones").cast("double") / n
    h = F.when((F.col("n_ones") > 0) & (F.col("n_zeros") > 0), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    return groups.groupBy(n.alias("length")).agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(h), 6).alias("mean_entropy"))


#: Two primes below 2^31 and bases, for hashes of contents.
MODULI = ((2147483647, 48271), (2147483629, 16807))


def _power(base: int, prime: int, exponent: Column) -> Column:
    """``base`` to the ``exponent`` (below 2^40) modulo ``prime``, from the powers of its binary digits."""
    out = F.lit(1).cast("long")
    for bit in range(40):
        digit = F.call_function("shiftright", exponent, F.lit(bit)).bitwiseAND(F.lit(1).cast("long"))
        out = (out * (1 + digit * (pow(base, 1 << bit, prime) - 1))) % prime
    return out


def contents(deep: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` with h1 and h2: hashes of the bits within, in order. Equal contents have equal hashes; others differ but for one in 2^60.

    A group's hash is the difference of sums of bits times powers of a base by their place, shifted to a common place.
    """
    w = Window.partitionBy("seq_id", "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("ones") + F.col("zeros")
    value = F.when(F.col("sym") == "1", 2).when(F.col("sym") == "0", 1).otherwise(0)
    cut = deep.select("seq_id", "pos", "sym", "ones", "zeros", F.floor(F.col("pos") / SIZE).cast("long").alias("_c"), *[(value * _power(b, p, place)).alias(f"v{i}") for i, (p, b) in enumerate(MODULI)])
    totals = cut.groupBy("seq_id", "_c").agg(*[(F.sum(f"v{i}") % p).alias(f"t{i}") for i, (p, _) in enumerate(MODULI)])
    totals = carried(totals, "_c", {f"t{i}": f"b{i}" for i in range(2)}).select("seq_id", "_c", "b0", "b1")
    sums = cut.select("*", *[F.sum(f"v{i}").over(w).alias(f"i{i}") for i in range(2)]).join(totals, ["seq_id", "_c"])
    sums = sums.select("seq_id", "pos", "sym", "ones", "zeros", *[((F.col(f"i{i}") + F.col(f"b{i}")) % p).alias(f"s{i}") for i, (p, _) in enumerate(MODULI)])
    end = lambda x, c: sums.where(F.col("sym") == x).select("seq_id", F.col("pos").alias(c), *[F.col(f"s{i}").alias(f"{c}{i}") for i in range(2)], place.alias(f"{c}_at"))
    both = groups.join(end("(", "open_pos"), ["seq_id", "open_pos"]).join(end(")", "close_pos"), ["seq_id", "close_pos"])
    far = (1 << 40) - 1
    hashes = [((F.col(f"close_pos{i}") - F.col(f"open_pos{i}") + p) % p * _power(b, p, far - F.col("open_pos_at")) % p).alias(f"h{i + 1}") for i, (p, b) in enumerate(MODULI)]
    return both.select(*[groups[c] for c in groups.columns if c not in ("seq_id", "open_pos", "close_pos")], "seq_id", "open_pos", "close_pos", *hashes)


def containment_summary(deep: DataFrame, groups: DataFrame) -> DataFrame:
    """(groups, mean_length, std_length, distinct_contents, repetition) of groups by the bits that they hold, in order."""
    n = F.col("n_ones") + F.col("n_zeros")
    out = contents(deep, groups).agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.stddev_samp(n), 6).alias("std_length"), F.count_distinct(n, "h1", "h2").alias("distinct_contents"))
    return out.withColumn("repetition", F.round(1 - ratio(F.col("distinct_contents"), F.col("groups")), 6))


def stratified(deep: DataFrame) -> DataFrame:
    """(depth, zeros, ones, runs, entropy, density): the direct bits at each depth above 0, and their islands."""
    follows = F.coalesce("before", F.lit("(")).isin("0", "1")
    inside = previous(deep, "sym", "before").withColumn("starts", F.when(follows, 0).otherwise(1)).where("sym in ('0', '1') AND depth > 0")
    out = inside.groupBy("depth").agg(F.count_if(F.col("sym") == "0").alias("zeros"), F.count_if(F.col("sym") == "1").alias("ones"), F.sum("starts").alias("runs"))
    p = F.col("ones").cast("double") / (F.col("ones") + F.col("zeros"))
    h = F.when((F.col("ones") > 0) & (F.col("zeros") > 0), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    return out.select("depth", "zeros", "ones", "runs", F.round(h, 6).alias("entropy"), F.round(p, 6).alias("density"))


def depth_order(deep: DataFrame) -> DataFrame:
    """(depths, entropy, gini) of the distribution of opens over depths."""
    hist = depth_histogram(deep)
    h = entropy_of(hist, [], "opens").select(F.col("states").alias("depths"), F.round("entropy", 6).alias("entropy"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("opens", "depth"))  # a row per depth
    g = hist.withColumn("i", rank).agg(F.sum(F.col("i") * F.col("opens")).alias("a"), F.sum("opens").alias("s"), F.count(F.lit(1)).alias("n"))
    gini = 2 * ratio(F.col("a"), F.col("n") * F.col("s")) - ratio(F.col("n") + 1, F.col("n"))
    return h.crossJoin(F.broadcast(g.select(F.round(gini, 6).alias("gini"))))  # one row each


#: Weights of the order index.
ORDER_WEIGHTS = {"organisation": 0.3, "gradient": 0.3, "regularity": 0.2, "balance": 0.2}


def order_parts(symbols: DataFrame, deep: DataFrame, groups: DataFrame) -> DataFrame:
    """(organisation, gradient, regularity, balance), one row, each within 0 and 1.

    organisation: 1 less the depth entropy over the logarithm of the largest depth; gradient: 1 / (1 + |slope|) of
    strata's entropies over depth; regularity: 1 / (1 + variance of the numbers of bits that groups hold); balance: 1 if
    every parenthesis has its partner, else 0.
    """
    hist = depth_histogram(deep)
    top = hist.agg(F.max("depth").cast("double").alias("top"))
    h = entropy_of(hist, [], "opens").select("entropy")
    share = F.col("entropy") / F.when(F.col("top") > 1, F.log2("top")).otherwise(1.0)
    organised = h.crossJoin(F.broadcast(top)).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share)).alias("organisation"))
    slope = stratified(deep).agg((1 / (1 + F.abs(F.coalesce(F.regr_slope("entropy", F.col("depth").cast("double")), F.lit(0.0))))).alias("gradient"))
    regular = groups.agg((1 / (1 + F.coalesce(F.var_pop(F.col("n_ones") + F.col("n_zeros")), F.lit(0.0)))).alias("regularity"))
    there = symbols.where("sym in ('(', ')')").agg(F.count(F.lit(1)).alias("there"))
    paired = groups.agg(F.count(F.lit(1)).alias("groups"))
    balance = there.crossJoin(F.broadcast(paired)).select(F.when(F.col("there") == 2 * F.col("groups"), 1.0).otherwise(0.0).alias("balance"))
    out = organised
    for part in (slope, regular, balance):  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def order_index(parts: DataFrame) -> DataFrame:
    """The parts and their weighted sum, index."""
    index = sum((F.col(k) * w for k, w in ORDER_WEIGHTS.items()), F.lit(0.0))
    return parts.select(*[F.round(k, 6).alias(k) for k in ORDER_WEIGHTS], F.round(index, 6).alias("index"))


def depth_correlation(deep: DataFrame) -> DataFrame:
    """(depth, n, r): Pearson correlation of the bits at a depth with those one deeper, zipped in order within each sequence; 0 if constant."""
    bits = ranked(deep.where("sym in ('0', '1')"), "k", keys=("seq_id", "depth")).select("seq_id", "depth", F.col("sym").cast("int").alias("b"), "k")
    deeper = bits.select("seq_id", (F.col("depth") - 1).alias("depth"), F.col("b").alias("b2"), "k")
    out = bits.join(deeper, ["seq_id", "depth", "k"]).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("b").cast("double"), F.col("b2").cast("double")).alias("r"))
    return out.select("depth", "n", F.round("r", 6).alias("r"))


def tree(groups: DataFrame) -> DataFrame:
    """(depth, nodes, branching, mean_children, mean_content) by depth: nodes, those with children, their children, and bits held."""
    kids = groups.where("parent_pos IS NOT NULL").groupBy("seq_id", F.col("parent_pos").alias("open_pos")).agg(F.count(F.lit(1)).alias("kids"))
    out = groups.join(kids, ["seq_id", "open_pos"], "left").groupBy("depth").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("kids").alias("branching"), F.round(F.coalesce(F.avg("kids"), F.lit(0.0)), 6).alias("mean_children"), F.round(F.avg(F.col("n_ones") + F.col("n_zeros")), 6).alias("mean_content")
    )
    return out


def subtree_sizes(groups: DataFrame) -> DataFrame:
    """(size, nodes): how many groups a group holds, itself included."""
    return groups.groupBy("size").agg(F.count(F.lit(1)).alias("nodes"))


def by_max_depth(stats: DataFrame) -> DataFrame:
    """(max_depth, sequences, groups, bits): how many sequences nest how deep, with the groups that close and the bits in them."""
    return stats.groupBy("max_depth").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.least("opens", "closes")).alias("groups"), F.sum("bits").alias("bits"))
