"""Long sequences cut into chunks with a halo, and what can be read off chunks alone.

One sequence may be longer than any task should read. Chunks of a fixed number of positions, each
with the first ``halo`` symbols of what follows, make window-like operators (n-grams, lags) local
to a chunk: one shuffle, no global window. What runs over a whole sequence takes three levels: rows
within chunks, chunks within groups of ``FAN`` and groups, of which a sequence has one for each million positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlab.operators.staging import checkpointed

SIZE, HALO = 1024, 64
#: Rows of chunks in a group.
FAN = 1024


def chunks(symbols: DataFrame, value: str = "bit", size: int = SIZE, halo: int = HALO, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, chunk, start, n, text): ``text`` has the chunk's n symbols and up to ``halo`` following ones."""
    own = F.floor(F.col("pos") / size).cast("long")
    to = F.when((F.col("pos") % size < halo) & (F.col("pos") >= size), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = symbols.select(*keys, "pos", F.col(value).cast("string").alias("v"), F.explode(to).alias("chunk"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "v")))
    text = F.array_join(F.transform(F.col("rows"), lambda r: r["v"]), "")
    n = F.size(F.filter("rows", lambda r: r["pos"] < (F.col("chunk") + 1) * size))
    packed = dealt.groupBy(*keys, "chunk").agg(rows.alias("rows"))
    return packed.select(*keys, "chunk", (F.col("chunk") * size).alias("start"), n.alias("n"), text.alias("text"))


def ngrams(chunked: DataFrame, lengths: range | list[int], step: int = 1, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, len, pos, pattern) of every window of the given lengths, at positions divisible by ``step``."""
    at = F.sequence(F.lit(0), F.col("n") - 1)
    if step > 1:
        at = F.filter(at, lambda i: (F.col("start") + i) % step == 0)

    def windows(length: int) -> Column:
        fits = F.filter(at, lambda i: i + length <= F.length("text"))
        return F.transform(fits, lambda i: F.struct(F.lit(length).alias("len"), i.alias("at"), F.substring(F.col("text"), i + 1, F.lit(length)).alias("pattern")))

    # windows are cut before rows are made, so that no row carries its chunk
    each = chunked.where("n > 0").select(*keys, "start", F.explode(F.concat(*[windows(n) for n in lengths])).alias("w"))
    return each.select(*keys, "w.len", (F.col("start") + F.col("w.at")).alias("pos"), "w.pattern")


def bit_ngrams(bits: DataFrame, lengths: range | list[int], step: int = 1, keys: tuple[str, ...] = ("seq_id",), value: str = "bit") -> DataFrame:
    """``ngrams`` of a bit table."""
    return ngrams(chunks(bits, value, keys=keys), lengths, step, keys)


def carried(totals: DataFrame, index: str, sums: dict[str, str] | None = None, lows: dict[str, str] | None = None, highs: dict[str, str] | None = None, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``totals`` with what all rows before, in order of ``index``, come to: sums (0 before the first), minima and maxima (null before it).

    Each of ``sums``, ``lows`` and ``highs`` maps a column to the name of its result. Rows are taken
    in groups of ``FAN`` indexes, then the groups: no window has more than a group or a row for each group.
    ``totals``, a row for each chunk, is written once, so that what it comes from is not computed again.
    """
    kinds = [(c, name, agg) for given, agg in ((sums, F.sum), (lows, F.min), (highs, F.max)) for c, name in (given or {}).items()]
    rows = checkpointed(totals).withColumn("_g", F.floor(F.col(index) / FAN))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside, over = earlier([*keys, "_g"], index), earlier(keys, "_g")
    groups = rows.groupBy(*keys, "_g").agg(*[agg(c).alias(f"_t_{name}") for c, name, agg in kinds])
    groups = groups.select(*keys, "_g", *[agg(f"_t_{name}").over(over).alias(f"_b_{name}") for _, name, agg in kinds])
    both = rows.select("*", *[agg(c).over(inside).alias(f"_i_{name}") for c, name, agg in kinds]).join(groups, [*keys, "_g"])

    def joined(name: str, agg) -> Column:
        a, b = F.col(f"_i_{name}"), F.col(f"_b_{name}")
        if agg is F.sum:
            zero = F.lit(0)
            return F.coalesce(a, zero) + F.coalesce(b, zero)
        return F.least(a, b) if agg is F.min else F.greatest(a, b)

    return both.select(*totals.columns, *[joined(name, agg).alias(name) for _, name, agg in kinds])


def running_sum(rows: DataFrame, value: Column, name: str, size: int = SIZE, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and including each position: groups of chunks, chunks, then within chunks."""
    cut = rows.withColumn("_c", F.floor(F.col("pos") / size).cast("long")).withColumn("_v", value)
    totals = carried(cut.groupBy(*keys, "_c").agg(F.sum("_v").alias("_t")), "_c", {"_t": "_before"}, keys=keys).drop("_t")
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_in", inside).join(totals, [*keys, "_c"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_c", "_v", "_before", "_in")


def ranked(rows: DataFrame, name: str, size: int = SIZE, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``rows`` with their number, from 1, in order of pos within ``keys``."""
    cut = rows.withColumn("_c", F.floor(F.col("pos") / size).cast("long"))
    totals = carried(cut.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_t")), "_c", {"_t": "_before"}, keys=keys).drop("_t")
    inside = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy("pos"))
    return cut.withColumn("_in", inside).join(totals, [*keys, "_c"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_c", "_before", "_in")


def previous(rows: DataFrame, value: str, name: str, size: int = SIZE, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``rows`` with ``value`` of the row before, in order of pos within ``keys``; null for the first."""
    cut = rows.withColumn("_c", F.floor(F.col("pos") / size).cast("long"))
    last = cut.groupBy(*keys, "_c").agg(F.max(F.struct("pos", value)).alias("_l"))
    before = carried(last, "_c", highs={"_l": "_before"}, keys=keys).drop("_l")
    w = Window.partitionBy(*keys, "_c").orderBy("pos")
    near = cut.withColumn("_first", F.row_number().over(w) == 1).withColumn("_near", F.lag(value).over(w))
    return near.join(before, [*keys, "_c"]).withColumn(name, F.when(F.col("_first"), F.col(f"_before.{value}")).otherwise(F.col("_near"))).drop("_c", "_before", "_first", "_near")


def blocks(bits: DataFrame, sizes: list[int], keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, size, block, n, ones): whole blocks of each size; a shorter last block is left out."""
    each = bits.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    out = each.groupBy(*keys, "size", F.floor(F.col("pos") / F.col("size")).cast("long").alias("block"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones")).where("n = size")


def entropy_of(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(*keys, entropy, states, total): Shannon entropy in bits of the counts in each group."""
    total = F.sum(n).over(Window.partitionBy(*keys)) if keys else F.sum(n).over(Window.partitionBy(F.lit(0)))
    p = F.col(n).cast("double") / F.col("_t")
    out = counts.withColumn("_t", total).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"), F.count(F.lit(1)).alias("states"), F.sum(n).alias("total"))
    return out


def ratio(a: Column, b: Column) -> Column:
    """a over b as doubles; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; 0 where either is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread).otherwise(0.0)
