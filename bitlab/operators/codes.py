"""Windows of bits as integers, cut from packed words.

32 positions are packed into one long with the 32 that follow them, so that every window of up to 32 bits is a shift and
a mask of one word, whatever its place. Counting reads each position once, for the longest length: the counts of shorter
ones are sums over their beginnings, and at a sequence's end, where the longest no longer fits, windows are
as long as what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def packed(bits: DataFrame, keys: tuple[str, ...] = ("seq_id",), value: str = "bit") -> DataFrame:
    """(*keys, word, bits, own, there): words of ``WORD`` positions and those of the next word; ``own`` of the former, ``there`` in all.

    Positions count from 0 without gaps. Bits are or-ed together where they are read, so a word is one row before the shuffle.
    """
    word, at = F.floor(F.col("pos") / WORD), (F.col("pos") % WORD).cast("int")
    places = F.array(F.struct(word.alias("word"), (63 - at).alias("shift")), F.struct((word - 1).alias("word"), (31 - at).alias("shift")))
    each = bits.select(*keys, F.col(value).cast("long").alias("_b"), F.explode(places).alias("p")).where("p.word >= 0")
    shifted = F.call_function("shiftleft", F.col("_b"), F.col("p.shift"))
    return each.groupBy(*keys, F.col("p.word").alias("word")).agg(F.bit_or(shifted).alias("bits"), F.count_if(F.col("p.shift") >= WORD).alias("own"), F.count(F.lit(1)).alias("there"))


def _cut(at: Column, length: Column) -> Column:
    """The window of ``length`` bits at place ``at`` of a word, as a long."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("bits"), at.cast("int")), (64 - length).cast("int"))


def text_of(code: Column, length: Column) -> Column:
    """A code as a string of ``length`` zeros and ones."""
    return F.lpad(F.bin(code), length, "0")


def gram_codes(bits: DataFrame, length: int, keys: tuple[str, ...] = ("seq_id",), value: str = "bit") -> DataFrame:
    """(*keys, pos, code) of every window of ``length`` bits, of at most ``WORD``."""
    _check([length])
    fits = F.least(F.col("own"), F.col("there") - (length - 1))
    at = packed(bits, keys, value).where(fits > 0).select(*keys, "word", "bits", F.explode(F.sequence(F.lit(0), (fits - 1).cast("int"))).alias("at"))
    return at.select(*keys, (F.col("word") * WORD + F.col("at")).alias("pos"), _cut(F.col("at"), F.lit(length)).alias("code"))


def gram_counts(bits: DataFrame, lengths: range | list[int], keys: tuple[str, ...] = ("seq_id",), segments: int | None = None) -> DataFrame:
    """(*keys, len, code, n, first_pos), with ``segments`` also by segment, of all windows of the given lengths, of at most ``WORD``.

    Segments are equal parts of a sequence by the window's position, what is left belonging to the last one.
    """
    _check(lengths)
    longest, by, words = max(lengths), list(keys), packed(bits, keys).where("own > 0")
    if segments:
        size = bits.groupBy(*keys).agg((F.max("pos") + 1).alias("size"))
        words = words.join(size, list(keys))
        part = F.least(F.floor(F.col("pos") / F.greatest(F.floor(F.col("size") / segments), F.lit(1))), F.lit(segments - 1)).cast("int")
        by.append("segment")
    at = words.select("*", F.explode(F.sequence(F.lit(0), (F.col("own") - 1).cast("int"))).alias("at"))
    whole = F.least(F.lit(longest), F.col("there") - F.col("at")).cast("int")
    at = at.withColumn("pos", F.col("word") * WORD + F.col("at")).withColumn("full", whole)
    rows = at.select(*keys, *([part.alias("segment")] if segments else []), "pos", "full", _cut(F.col("at"), F.col("full")).alias("code"))
    long = rows.groupBy(*by, "full", "code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    shorter = long.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len")).where("len <= full")
    code = F.call_function("shiftrightunsigned", F.col("code"), F.col("full") - F.col("len"))
    return shorter.groupBy(*by, "len", code.alias("code")).agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def tile_counts(bits: DataFrame, lengths: range | list[int], keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(*keys, len, code, n) of the tiles of each length, of at most ``WORD``: windows at multiples of it. One reading serves all lengths."""
    _check(lengths)
    each = packed(bits, keys).select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len"))
    start = F.col("word") * WORD
    first = F.pmod(-start, F.col("len")).cast("int")  # the first multiple in the word
    last = F.least(F.col("own") - 1, F.col("there") - F.col("len")).cast("int")
    at = each.withColumn("first", first).withColumn("last", last).where("first <= last").select(*keys, "bits", "len", F.explode(F.expr("sequence(first, last, len)")).alias("at"))
    return at.groupBy(*keys, "len", _cut(F.col("at"), F.col("len")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _check(lengths: range | list[int]) -> None:
    if not all(0 < n <= WORD for n in lengths):
        raise ValueError(f"lengths must lie within 1 and {WORD}")
