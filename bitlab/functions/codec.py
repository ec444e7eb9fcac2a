"""The 2-bit code of symbols (0, 1, open, close as 00, 01, 10, 11), four to a byte, and scalar measures of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = "01()"


def encode(text: Column) -> Column:
    """Symbols as the hexadecimal digits of their packed bytes, filled up with zero bits to a whole byte."""
    digits = F.translate(text, CODE, "0123")
    padded = F.rpad(digits, F.ceil(F.length(digits) / 4).cast("int") * 4, "0")
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded), F.lit(2)), lambda i: F.lower(F.hex(F.substring(padded, i, F.lit(1)).cast("long") * 4 + F.substring(padded, i + 1, F.lit(1)).cast("long"))))
    return F.when(F.length(digits) == 0, "").otherwise(F.array_join(pairs, ""))


def decode(packed: Column, n: Column) -> Column:
    """The first ``n`` symbols of ``encode``; the length is kept apart, for padding decodes as zeros."""
    nibble = lambda i: F.conv(F.substring(packed, i, F.lit(1)), 16, 10).cast("int")
    symbols = F.transform(F.sequence(F.lit(1), F.length(packed)), lambda i: F.concat(F.substring(F.lit(CODE), F.floor(nibble(i) / 4).cast("int") + 1, F.lit(1)), F.substring(F.lit(CODE), nibble(i) % 4 + 1, F.lit(1))))
    return F.when(n == 0, "").otherwise(F.substring(F.array_join(symbols, ""), F.lit(1), n))


def storage(text: Column) -> Column:
    """struct(symbols, text_bytes, packed_bytes, clean_bits, savings) of a string as text and packed."""
    n = F.length(text)
    packed = F.ceil(n / 4)
    return F.struct(n.cast("long").alias("symbols"), n.cast("long").alias("text_bytes"), packed.cast("long").alias("packed_bytes"), F.length(F.translate(text, "()", "")).cast("long").alias("clean_bits"), F.round(1 - packed.cast("double") / F.greatest(n, F.lit(1)), 6).alias("savings"))


def phi_distance(ratio: Column) -> Column:
    """Distance to the nearer of phi and 1 / phi."""
    phi = (1 + 5**0.5) / 2
    return F.least(F.abs(ratio - phi), F.abs(ratio - 1 / phi))
