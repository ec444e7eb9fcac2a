"""Control sequences as tables (seq_id, pos, bit)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHI = (1 + 5**0.5) / 2


def fibonacci_word(positions: DataFrame, name: str = "fibonacci") -> DataFrame:
    """floor((n + 2) / phi) - floor((n + 1) / phi) at each position of a table; a column expression."""
    n = F.col("pos").cast("double")
    return positions.select(F.lit(name).alias("seq_id"), "pos", (F.floor((n + 2) / PHI) - F.floor((n + 1) / PHI)).cast("int").alias("bit"))


def random_bits(spark: SparkSession, n: int, p: float = 0.5, seed: int = 42) -> DataFrame:
    """Independent bits, one with chance ``p``."""
    return spark.range(n).select(F.lit("random").alias("seq_id"), F.col("id").alias("pos"), (F.rand(seed) < p).cast("int").alias("bit"))


def shuffled(bits: DataFrame, seed: int = 42, chunks: int = 1024) -> DataFrame:
    """The same bits of each sequence in a random order that the seed and the sequence's name fix.

    Order is by a hash; ranks are taken within chunks of hashes, then moved by the chunks before.
    """
    key = F.xxhash64("seq_id", "pos", F.lit(seed))
    rows = bits.select("seq_id", "pos", "bit", key.alias("key")).withColumn("chunk", F.floor(F.col("key") / F.lit(float(1 << 63)) * chunks).cast("int"))
    before = Window.partitionBy("seq_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # 2 * chunks rows a sequence
    sizes = rows.groupBy("seq_id", "chunk").agg(F.count(F.lit(1)).alias("n")).select("seq_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("seq_id", "chunk").orderBy("key", "pos")) - 1
    return rows.withColumn("nth", nth).join(sizes, ["seq_id", "chunk"]).select("seq_id", (F.col("before") + F.col("nth")).cast("long").alias("pos"), "bit")


def _sequential(spark: SparkSession, name: str, n: int, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            out, at = [], 0
            for bit in make(n):
                out.append(bit)
                if len(out) == 100_000:
                    yield pd.DataFrame({"seq_id": name, "pos": range(at, at + len(out)), "bit": out})
                    at, out = at + len(out), []
            if out:
                yield pd.DataFrame({"seq_id": name, "pos": range(at, at + len(out)), "bit": out})

    return spark.range(1, numPartitions=1).mapInPandas(run, "seq_id string, pos long, bit int")


def logistic_bits(spark: SparkSession, n: int, r: float = 3.99, x0: float = 0.5123) -> DataFrame:
    """x -> r x (1 - x), a bit for x of one half or more; sequential by nature, so one task."""

    def make(n: int) -> Iterator[int]:
        x = x0
        for _ in range(n):
            x = r * x * (1 - x)
            yield int(x >= 0.5)

    return _sequential(spark, "logistic", n, make)


def rule30_bits(spark: SparkSession, n: int) -> DataFrame:
    """The centre column of Rule 30 from a single one; the row is one big integer."""

    def make(n: int) -> Iterator[int]:
        row, centre = 1, 0
        for _ in range(n):
            yield row >> centre & 1
            row, centre = (row << 2) ^ ((row << 1) | row), centre + 1

    return _sequential(spark, "rule30", n, make)


def pi_bits(spark: SparkSession, digits: int) -> DataFrame:
    """Decimal digits of pi after the point, four bits each."""

    def make(n: int) -> Iterator[int]:
        k = n // 4 + 15
        one = 10**k

        def arctan(x: int) -> int:
            total = term = one // x
            i, sign = 3, -1
            while term:
                term //= x * x
                total += sign * (term // i)
                i, sign = i + 2, -sign
            return total

        pi = 4 * (4 * arctan(5) - arctan(239))
        for d in str(pi)[1 : 1 + n // 4]:
            yield from map(int, f"{int(d):04b}")

    return _sequential(spark, "pi", 4 * digits, make)


def control_size(iteration, base: int = 1000) -> Column:
    """Length of a control sequence at an iteration: base * 2^(iteration - 1)."""
    return F.floor(base * F.pow(F.lit(2.0), iteration - 1)).cast("long")
