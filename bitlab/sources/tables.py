"""Bit and symbol sequences out of ordinary tables.

A sequence table has (seq_id, pos, bit) or (seq_id, pos, sym); pos counts from 0 without gaps and
is the only order there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.operators.chunks import ranked

#: Event types that count as one; the symbols of structured sequences.
ONES = ("click", "purchase")
SYMBOLS = {"signup": "(", "error": ")", "click": "1", "purchase": "1", "view": "0"}


def is_one(event_type: Column) -> Column:
    return F.when(event_type.isin(*ONES), 1).otherwise(0)


def event_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long sequence; event_id is the dense position."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lit("ev").alias("seq_id"), F.col("event_id").alias("pos"), is_one(F.col("event_type")).alias("bit"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, event_type, event_id): a sequence for each user, in event order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("seq_id"), F.col("event_id").alias("pos"), "event_type")
    numbered = ranked(events, "nth", 1 << 16)  # a user may have a third of all events
    return numbered.select("seq_id", (F.col("nth") - 1).cast("long").alias("pos"), "event_type", F.col("pos").alias("event_id"))


def user_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bit sequence for each user."""
    return user_events(spark, sf_dir).select("seq_id", "pos", is_one(F.col("event_type")).alias("bit"))


def cohort_bits(spark: SparkSession, sf_dir: str, cohorts: int = 4) -> DataFrame:
    """User sequences with their iteration: users by id modulo ``cohorts`` stand for successive snapshots."""
    return user_bits(spark, sf_dir).withColumn("iteration", (F.col("seq_id").cast("long") % cohorts).cast("int"))


def _symbol(event_type: Column) -> Column:
    pairs = [x for kv in SYMBOLS.items() for x in map(F.lit, kv)]
    return F.coalesce(F.create_map(*pairs)[event_type], F.lit("0"))


def user_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, sym) over ``0 1 ( )`` for each user, as they come; not balanced."""
    return user_events(spark, sf_dir).select("seq_id", "pos", _symbol(F.col("event_type")).alias("sym"))


def event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long sequence of symbols; event_id is the dense position."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lit("ev").alias("seq_id"), F.col("event_id").alias("pos"), _symbol(F.col("event_type")).alias("sym"))


def order_bits(spark: SparkSession, sf_dir: str, threshold: float = 150000.0) -> DataFrame:
    """Orders as one sequence; a bit says whether the price exceeds ``threshold``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.lit("ord").alias("seq_id"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") > threshold).cast("int").alias("bit"))
