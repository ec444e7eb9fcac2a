"""Sharding by sampled splitters, as DataFrame expressions only.

Size-weighted samples of the (key, tie) pairs give quantile boundaries; records fall into the
ranges between them; a range that holds too much is subdivided by samples of its own. Ranges are
small enough to be ordered in one task each, and their exact sizes, summed in order, give every
record its exact place, by bytes and by rows, in the order of the keys.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import stage

#: Splitters per range chosen, so that ranges come out even.
OVERSAMPLE = 8
#: Splitters, at most: 4 MB of one broadcast row. Ranges are of a million records or more, so they are fewer below 10^11 records.
MAX_RANGES = 1 << 18


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or below (key, tie), by binary search in the array column of that name."""
    if not splitters:
        return F.lit(0)
    top = 1 << (len(splitters).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    here = F.struct(F.col("key"), F.col("tie"))
    from_here = lambda lo, step: F.when((lo + step <= len(splitters)) & (F.get(F.col("splitters"), lo + step - 1) <= here), lo + step).otherwise(lo)
    return F.aggregate(steps, F.lit(0), from_here)


def _with_range(records: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """``records`` with their range; the splitters (at most ``MAX_RANGES`` pairs) come as one broadcast row."""
    if not splitters:
        return records.withColumn("range", F.lit(0))
    text = json.dumps([{"key": int(k), "tie": int(t)} for k, t in splitters])
    one = records.sparkSession.range(1).select(F.from_json(F.lit(text), "array<struct<key:bigint,tie:bigint>>").alias("splitters"))
    return records.crossJoin(F.broadcast(one)).withColumn("range", _range_of(splitters)).drop("splitters")


def _sample(records: DataFrame, n: int, total: int, seed: int) -> list[tuple[int, int]]:
    """At most ``n`` (key, tie) pairs, drawn without replacement with chances by size, in order.

    The n smallest of exponential draws whose rates are the sizes. About n draws lie below n / total, so
    none beyond four times that is sent to the driver, however many tasks there are.
    """
    draw = -F.log(1 - F.rand(seed)) / F.col("size")
    drawn = records.select("key", "tie", draw.alias("draw")).where(F.col("draw") < 4.0 * n / max(1, total))
    rows = drawn.orderBy("draw").limit(n).select("key", "tie").collect()
    return sorted((r["key"], r["tie"]) for r in rows)


def _quantiles(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def splitters_for(records: DataFrame, ranges: int, seed: int = 17, rounds: int = 3) -> list[tuple[int, int]]:
    """Boundaries of about ``ranges`` ranges of even size (columns key, tie, size); overfull ranges are subdivided.

    A range is overfull with over twice the mean size and more than one record; each round draws
    fresh samples inside such ranges only.
    """
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = _quantiles(_sample(records, OVERSAMPLE * ranges, total, seed), ranges)
    for r in range(rounds):
        sizes = _with_range(records, found).groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row per range
        limit = 2 * total / max(1, ranges)
        over = [x for x in sizes if x["size"] > limit and x["n"] > 1]
        if not over:
            break
        inside = _with_range(records, found).where(F.col("range").isin([x["range"] for x in over]))
        extra: dict[int, list[tuple[int, int]]] = {}
        for pair in _sample(inside, OVERSAMPLE * 2 * len(over), sum(x["size"] for x in over), seed + r + 1):
            at = bisect_left(found, pair) + (pair in found)
            extra.setdefault(at, []).append(pair)
        new = set(found)
        for x in sorted(over, key=lambda x: -x["size"]):  # the largest first, should there be no room for all
            new.update(_quantiles(extra.get(x["range"], []), int(2 * x["size"] / limit) + 1)[: MAX_RANGES - len(new)])
        if len(new) == len(found):
            break
        found = sorted(new)
    return found


def shard(docs: DataFrame, shards: int = 16, key_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, range, shard (0 to shards - 1) and slot.

    Law "bytes": shards are runs of the records in the order of (key, tie), cut at even shares of
    the total size, so that sizes differ by less than one record's at each end. size is the UTF-8
    bytes of the text (null: none) plus 1. slot counts a shard's records from 0 without gaps. Equal
    keys, however many, are told apart by a fixed tie number; a null key comes first. An empty
    table has no rows.
    """
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")
    src = docs.select(F.col(key_col).cast("long").alias("own"), size.alias("size"), crc.alias("text_crc32"))
    records = stage(src.withColumn("key", F.coalesce("own", F.lit(-(1 << 63)))).withColumn("tie", F.monotonically_increasing_id()), "records")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    # 64 ranges for each shard at least, or one for each 1M records
    ranges = ranges or min(MAX_RANGES // 4, max(64 * shards, total["n"] // 1_000_000))
    placed = _with_range(records, splitters_for(records, ranges))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, MAX_RANGES at most
    sums = stage(placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "ranges")
    before = sums.select("range", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("range").orderBy("key", "tie")
    ranked = placed.withColumn("at", F.sum("size").over(within) - F.col("size")).withColumn("nth", F.row_number().over(within) - 1)
    # a record lies where its middle falls
    middle = 2 * (F.col("bytes_before") + F.col("at")) + F.col("size")
    cut = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * max(1, total["bytes"])).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    ranked = ranked.join(before, "range").select("own", "size", "text_crc32", "range", cut.alias("shard"), (F.col("rows_before") + F.col("nth")).alias("rank"))
    ranked = stage(ranked, "ranked")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
    return ranked.join(F.broadcast(first), "shard").select(F.col("own").alias(key_col), "size", "text_crc32", "range", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

