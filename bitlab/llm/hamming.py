"""Exact top-k by Hamming distance: incremental multi-index hashing of binary codes.

A code is one long, or an array of longs for more than 64 bits. It is cut into segments, each
indexed on its own, whose width follows the number of codes. Round r probes, for every query
that is still open, all segment values at distance r. After it, every code that was not met differs
in more than r bits in each segment, so lies at distance segments * (r + 1) or more: a query whose
k-th verified distance is smaller is done. Only where a round would have a query probe more values
than there are codes, so that looking at every code costs less, are the open queries compared with all, in blocks.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import stage


#: A side of a probe's join with at most this many rows is broadcast: five longs a row, some 10 MB.
BROADCAST_ROWS = 1 << 17
#: Probes that one task generates.
TASK_PROBES = 1 << 18


def segment_bits(n_codes: int) -> int:
    """The width of segments: 16 bits where codes fill so many values at least in part, else 8."""
    return 16 if n_codes >= 1 << 14 else 8


def sign_code(embedding: Column) -> Column:
    """The signs of the dimensions: bit i % 64 of long i div 64 is 1 if dimension i is above zero. Null for null.

    Up to 64 dimensions, and no dimensions, make one long. A null dimension is zero; NaN is above zero.
    """
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(embedding, bit)
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(embedding.isNotNull(), F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(embedding) / 64).cast("int") - 1, F.lit(0))), word))


def _words(code: str, n: int) -> list[str]:
    return [f"{code}{i}" for i in range(n)]


def _segment(words: list[str], width: int, s: int) -> Column:
    """Segment ``s`` of the code in ``words``."""
    per = 64 // width
    return F.call_function("shiftrightunsigned", F.col(words[s // per]), F.lit(s % per * width)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _segments(words: list[str], width: int) -> Column:
    every = [F.struct(F.lit(s).alias("seg"), _segment(words, width, s).alias("value")) for s in range(len(words) * 64 // width)]
    return F.explode(F.array(*every))


def _best(rows: DataFrame, q: list[str], c: list[str], k: int) -> DataFrame:
    """The k nearest codes of each query, by distance, then by smallest id."""
    order = Window.partitionBy(*q).orderBy("d", "low")
    return rows.groupBy(*q, *c).agg(F.min("d").alias("d"), F.min("low").alias("low")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, rounds: list[int] | None = None) -> DataFrame:
    """query_id, rank (from 1), id and distance: for each query its k nearest rows, ties by smaller id.

    ``rows`` and ``queries`` have (id, code), code a long or an array of longs; rows with a null code
    are neither found nor ask. Shorter arrays count as filled up with zero bits. Rows of equal codes are one code in
    the search, which keeps its k smallest ids. With fewer than k rows in all, each query has all of
    them. An empty table has no rows. Other columns are not read. ``rounds`` takes the number of
    open queries after each round; a scan of all codes appends -1.
    """
    as_array = lambda df: df.where("code IS NOT NULL").select("id", (F.col("code") if dict(df.dtypes)["code"].startswith("array") else F.array("code")).alias("code"))
    rows, queries = as_array(rows), as_array(queries)
    n_words = max(1, rows.unionByName(queries).agg(F.max(F.size("code"))).first()[0] or 1)
    c, q = _words("c", n_words), _words("q", n_words)
    word = lambda i: F.coalesce(F.get("code", i), F.lit(0)).cast("long")
    rows = rows.select("id", *[word(i).alias(x) for i, x in enumerate(c)])
    queries = stage(queries.select("id", *[word(i).alias(x) for i, x in enumerate(q)]), "hamming-queries")
    # a code's k smallest ids; the limit is taken before the shuffle too
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy(*c).orderBy("id"))).where(F.col("n") <= k)
    codes = stage(firsts.groupBy(*c).agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    n_codes = codes.count()
    width = segment_bits(n_codes)
    segments = n_words * 64 // width
    known = codes.select(*c, F.get("ids", 0).alias("low"))
    index = known.select(*c, "low", _segments(c, width).alias("s")).select(*c, "low", "s.seg", "s.value")
    distance = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(q, c, strict=True)), F.lit(0)).cast("int")
    open_ = stage(queries.select(*q).distinct().withColumn("bound", F.lit(64 * n_words)), "open")
    n_open = open_.count()
    found = None
    for r in range(width + 1):
        scan = segments * comb(width, r) > n_codes
        blocks = max(1, n_codes // 4096)
        n_left, n_right = (n_open * blocks, n_codes) if scan else (n_open * segments * comb(width, r), n_codes * segments)
        spread = open_.repartition(min(1 << 15, 1 + n_left // TASK_PROBES))
        if scan:
            left = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            right = known.withColumn("block", F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int"))
            on = left["block"] == right["block"]
        else:
            masks = F.array(*[F.lit(sum(1 << i for i in at)).cast("long") for at in combinations(range(width), r)])  # fewer than codes
            probes = spread.select(*q, "bound", _segments(q, width).alias("s")).select(*q, "bound", "s.*", F.explode(masks).alias("mask"))
            left = probes.select(*q, "bound", F.col("seg").alias("seg_"), F.col("value").bitwiseXOR(F.col("mask")).alias("value_"))
            right = index
            on = (F.col("seg_") == F.col("seg")) & (F.col("value_") == F.col("value"))
        # both sides are exploded, so the planner would take them for as small as their files
        if min(n_left, n_right) > BROADCAST_ROWS:
            left = left.hint("merge")
        elif n_left < n_right:
            left = F.broadcast(left)
        else:
            right = F.broadcast(right)
        met = left.join(right, on & (distance <= F.col("bound"))).select(*q, *c, distance.alias("d"), "low")
        met = met if found is None else met.unionByName(found.drop("n"))
        found = stage(_best(met, q, c, k), "found")
        if scan:
            if rounds is not None:
                rounds.append(-1)
            break
        kth = found.where(F.col("n") == k).select(*[F.col(x).alias(f"{x}_") for x in q], F.col("d").alias("kth"))
        same = [F.col(x) == F.col(f"{x}_") for x in q]
        left_open = open_.join(kth, same, "left").where(F.col("kth").isNull() | (F.col("kth") >= segments * (r + 1)))
        open_ = stage(left_open.select(*q, F.coalesce("kth", F.lit(64 * n_words)).alias("bound")), "open")
        n_open = open_.count()
        if rounds is not None:
            rounds.append(n_open)
        if not n_open:
            break
    ids = found.join(codes, c).select(*q, "d", F.explode("ids").alias("id"))
    nearest = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*q).orderBy("d", "id"))).where(F.col("rank") <= k)
    return queries.withColumnRenamed("id", "query_id").join(nearest, q).select("query_id", "rank", "id", F.col("d").alias("distance"))


def op8_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes, among all, of every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("id % 50 = 0")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.s, b.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM e a, e b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
