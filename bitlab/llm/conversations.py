"""The prefix trie of conversations: whole sequences collapsed first, then weighted prefixes.

Conversations are paths of turns. A path's prefix of d turns is named by a sum of hashes of (place,
turn) over its turns, so names of prefixes are running sums, taken in two levels, and no conversation is
ever gathered in a row. Identical conversations collapse to one weighted sequence with the list of
those that end there; sequences that are proper prefixes of others are told from leaves by an
anti-join; then the prefixes of the distinct sequences are aggregated with their weights.

What a subtree holds is summed up without walking the tree. The smallest conversation of a node owns
it. Along a path, owners only grow, so a conversation owns all its nodes from some depth on. Hence
each distinct sequence adds to its prefixes: its weight; its leaf, if it owns one; and for saved bytes, those
of its turns that it does not own, and those of all its turns for each further copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, stage

#: Turns of a chunk of running sums; ids of a piece of an end list.
CHUNK, PIECE = 1024, 256
LOW = (1 << 32) - 1


def ordered_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, a, b, bytes) of every turn: at counts from 1 in each conversation, a and b are hashes of role and text, bytes the text's UTF-8 length.

    Turns are ordered by number, null first; turns of one number by role, then by the MD5 of their text, so
    repeated rows are turns of their own. Null roles and texts are empty. Rows of a null id belong to no conversation and are left out. Other
    columns are not read. Rows are sorted over ranges of (id, number), so a conversation of very many turns
    is spread over tasks; turns are counted within ranges and then over ranges. Texts stay where they are read.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    keyed = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "tie"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stage(placed.select("conv", "place", F.shiftright("place", 33).alias("part"), "a", "b", "bytes"), "turns")
    runs = placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a conversation reaches
    runs = runs.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return stage(placed.join(runs, ["conv", "part"]).select("conv", (F.col("place") - F.col("first") + F.col("before") + 1).alias("at"), "a", "b", "bytes"), "ordered")


def spliced(turns: DataFrame, donor: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns of conversation ``donor``, then their own without their first ``head``.

    Returns (turns, convs): turns like ``turns`` and convs (conv, size), also of those that have no turns left. ``donor`` and
    ``head`` are expressions of conv; a conversation gives few turns to few others. Donors that
    are too short, or not there, give what they have.
    """
    sizes = stage(turns.groupBy("conv").agg(F.max("at").alias("own")).withColumn("donor", donor).withColumn("head", head.cast("long")), "sizes")
    given = sizes.select(F.col("conv").alias("donor"), F.col("own").alias("has"))
    convs = sizes.join(given, "donor", "left").withColumn("given", F.least("head", F.coalesce("has", F.lit(0).cast("long"))))
    convs = stage(convs.withColumn("size", F.col("given") + F.greatest(F.col("own") - F.col("head"), F.lit(0).cast("long"))), "convs")
    most = convs.agg(F.max("given")).first()[0] or 0
    first = turns.where(F.col("at") <= most).withColumnRenamed("conv", "donor")
    heads = first.join(convs.select("conv", "donor", "given"), "donor").where("at <= given").select("conv", "at", "a", "b", "bytes")
    rest = join_hot(turns, convs.select("conv", "head", "given", "own"), ["conv"], "own", turns.count()).where("at > head")
    return heads.unionByName(rest.select("conv", (F.col("at") - F.col("head") + F.col("given")).alias("at"), "a", "b", "bytes")), convs.select("conv", "size")


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, p, q, bytes, through): names of prefixes, the bytes of their last turn and of all."""
    h1, h2 = F.xxhash64("at", "a", "b"), F.xxhash64("b", "a", "at")
    halves = {"x0": h1.bitwiseAND(LOW), "x1": F.shiftrightunsigned(h1, 32), "y0": h2.bitwiseAND(LOW), "y1": F.shiftrightunsigned(h2, 32), "z": F.col("bytes")}
    cut = turns.select("conv", "at", "bytes", F.floor((F.col("at") - 1) / CHUNK).alias("chunk"), *[x.cast("long").alias(k) for k, x in halves.items()])
    inside = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each CHUNK turns
    sums = cut.groupBy("conv", "chunk").agg(*[F.sum(k).alias(f"t{k}") for k in halves])
    sums = sums.select("conv", "chunk", *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0).cast("long")).alias(f"t{k}") for k in halves])
    run = cut.select("conv", "chunk", "at", "bytes", *[F.sum(k).over(inside).alias(k) for k in halves]).join(sums, ["conv", "chunk"])
    whole = {k: F.col(k) + F.col(f"t{k}") for k in halves}
    name = lambda lo, hi: F.shiftleft(whole[hi].bitwiseAND(LOW), 32).bitwiseOR(whole[lo].bitwiseAND(LOW))
    return run.select("conv", F.col("at").alias("depth"), name("x0", "x1").alias("p"), name("y0", "y1").alias("q"), "bytes", whole["z"].alias("through"))


def _end_lists(ends: DataFrame) -> DataFrame:
    """(low, ends_sha256) from ends (low, conv): the ids in order, comma-joined, by pieces of at most ``PIECE`` ids.

    SHA-256 is a fold by nature: a list is read piece by piece, in order, and only the digest's state is held.
    """
    pieces = ends.groupBy("low", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, hashlib.sha256()
        row = lambda low, sha: pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(sha, pa.string())], names=["low", "ends_sha256"])
        for b in batches:
            low, sha = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == of:
                    state.update(b",")
                else:
                    if of is not None:
                        low.append(of)
                        sha.append(state.hexdigest())
                    of, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield row(low, sha)
        if of is not None:
            yield row([of], [state.hexdigest()])

    return pieces.repartition("low").sortWithinPartitions("low", "piece").select("low", "ids").mapInArrow(fold, "low long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv, at, a, b, bytes) of the conversations ``convs`` (conv, size), as longs.

    conv_id, the smallest member, and depth name a node; parent_conv_id (null at the root), n_convs
    members, n_children, n_leaves and saved_tokens within its subtree, ends_sha256 of the members that end at it. ``at``
    counts from 1 to size; a conversation of size 0 has no turns and ends at the root. Turns are equal by 128 bits of
    hashes of (place, a, b). Without conversations there is no node, not even a root.
    """
    node, none = ["depth", "p", "q"], F.lit(0).cast("long")
    # whole sequences: one row for each conversation, then one for each distinct sequence
    paths = stage(_paths(turns), "paths")
    n_paths = paths.count()
    turnless = convs.where("size = 0").select("conv", *[none.alias(c) for c in (*node, "through")])
    whole = stage(paths.join(convs.withColumnRenamed("size", "depth"), ["conv", "depth"]).select("conv", *node, "through").unionByName(turnless), "whole")
    sequences = stage(whole.groupBy(*node).agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("weight"), F.max("through").alias("total")), "sequences")
    ends = join_hot(whole.select("conv", *node), sequences.select(*node, "low", "weight"), node, "weight", whole.count())
    ends = stage(_end_lists(ends.select("low", "conv")), "end-lists")
    # prefixes of the distinct sequences, and which of those owns each; leaves are no proper prefixes
    size = sequences.select(F.col("low").alias("conv"), F.col("depth").alias("size"), F.col("depth").alias("n"))
    prefixes = stage(join_hot(paths, size, ["conv"], "n", n_paths), "prefixes")
    n_prefixes = prefixes.count()
    owners = stage(prefixes.groupBy(*node).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.max(F.col("depth") < F.col("size")).alias("proper")), "owners")
    leaves = sequences.where("depth > 0").join(owners.where("proper").select(*node), node, "left_anti").select(F.col("low").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    first = sequences.agg(F.min("low").alias("first"))  # one row
    foreign = F.col("owner") != F.col("conv")
    path = join_hot(prefixes, owners.select(*node, "owner", "n"), node, "n", n_prefixes).groupBy("conv").agg(
        F.min(F.when(~foreign, F.col("depth"))).alias("own"), F.max(F.when(foreign, F.col("owner"))).alias("above"), F.max(F.when(foreign, F.col("through"))).alias("shared"), F.max("size").alias("n"))
    path = path.join(leaves, "conv", "left").join(sequences.select(F.col("low").alias("conv"), "weight", "total"), "conv").crossJoin(F.broadcast(first))
    path = stage(path.select("conv", "n", F.coalesce("own", F.col("n") + 1).alias("own"), F.coalesce("above", "first").alias("above"), F.coalesce("shared", none).alias("shared"), F.coalesce("leaf", none).alias("leaf"), "weight", "total"), "sequence-paths")
    # weighted prefixes: what each sequence adds to the nodes on its path
    saved = lambda before: F.greatest(F.col("shared") - before, none) + (F.col("weight") - 1) * (F.col("total") - before)
    starts = lambda depth: ((F.col("own") <= depth) & (F.lit(depth) <= F.col("n") if isinstance(depth, int) else depth <= F.col("size"))).cast("long")
    sums = lambda before, depth: (F.sum(starts(depth)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved(before)).alias("saved_tokens"))
    owner = F.when(F.col("own") < F.col("depth"), F.col("conv")).when(F.col("own") == F.col("depth"), F.col("above"))
    nodes = join_hot(prefixes, path, ["conv"], "n", n_prefixes).groupBy(*node).agg(
        F.min("conv").alias("conv_id"), F.max(owner).alias("parent_conv_id"), F.sum("weight").alias("n_convs"), *sums(F.col("through") - F.col("bytes"), F.col("depth") + 1), F.max(F.when(F.col("depth") == F.col("size"), F.col("conv"))).alias("low"))
    top = sequences.agg(F.min("low").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("depth") == 0, F.col("low"))).alias("low")).where("n_convs > 0")
    root = top.crossJoin(F.broadcast(path.agg(*sums(none, 1))))  # one row each
    root = root.withColumn("n_children", F.coalesce("n_children", none)).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).withColumn("saved_tokens", F.coalesce("saved_tokens", none))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "low"]
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves")).select(*columns).unionByName(root.withColumn("depth", none).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    nodes = stage(nodes.select(*[F.col(c).cast("long").alias(c) for c in columns]), "nodes")
    ending = nodes.where("low IS NOT NULL").join(ends, "low")  # nodes at which nobody ends share no key
    return ending.select(*columns[:-1], "ends_sha256").unionByName(nodes.where("low IS NULL").select(*columns[:-1], F.sha2(F.lit(""), 256).alias("ends_sha256")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the head of the first of its five."""
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*spliced(turns, F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9))


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, s, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(c AS VARCHAR))), lambda i: CAST(ord(CAST(c AS VARCHAR)[i + 1]) AS BIGINT))),
                                   lambda a, y: xor(a // 256, t[xor(a % 256, y) + 1])), 4294967295) % 9 AS h FROM o, crc),
b AS (SELECT a.c, list_concat(coalesce(d.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM h a LEFT JOIN o d ON d.c = a.c - a.c % 5),
p AS MATERIALIZED (SELECT c, d, len(s) AS size, md5(CAST(s[1:d] AS VARCHAR)) AS k, strlen(s[d].x) AS bytes FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT d, k, min(c) AS low, count(*) AS n, max(coalesce(bytes, 0)) AS bytes, bool_or(d < size) AS proper,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '')) AS ends FROM p GROUP BY 1, 2),
u AS MATERIALIZED (SELECT a.d, a.k, n.d AS below, n.n, n.bytes, n.proper FROM n JOIN p a ON a.c = n.low AND a.d <= n.d),
s AS (SELECT d, k, count(*) FILTER (below = d + 1) AS n_children, count(*) FILTER (NOT proper) AS n_leaves, sum((n - 1) * bytes) AS saved FROM u GROUP BY 1, 2)
SELECT n.low AS conv_id, n.d AS depth, up.low AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN p ON p.c = n.low AND p.d = n.d - 1 LEFT JOIN n up ON up.d = p.d AND up.k = p.k
"""
