"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b); component is its smallest node.

    Each round hangs nodes onto the smallest neighbour they know; the number of rounds grows with the
    logarithm of the longest chain. Every round is one written table, so lineage stays short. Raises
    if ``max_rounds`` do not suffice (2^30 nodes in a chain take about 30).
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    n_edges = edges.count()
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest known node; hubs have many
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-low")
        large = stage(join_hot(both, low, ["u"], "n", 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # small star: smaller neighbours, and the node itself, go to the smallest
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
        small = join_hot(large, low, ["u"], "n", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = stage(small.where("u <> v").distinct(), "cc")
        n_new = new.count()
        settled = n_new == n_edges and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, n_edges = new, n_new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
