"""Space-filling maps: Hilbert coordinates of positions, block statistics and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlab.operators.chunks import correlation


def hilbert(pos: Column, order: int) -> Column:
    """struct(x, y) of a position on the Hilbert curve of 4^order cells, by arithmetic alone."""
    state = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), pos.cast("long").alias("t"))

    def step(a: Column, s: Column) -> Column:
        rx = F.floor(a["t"] / 2) % 2
        ry = a["t"] % 2
        ry = F.when(rx == ry, 0).otherwise(1)  # the low bit xor rx
        turn = ry == 0
        x = F.when(turn & (rx == 1), s - 1 - a["x"]).otherwise(a["x"])
        y = F.when(turn & (rx == 1), s - 1 - a["y"]).otherwise(a["y"])
        return F.struct((F.when(turn, y).otherwise(x) + s * rx).cast("long").alias("x"), (F.when(turn, x).otherwise(y) + s * ry).cast("long").alias("y"), F.floor(a["t"] / 4).cast("long").alias("t"))

    return F.aggregate(F.array(*[F.lit(1 << i).cast("long") for i in range(order)]), state, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def grid(bits: DataFrame, order: int, cell: int = 1) -> DataFrame:
    """(x, y, ones, total): consecutive bits to each cell of a Hilbert curve: ``cell`` of them, or as many more as it takes for the last position to fit on it."""
    fit = bits.agg(F.greatest(F.lit(cell).cast("long"), F.ceil((F.max("pos") + 1) / 4**order)).alias("_cell"))
    at = bits.crossJoin(F.broadcast(fit)).groupBy(F.floor(F.col("pos") / F.col("_cell")).cast("long").alias("d")).agg(F.sum("bit").alias("ones"), F.count(F.lit(1)).alias("total"))  # one row
    return at.select(hilbert(F.col("d"), order).alias("h"), "ones", "total").select("h.x", "h.y", "ones", "total")


def rebin(cells: DataFrame, factor: int) -> DataFrame:
    """(x, y, ones, total) of blocks of ``factor`` by ``factor`` cells."""
    return cells.groupBy(F.floor(F.col("x") / factor).cast("long").alias("x"), F.floor(F.col("y") / factor).cast("long").alias("y")).agg(F.sum("ones").alias("ones"), F.sum("total").alias("total"))


def density_stats(cells: DataFrame) -> DataFrame:
    """(cells, mean, std, lowest, highest) of the cells' densities."""
    d = F.col("ones").cast("double") / F.col("total")
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_pop(d), 6).alias("std"), F.round(F.min(d), 6).alias("lowest"), F.round(F.max(d), 6).alias("highest"))


def neighbour_correlation(cells: DataFrame, order: int) -> DataFrame:
    """(dx, dy, n, r): correlation of densities with those of the right and lower neighbours, around the edges; 0 if constant."""
    n = 1 << order
    d = cells.select("x", "y", (F.col("ones").cast("double") / F.col("total")).alias("d"))
    shifts = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    to = d.withColumn("s", F.explode(shifts)).select(((F.col("x") + F.col("s.dx")) % n).alias("x"), ((F.col("y") + F.col("s.dy")) % n).alias("y"), "s.dx", "s.dy", F.col("d").alias("e"))
    out = d.join(to, ["x", "y"]).groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("d"), F.col("e")).alias("r"))
    return out.select("dx", "dy", "n", F.round("r", 6).alias("r"))


def local_mean(cells: DataFrame, order: int, reach: int = 2) -> DataFrame:
    """(x, y, mean): mean density of the square around each cell, cells beyond the edge counting as zero."""
    n, side = 1 << order, 2 * reach + 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    d = cells.select("x", "y", (F.col("ones").cast("double") / F.col("total")).alias("d")).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    to = d.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "d").where((F.col("x").between(0, n - 1)) & (F.col("y").between(0, n - 1)))
    return to.groupBy("x", "y").agg(F.round(F.sum("d") / (side * side), 6).alias("mean"))
