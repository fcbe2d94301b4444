"""Pairs of boxes of one group that may touch, without pairing out a group.

A group of more than ``CROWDED`` boxes is laid out in a grid whose cells are as wide as its widest box:
boxes that touch have their centres in the same or in adjoining cells. One side goes to the cell of its
centre, the other to the nine cells about its own; smaller groups are one cell. The cells are join
keys, so a group of any size is spread over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CROWDED = 64
FINEST = 512  # cells a side


def touching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., l, r) of pairs of structs that may touch; left and right are (keys..., s) with s a
    struct that has x1, y1, x2, y2. Boxes without size are pairs of what they lie in."""
    side = F.greatest(F.col("s.x2") - F.col("s.x1"), F.col("s.y2") - F.col("s.y1"))
    both = left.select(*keys, side.alias("w"), F.lit(0).alias("n")).unionByName(right.select(*keys, side.alias("w"), F.lit(1).alias("n")))
    grid = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    fine = F.least(F.lit(FINEST), F.greatest(F.lit(1), F.floor(1 / F.greatest(F.col("w"), F.lit(1e-6)))))
    grid = grid.select(*keys, F.when(F.col("n") > CROWDED, fine).otherwise(F.lit(0)).cast("int").alias("_g"))
    at = lambda lo, hi: F.when(F.col("_g") > 0, F.floor((F.col(lo) + F.col(hi)) / 2 * F.col("_g")).cast("int")).otherwise(0)
    about = lambda c: F.when(F.col("_g") > 0, F.sequence(c - 1, c + 1)).otherwise(F.array(F.lit(0)))
    x, y = at("s.x1", "s.x2"), at("s.y1", "s.y2")
    r = right.join(grid, keys).select(*keys, x.alias("_x"), y.alias("_y"), F.col("s").alias("r"))
    l = left.join(grid, keys).select(*keys, F.col("s").alias("l"), F.explode(about(x)).alias("_x"), about(y).alias("_ys"))  # noqa: E741
    l = l.select(*keys, "l", "_x", F.explode("_ys").alias("_y"))  # noqa: E741
    return l.join(r, [*keys, "_x", "_y"]).select(*keys, "l", "r")
