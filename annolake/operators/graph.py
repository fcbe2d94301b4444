"""Connected components by hooking and shortcutting over a parent table.

Keys are turned into stars around the smallest of their records by a map-side combined minimum, so a
key that holds any share of the records costs one edge per record and is never collected. Each round
hooks the larger root of an edge under the smaller and shortcuts all trees to stars; edges inside
one tree drop out. Vertices without edges are their own component; null keys must be filtered by
the caller; empty inputs give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.session import checkpoint


def star_edges(links: DataFrame) -> DataFrame:
    """(u, v) with v the smallest record of the key, from links (v, key...)."""
    keys = [c for c in links.columns if c != "v"]
    hub = links.groupBy(*keys).agg(F.min("v").alias("hub"))
    return links.join(hub, keys).filter("v <> hub").select(F.col("v").alias("u"), F.col("hub").alias("v"))


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root): hooking and shortcutting over the parent table; root is the smallest vertex."""
    lowest = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"))
    parent = checkpoint(vertices.select("v").distinct().join(lowest, F.col("v") == F.col("w"), "left").select("v", F.least("v", F.coalesce("low", "v")).alias("root")))
    edges = checkpoint(edges.filter("u <> v").distinct())
    for _ in range(max_rounds):
        while True:  # shortcut until all trees are stars
            grand = parent.select(F.col("v").alias("gv"), F.col("root").alias("groot")).filter("gv <> groot")
            jumped = checkpoint(parent.join(grand, F.col("root") == F.col("gv"), "left").select("v", F.coalesce("groot", "root").alias("root"), F.col("groot").isNotNull().alias("moved")))
            parent = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        ru = parent.select(F.col("v").alias("u"), F.col("root").alias("ru"))
        rv = parent.withColumnRenamed("root", "rv")
        # an edge inside one tree can never hook again: it drops out
        edges = checkpoint(edges.join(ru, "u").join(rv, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        if edges.isEmpty():
            return parent
        hook = edges.groupBy(F.greatest("u", "v").alias("big")).agg(F.min(F.least("u", "v")).alias("small"))
        parent = checkpoint(parent.join(hook, F.col("root") == F.col("big"), "left").select("v", F.coalesce("small", "root").alias("root")))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
