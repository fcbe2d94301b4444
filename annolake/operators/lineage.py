"""Lineage of samples: reuse, source-aware splits and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.operators.graph import components, star_edges
from annolake.operators.ranking import running


def source_key(source, shape_index):
    """basename#shape; a missing shape is 0, a blank source none."""
    base = F.regexp_extract(source, r"([^/\\]+)$", 1)
    return F.when(F.length(F.trim(F.coalesce(source, F.lit("")))) > 0, F.concat(base, F.lit("#"), F.coalesce(shape_index.cast("string"), F.lit("0"))))


def reuse(log: DataFrame, by: str, stem: str = "stem") -> DataFrame:
    """Distinct images per background or source."""
    return log.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count_distinct(stem).alias("n_images"))


def source_groups(edges: DataFrame) -> DataFrame:
    """(stem, gid): images linked over shared sources, gid the smallest stem."""
    stems = edges.select(F.col("stem").alias("v")).distinct()
    links = edges.filter(F.col("source").isNotNull()).select(F.col("stem").alias("v"), "source").distinct()
    return components(stems, star_edges(links)).select(F.col("v").alias("stem"), F.col("root").alias("gid"))


def assign_split(groups: DataFrame, val_ratio: float, seed: int = 42) -> DataFrame:
    """(gid, size, split): groups by size then seeded hash go to val while that brings its total
    closer to the target; equal to a prefix test on the running total (W7)."""
    if not 0.0 <= val_ratio < 1.0:
        raise ValueError("val_ratio must lie in [0, 1)")
    g = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    g = g.withColumn("h", F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("gid").cast("string")), 256), 1, 16))
    total = groups.count()
    target = round(total * val_ratio)  # half to even
    r = running(g, [F.col("size"), F.col("h"), F.col("gid")], [F.col("size"), F.substring("h", 1, 2)], value=F.col("size"), name="before")
    val = (F.col("before") < target) & (F.col("size") <= 2 * (target - F.col("before")))
    return r.select("gid", "size", F.when(val, "val").otherwise("train").alias("split"))



def split_leaks(log: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """Sources with images in more than one split."""
    return log.filter(F.col(source).isNotNull()).groupBy(source).agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b").select(source)
