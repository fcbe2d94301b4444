"""Label counting and validation (S5 semantics, P1-P2, P7, G1-G3, J1).

Token rule of a label line: 5 tokens are a box, 9 an oriented box, 7 or more (odd) a polygon. Other
counts are an invalid object; an unreadable line is invalid and no object. A number that is not
finite makes its line invalid. Null and blank lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds tokens, n_tokens, class_id, vals, kind, is_object and is_valid."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+", " "))
    d = lines.withColumn("tokens", F.split(text, " ")).filter(text != "")
    d = d.withColumn("n_tokens", F.size("tokens")).withColumn("_nums", F.transform("tokens", lambda x: x.try_cast("double")))
    bad = F.exists("_nums", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cls = F.get("_nums", F.lit(0))
    vals = F.slice("_nums", 2, F.greatest(F.col("n_tokens") - 1, F.lit(0)))
    kind = F.when(F.col("n_tokens") == 5, "detect").when(F.col("n_tokens") == 9, "obb").when((F.col("n_tokens") >= 7) & (F.col("n_tokens") % 2 == 1), "seg").otherwise("unknown")
    d = d.withColumn("class_id", F.when(~bad, cls.cast("int"))).withColumn("vals", F.when(~bad, vals)).withColumn("kind", F.when(~bad, kind)).withColumn("is_object", ~bad)
    v = lambda i: F.get("vals", F.lit(i))
    unit = lambda x: (x >= 0) & (x <= 1)
    in_range = F.when(F.col("kind") == "detect", unit(v(0)) & unit(v(1)) & (v(2) > 0) & (v(2) <= 1) & (v(3) > 0) & (v(3) <= 1)).when(F.col("kind").isin("obb", "seg"), F.forall("vals", unit)).otherwise(F.lit(False))
    return d.withColumn("is_valid", F.coalesce(in_range & ~bad, F.lit(False))).drop("_nums")


def file_kind(parsed: DataFrame, *keys: str) -> DataFrame:
    """The most common kind of a file's lines, the first seen on ties."""
    per = parsed.filter("is_object").groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return per.groupBy(*keys).agg(F.max_by("kind", F.struct(F.col("n"), -F.col("first"))).alias("kind"))


def class_rollup(boxes: DataFrame) -> DataFrame:
    """Counts by split and class with their subtotals in one pass (G1)."""
    return boxes.rollup("split", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def class_imbalance(boxes: DataFrame, *keys: str) -> DataFrame:
    """Largest over smallest positive class count; null below two classes."""
    n = boxes.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.count(F.lit(1)) >= 2, F.max("n") / F.greatest(F.lit(1), F.min("n")))
    return n.groupBy(*keys).agg(ratio.alias("imbalance"), F.count(F.lit(1)).alias("n_classes"))


def missing_labels(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """Images without any label entry: an empty label file is an entry."""
    return images.join(labels.select(key).distinct(), key, "left_anti")


def objects_per_image(images: DataFrame, boxes: DataFrame, key: str = "stem") -> DataFrame:
    """How many images have each number of objects, zero included."""
    n = boxes.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return images.select(key).join(n, key, "left").groupBy(F.coalesce("c", F.lit(0)).alias("n_objects")).agg(F.count(F.lit(1)).alias("n_images"))


def coco_problems(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Each annotation's number of faults, 0 to 3: unknown image, no area, no segmentation."""
    known = images.select(F.col("id").alias("image_id")).distinct().withColumn("_known", F.lit(1))
    one = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    a = annotations.select("id", "image_id", "area", F.size("segmentation").alias("n_seg"))
    j = a.join(known, "image_id", "left")
    return j.select("id", F.col("_known").isNull().cast("int").alias("unknown_image"), one(F.col("area") <= 0).alias("no_area"), one(F.col("n_seg") <= 0).alias("no_segmentation"))


def warnings(counts: Column | None = None, **rules: Column) -> Column:
    """array<string> of the names of the rules that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
