"""Whole-dataset reports from files (G25, K13, P16, P17): analysis, quality, comparison.

Each figure is one small aggregate; only these reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import pixels as px
from annolake.operators import labels, profile, similarity
from annolake.sources import readers

SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def boxes_of(parsed: DataFrame, classes: dict[int, str] | None = None) -> DataFrame:
    """Valid lines of any kind as boxes (split, stem, ord, label, cx, cy, w, h); an unknown class
    goes by its number (J5)."""
    xs = F.filter("vals", lambda _, i: i % 2 == 0)
    ys = F.filter("vals", lambda _, i: i % 2 == 1)
    is_box = F.col("kind") == "detect"
    at = lambda i: F.get("vals", F.lit(i))
    mid = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    span = lambda a: F.array_max(a) - F.array_min(a)
    names = F.create_map(*(F.lit(x) for k, v in (classes or {}).items() for x in (k, v))) if classes else None
    label = F.col("class_id").cast("string")
    label = F.coalesce(F.try_element_at(names, F.col("class_id")), label) if names is not None else label
    return parsed.filter("is_valid").select(
        "split", "stem", F.lpad(F.col("line_no").cast("string"), 9, "0").alias("ord"), label.alias("label"),
        *(F.when(is_box, at(i)).otherwise(f(a)).alias(n) for i, n, f, a in ((0, "cx", mid, xs), (1, "cy", mid, ys), (2, "w", span, xs), (3, "h", span, ys))),
        F.when(~is_box, F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.get(ys, i).alias("y")))).alias("points"),
    )


def analyze(spark: SparkSession, root: str, modality: str = "labels") -> dict:
    """Counts and faults of a data set's labels, with warnings."""
    images, lines = readers.list_images(spark, root), readers.read_label_lines(spark, root, modality)
    p = labels.with_tokens(lines)
    missing = labels.missing_labels(images, lines).count()
    n = p.agg(F.count_if("is_object").alias("objects"), F.count_if(~F.col("is_valid")).alias("invalid")).first()
    empty = lines.filter("line_no is null").count()
    by_class = {r["class_id"]: r["n"] for r in p.filter("is_object").groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = max(by_class.values()) / max(1, min(by_class.values())) if len(by_class) > 1 else None
    out = {"images": images.count(), "objects": n["objects"], "invalid": n["invalid"], "missing_labels": missing, "empty_labels": empty, "classes": by_class, "class_imbalance": spread}
    rules = (("missing label files", missing), ("invalid label lines", n["invalid"]), ("class imbalance above 10", spread is not None and spread > 10))
    return out | {"warnings": [w for w, bad in rules if bad]}


def quality(spark: SparkSession, root: str, threshold: int = 6, embedding_threshold: float = 0.995) -> dict:
    """Analysis, exact, perceptual and embedding duplicates, cross-split leakage and diversity from
    one pass over the pixels."""
    report = analyze(spark, root)
    files = readers.list_images(spark, root)
    decoded = px.image_features(readers.read_images(spark, f"{root}/images")).withColumn("key", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/images").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("key"), F.sha1("content").alias("digest"))
    f = files.withColumn("key", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).join(decoded.drop("path"), "key", "left").join(raw, "key", "left")
    f = f.withColumn("pos", F.xxhash64("key")).cache()  # stages below read the same features
    v = f.filter(F.col("vec").isNotNull()).select(F.col("pos").alias("id"), "vec", "split")
    u = similarity.uniqueness(v.select("id", "vec")).first().asDict()
    leak = similarity.cross_split_exact(f, SPLIT_ORDER).count()
    near = similarity.cross_split_nearest(v, SPLIT_ORDER, embedding_threshold).select("id").distinct().count()
    copies = similarity.exact_duplicates(f)
    # a near duplicate is no exact copy of any earlier picture
    ph = similarity.near_hashes(f.select("pos", "phash"), threshold).join(copies.select("pos"), "pos", "left_anti").count()
    dup, perceptual = copies.count(), similarity.cross_split_near(f, SPLIT_ORDER, threshold).count()
    report |= {
        "unreadable": f.filter("phash is null").count(), "duplicates": dup, "near_duplicates": ph, "cross_split_exact": leak, "cross_split_near": perceptual, "cross_split_embedding": near,
        "diversity": u, "perceptual": similarity.perceptual_diversity(f).first().asDict(),
    }
    f.unpersist()
    rules = (("unreadable images", report["unreadable"]), ("duplicate images", dup), ("near-duplicate images", ph), ("cross-split exact leakage", leak), ("cross-split perceptual leakage", perceptual), ("cross-split embedding leakage", near))
    report["warnings"] += [w for w, bad in rules if bad]
    return report | {"health": "warning" if report["warnings"] else "ok"}


def drift_warnings(distances: dict[str, float], images: int, target_images: int) -> list[str]:
    """Warnings of drift from a target profile, for at least 50 images on both sides."""
    if min(images, target_images) < 50:
        return []
    rules = (("class distribution drift", "class", 0.20), ("placement drift", "placement", 0.25))
    return [f"{t}: {distances[k]:.3f}" for t, k, most in rules if (distances.get(k) or 0.0) > most]


def recommendations(distances: dict[str, float | None], centroid: float | None = None, nearest: float | None = None) -> list[str]:
    """What two data sets' distances suggest."""
    d = {k: v or 0.0 for k, v in distances.items()}
    rules = (
        ("rebalance classes", d.get("class", 0.0) > 0.15), ("revise placement", d.get("placement", 0.0) > 0.20), ("revise crowding", d.get("overlap_iou", 0.0) > 0.20),
        ("close the gap in appearance", centroid is not None and centroid < 0.90), ("look for leakage", nearest is not None and nearest > 0.995),
    )
    return [t for t, bad in rules if bad]


def compare(spark: SparkSession, a: str, b: str) -> dict:
    """Distances of two data sets' label distributions, with recommendations."""
    boxes = [profile.in_context(boxes_of(labels.with_tokens(readers.read_label_lines(spark, x)))) for x in (a, b)]
    images = tuple(readers.list_images(spark, x) for x in (a, b))
    rows = {r["metric"]: r["distance"] for r in profile.compare(*boxes, images=images).collect()}
    return {"class_distance": rows.get("class"), "placement_distance": rows.get("placement"), "metrics": rows, "recommendations": recommendations(rows)}
