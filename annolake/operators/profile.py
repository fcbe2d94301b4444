"""Distribution profiles: observation, learning, comparison, mixture.

Boxes are normalised (label, cx, cy, w, h). A profile is three small tables: counts and probabilities
of the classes, histograms (label, metric, bin, n) with every metric and bin of a class present, and
how many images hold how many objects. ``learn`` gives them as one document, as many figures as there
are classes times metrics times bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.operators.neighbours import touching

#: metric -> upper end of its range; all start at 0
METRICS = {"center_x": 1.0, "center_y": 1.0, "bottom_y": 1.0, "width": 1.0, "height": 1.0, "area": 1.0, "aspect_ratio": 5.0}
#: metrics of a box among others and of its shape, where the boxes carry them
CONTEXT = {"overlap_iou": 1.0, "visible_shape_fraction": 1.0}


def _values(boxes: DataFrame) -> dict[str, tuple]:
    w, h = F.greatest(F.lit(1e-8), F.col("w")), F.greatest(F.lit(1e-8), F.col("h"))
    v = {"center_x": F.col("cx"), "center_y": F.col("cy"), "bottom_y": F.col("cy") + h / 2, "width": w, "height": h, "area": w * h, "aspect_ratio": w / h}
    return {k: (x, METRICS[k]) for k, x in v.items()} | {k: (F.col(k), hi) for k, hi in CONTEXT.items() if k in boxes.columns}


def box_metrics(boxes: DataFrame) -> DataFrame:
    """Boxes in long form: one row per metric."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), x.cast("double").alias("value"), F.lit(hi).alias("hi")) for k, (x, hi) in _values(boxes).items()))
    return boxes.withColumn("m", F.explode(rows)).select("*", "m.*").drop("m")


def histograms(boxes: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys…, metric, bin, n) with all metrics and bins present (G7); values that are not finite
    are skipped."""
    v = F.col("value")
    t = F.least(F.col("hi") - 1e-12, F.greatest(F.lit(0.0), v)) / F.col("hi")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    b = F.when(finite, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(t * bins).cast("int"))))
    n = box_metrics(boxes).groupBy(*keys, "metric", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cells = n.groupBy(*keys, "metric").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))
    dense = cells.select(*keys, "metric", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.select(*keys, "metric", "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("n"))


def crowding(boxes: DataFrame, key: str = "stem") -> DataFrame:
    """Each box's largest IoU with another box of its image (J6); ``ord`` tells the boxes of an image
    apart. Only boxes that may touch are pairs (``neighbours``), the largest overlap is a map-side
    combined maximum, so an image of any size is spread over tasks."""
    c = boxes.select(key, "ord", "label", g.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("box"))
    s = c.select(key, F.struct("box.*", "ord").alias("s"))
    pairs = touching(s, s, [key]).filter(F.col("l.ord") != F.col("r.ord"))
    most = pairs.groupBy(key, F.col("l.ord").alias("ord")).agg(F.max(g.box_iou(F.col("l"), F.col("r"))).alias("m"))
    return c.join(most, [key, "ord"], "left").select(key, "ord", "label", F.coalesce("m", F.lit(0.0)).alias("max_iou"))


def in_context(boxes: DataFrame, key: str = "stem") -> DataFrame:
    """Boxes with the two metrics of their surroundings and shape: ``overlap_iou`` by ``crowding``,
    ``visible_shape_fraction`` the polygon's (``points``) share of its box, null without a polygon."""
    near = crowding(boxes, key).select(key, "ord", F.round("max_iou", 9).alias("overlap_iou"))
    out = boxes.join(near, [key, "ord"])
    if "visible_shape_fraction" in boxes.columns:
        return out
    if "points" not in boxes.columns:
        return out.withColumn("visible_shape_fraction", F.lit(None).cast("double"))
    share = g.polygon_area(F.col("points")) / F.greatest(F.lit(1e-12), F.col("w") * F.col("h"))
    return out.withColumn("visible_shape_fraction", F.when(F.size("points") >= 3, F.least(F.lit(1.0), share)))


def coco_boxes(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """(stem, ord, label, cx, cy, w, h, visible_shape_fraction) of pixel boxes (P14, S6): unknown
    images, null categories and boxes or images without size fall out, an unknown category goes by its
    number, the visible share is the mask's area in its box."""
    i = images.filter((F.col("width") > 0) & (F.col("height") > 0)).groupBy(F.col("id").alias("image_id")).agg(F.max(F.struct("width", "height")).alias("s"))
    c = categories.groupBy(F.col("id").alias("category_id")).agg(F.max("name").alias("name"))
    x, y, w, h = (F.get("bbox", F.lit(k)) for k in range(4))
    a = annotations.dropDuplicates(["id"]).filter((F.size("bbox") == 4) & x.isNotNull() & y.isNotNull() & (w > 0) & (h > 0) & F.col("category_id").isNotNull()).join(i, "image_id").join(c, "category_id", "left")
    iw, ih = F.col("s.width"), F.col("s.height")
    return a.select(
        F.col("image_id").alias("stem"), F.lpad(F.col("id").cast("string"), 20, "0").alias("ord"), F.coalesce("name", F.col("category_id").cast("string")).alias("label"),
        ((x + w / 2) / iw).alias("cx"), ((y + h / 2) / ih).alias("cy"), (w / iw).alias("w"), (h / ih).alias("h"),
        F.when(F.col("area") > 0, F.least(F.lit(1.0), F.col("area") / F.greatest(F.lit(1e-12), w * h))).alias("visible_shape_fraction"),
    )


def labelme_boxes(shapes: DataFrame) -> DataFrame:
    """The same of LabelMe shapes (json_path, shape_index, label, points, image_w, image_h), S7: blank
    labels, shapes of fewer than two points and images without size fall out."""
    s = shapes.filter((F.trim("label") != "") & (F.size("points") >= 2) & (F.col("image_w") > 0) & (F.col("image_h") > 0))
    b = g.polygon_bbox(F.col("points"))
    w, h = F.greatest(F.lit(1e-6), b["x2"] - b["x1"]), F.greatest(F.lit(1e-6), b["y2"] - b["y1"])
    share = F.when(F.size("points") >= 3, F.least(F.lit(1.0), g.polygon_area(F.col("points")) / F.greatest(F.lit(1e-12), w * h)))
    iw, ih = F.col("image_w"), F.col("image_h")
    return s.select(
        F.col("json_path").alias("stem"), F.lpad(F.col("shape_index").cast("string"), 9, "0").alias("ord"), F.trim("label").alias("label"),
        ((b["x1"] + b["x2"]) / 2 / iw).alias("cx"), ((b["y1"] + b["y2"]) / 2 / ih).alias("cy"), (w / iw).alias("w"), (h / ih).alias("h"), share.alias("visible_shape_fraction"),
    )


def object_counts(images: DataFrame, boxes: DataFrame, key: str = "stem") -> DataFrame:
    """(n_objects, n_images), images without any included."""
    n = boxes.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return images.select(key).distinct().join(n, key, "left").groupBy(F.coalesce("c", F.lit(0)).cast("int").alias("n_objects")).agg(F.count(F.lit(1)).alias("n_images"))


def learn(images: DataFrame, boxes: DataFrame, bins: int = 20, key: str = "stem", source: str = "") -> dict:
    """The profile of a data set (G10) as a document; an error without any image or any object.
    ``boxes`` as ``in_context`` gives them."""
    rows = histograms(boxes, ["label"], bins).collect()
    sizes = {r["label"]: r["n"] for r in class_shares(boxes).collect()}
    counts = {r["n_objects"]: r["n_images"] for r in object_counts(images, boxes, key).collect()}
    total = sum(sizes.values())
    if not counts or not total:
        raise ValueError("no images or no objects to learn from")
    ranges = METRICS | CONTEXT
    classes: dict[str, dict] = {k: {"count": n} | {m: {"bins": bins, "range": [0.0, hi], "counts": [0] * bins} for m, hi in ranges.items()} for k, n in sorted(sizes.items())}
    for r in rows:
        classes[r["label"]][r["metric"]]["counts"][r["bin"]] = r["n"]
    return {
        "schema": "distribution-profile", "version": 1, "source": source, "image_count": sum(counts.values()), "object_count_total": total,
        "object_count": {"counts": {str(k): v for k, v in sorted(counts.items())}}, "classes": classes, "class_probabilities": {k: n / total for k, n in sorted(sizes.items())},
    }


def project(classes: DataFrame, names: list[str]) -> DataFrame:
    """(label, n, p): the classes a class map has, their probabilities summing to 1 again."""
    kept = classes.filter(F.col("label").isin(*names) & (F.col("n") > 0)).select("label", "n")
    return shares(kept.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


def shares(counts: DataFrame, over: list[str], n: str = "n") -> DataFrame:
    """Adds p, each row's share of its group's total."""
    total = F.sum(n).over(Window.partitionBy(*over))
    return counts.withColumn("p", F.when(total > 0, F.col(n) / total).otherwise(0.0))


def total_variation(a: DataFrame, b: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Half the summed difference of two tables of shares (on…, p), per ``by``."""
    x = a.select(*on, F.col("p").alias("pa")).join(b.select(*on, F.col("p").alias("pb")), on, "full_outer")
    d = F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))
    return x.groupBy(*by).agg((F.sum(d) / 2).alias("tv")) if by else x.agg((F.sum(d) / 2).alias("tv"))


def class_shares(boxes: DataFrame) -> DataFrame:
    """(label, n, p); the window runs over one row per class."""
    n = boxes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return shares(n.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


def compare(a: DataFrame, b: DataFrame, bins: int = 20, images: tuple[DataFrame, DataFrame] | None = None, key: str = "stem") -> DataFrame:
    """(metric, distance): the classes' total variation, that of the object counts where the images
    are given, each metric's mean over the classes of both sides, and ``placement``, the mean over all
    of these histograms (G11)."""
    classes = total_variation(class_shares(a), class_shares(b), ["label"], []).select(F.lit("class").alias("metric"), F.col("tv").alias("distance"))
    keys = ["label", "metric"]
    ha, hb = (shares(histograms(x, ["label"], bins), keys) for x in (a, b))
    both = ha.select("label").distinct().join(hb.select("label").distinct(), "label")
    per = total_variation(ha.join(both, "label", "left_semi"), hb.join(both, "label", "left_semi"), [*keys, "bin"], keys)
    out = classes.unionByName(per.groupBy("metric").agg(F.avg("tv").alias("distance"))).unionByName(per.agg(F.avg("tv").alias("distance")).select(F.lit("placement").alias("metric"), "distance"))
    if images:
        na, nb = (shares(object_counts(i, x, key).withColumn("_all", F.lit(1)), ["_all"], "n_images") for i, x in zip(images, (a, b), strict=True))
        out = out.unionByName(total_variation(na, nb, ["n_objects"], []).select(F.lit("object_count").alias("metric"), F.col("tv").alias("distance")))
    return out


def mix(domains: DataFrame, weights: dict[str, float], pseudo_count: int = 100_000) -> DataFrame:
    """Weighted mixture of class shares (domain, label, n) as counts, half-even, at least 1."""
    p = shares(domains, ["domain"]).join(_weights(domains, weights), "domain")
    m = p.groupBy("label").agg(F.sum(F.col("w") * F.col("p")).alias("probability"))
    scale = max(1000, int(pseudo_count))
    return m.filter("probability > 0").select("label", "probability", F.greatest(F.lit(1), F.rint(F.col("probability") * scale).cast("bigint")).cast("bigint").alias("n"))


def _weights(like: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum(max(0.0, w) for w in weights.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    return like.sparkSession.createDataFrame([(k, max(0.0, w) / total) for k, w in weights.items()], "domain string, w double")


def mix_histograms(hists: DataFrame, weights: dict[str, float], pseudo_count: int = 100_000) -> DataFrame:
    """(label, metric, bin, n): the mixture of histograms (domain, label, metric, bin, n), each domain's
    weighted by the share of the class in it, to the class' count in the mixture (G12)."""
    keys = ["domain", "label", "metric"]
    if not hists.groupBy("metric", "domain", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("metric").agg(F.count_distinct("k").alias("k")).filter("k > 1").isEmpty():
        raise ValueError("the histograms' bins are not compatible")
    w = _weights(hists, weights)
    sizes = hists.filter("metric = 'center_x'").groupBy("domain", "label").agg(F.sum("n").alias("n"))
    own = shares(sizes, ["domain"]).join(w, "domain").select("domain", "label", (F.col("w") * F.col("p")).alias("cw"))
    mixed = shares(hists, keys).join(own, ["domain", "label"]).groupBy("label", "metric", "bin").agg(F.sum(F.col("cw") * F.col("p")).alias("acc"))
    total = F.sum("acc").over(Window.partitionBy("label", "metric"))
    count = mix(sizes, weights, pseudo_count).select("label", F.col("n").alias("count"))
    part = mixed.withColumn("s", F.when(total > 0, F.col("acc") / total).otherwise(0.0)).join(count, "label")
    return part.select("label", "metric", "bin", F.rint(F.round(F.col("s") * F.col("count"), 6)).cast("bigint").alias("n"))


def mix_object_counts(counts: DataFrame, weights: dict[str, float], pseudo_count: int = 100_000) -> DataFrame:
    """(n_objects, n_images) of the mixture of (domain, n_objects, n_images)."""
    p = shares(counts, ["domain"], "n_images").join(_weights(counts, weights), "domain")
    m = p.groupBy("n_objects").agg(F.sum(F.col("w") * F.col("p")).alias("q")).filter("q > 0")
    return m.select("n_objects", F.greatest(F.lit(1), F.rint(F.round(F.col("q") * max(1000, int(pseudo_count)), 6)).cast("bigint")).cast("bigint").alias("n_images"))
