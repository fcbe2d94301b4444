"""Scoring of predictions against ground truth.

Predictions of an image are taken by confidence (then their own order); each claims the unused box
of its class with the best overlap, the first on ties, if the overlap reaches the threshold. Only
pairs whose overlap reaches it are ever rows (``neighbours`` finds them over a grid); they are settled
in rounds: a prediction that is the first of all the boxes it could claim takes the best of them, and
both drop out. An image of any size is spread over tasks; images without either side count.

Defined results: a missing confidence counts as 1; the rows of one image, class and ``ord`` are one
box; predictions that claim nothing count as false from ``fp_conf`` on, below it as nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.functions import pixels as px
from annolake.operators.neighbours import touching
from annolake.session import checkpoint

RASTER = 256


def _boxes(rows: DataFrame, key: str, conf: bool) -> DataFrame:
    """(key, label, s): one struct a box with its order, corners on the raster and confidence."""
    o = -F.coalesce("conf", F.lit(1.0)) if conf else F.lit(0.0)
    grid = lambda v: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * (RASTER - 1))
    ends = {"x1": grid(F.col("cx") - F.col("w") / 2), "y1": grid(F.col("cy") - F.col("h") / 2), "x2": grid(F.col("cx") + F.col("w") / 2) + 1, "y2": grid(F.col("cy") + F.col("h") / 2) + 1}
    more = [F.col("points")] if "points" in rows.columns else []
    r = rows.dropDuplicates([key, "label", "ord"])
    return r.select(F.col(key), F.col("label"), F.struct(F.struct(o.cast("double").alias("c"), F.col("ord").alias("ord")).alias("o"), *((v / RASTER).alias(k) for k, v in ends.items()), *more).alias("s"))


def _raster_iou(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The overlap of polygons drawn with their borders, only for pairs whose boxes touch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[np.array([(p["x"], p["y"]) for p in v or []]) for v in b.column(c).to_pylist()] for c in ("lp", "rp")]
            iou = [px.polygon_iou(x, y, RASTER) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns - 2)), pa.array(iou, pa.float64())], names=[*b.schema.names[:-2], "iou"])

    p = pairs.select(*keys, F.col("l.o").alias("p"), F.col("r.o.ord").alias("g"), F.col("l.points").alias("lp"), F.col("r.points").alias("rp"))
    return p.mapInArrow(rows, p.select(*keys, "p", "g").withColumn("iou", F.lit(0.0)).schema)


def claims(gt: DataFrame, pred: DataFrame, key: str, match_iou: float) -> DataFrame:
    """(key, label, p, g, iou): which prediction claims which box."""
    keys = [key, "label"]
    pairs = touching(_boxes(pred, key, True), _boxes(gt, key, False), keys)
    if "points" in gt.columns and "points" in pred.columns:
        pairs = _raster_iou(pairs, keys)
    else:
        pairs = pairs.select(*keys, F.col("l.o").alias("p"), F.col("r.o.ord").alias("g"), g.box_iou(F.col("l"), F.col("r")).alias("iou"))
    open_ = checkpoint(pairs.filter((F.col("iou") >= match_iou) & (F.col("iou") > 0)))
    out = None
    while not open_.isEmpty():
        first = open_.groupBy(*keys, "g").agg(F.min("p").alias("f"))
        best = F.min(F.struct((-F.col("iou")).alias("o"), "g")).alias("b")
        ready = open_.join(first, [*keys, "g"]).groupBy(*keys, "p").agg(F.min(F.col("p") == F.col("f")).alias("r"), best).filter("r")
        ready = checkpoint(ready.select(*keys, "p", F.col("b.g").alias("g"), (-F.col("b.o")).alias("iou")))
        out = ready if out is None else out.unionByName(ready)
        open_ = checkpoint(open_.join(ready.select(*keys, "p"), [*keys, "p"], "left_anti").join(ready.select(*keys, "g"), [*keys, "g"], "left_anti"))
    return out if out is not None else open_


def matched(images: DataFrame, gt: DataFrame, pred: DataFrame, key: str = "stem", match_iou: float = 0.5, fp_conf: float = 0.25) -> DataFrame:
    """(key, side, label, conf, hit, iou, fp): a row for every image, box and prediction."""
    c = claims(gt, pred, key, match_iou)
    p = pred.dropDuplicates([key, "label", "ord"]).select(key, "label", F.struct((-F.coalesce("conf", F.lit(1.0))).cast("double").alias("c"), F.col("ord").alias("ord")).alias("p"))
    q = gt.dropDuplicates([key, "label", "ord"]).select(key, "label", F.col("ord").alias("g"))
    conf = -F.col("p.c")
    preds = p.join(c, [key, "label", "p"], "left").select(key, F.lit("pred").alias("side"), "label", conf.alias("conf"), F.col("g").isNotNull().alias("hit"), "iou", (F.col("g").isNull() & (conf >= fp_conf)).alias("fp"))
    boxes = q.join(c.select(key, "label", "g", "iou"), [key, "label", "g"], "left").select(key, F.lit("gt").alias("side"), "label", F.lit(1.0).alias("conf"), F.col("iou").isNotNull().alias("hit"), "iou", F.lit(False).alias("fp"))
    own = images.select(key).distinct()
    some = preds.unionByName(boxes).join(own, key, "left_semi")
    return some.unionByName(own.select(key, F.lit("image").alias("side")), allowMissingColumns=True)


def scores(m: DataFrame, key: str = "stem", hard_conf: float = 0.5, localization_iou: float = 0.75) -> DataFrame:
    """Counts and the hardness score of every image (G13), with its reasons."""
    n = lambda c: F.count_if(c).cast("int")
    gt, pred = F.col("side") == "gt", F.col("side") == "pred"
    true = pred & F.col("hit")
    poor = true & (F.col("iou") < localization_iou)
    d = m.groupBy(key).agg(
        n(gt).alias("gt"), n(pred).alias("pred"), n(gt & ~F.col("hit")).alias("fn"), n(pred & F.col("fp")).alias("fp"), n(true & (F.col("conf") < hard_conf)).alias("low_conf"), n(poor).alias("poor_loc"),
        F.coalesce(F.sum(F.when(poor, (localization_iou - F.col("iou")) / max(1e-6, localization_iou))), F.lit(0.0)).alias("_pen"),
        F.avg(F.when(true, F.col("iou"))).alias("mean_iou"), F.avg(F.when(true, F.col("conf"))).alias("mean_conf"),
    )
    score = 3.0 * F.col("fn") + 2.0 * F.col("fp") + F.col("low_conf") + 1.5 * F.col("_pen") + F.when(F.col("gt") == 0, F.col("fp")).otherwise(0)
    why = [("FN", "fn"), ("FP", "fp"), ("low-conf", "low_conf"), ("geometry", "poor_loc")]
    reasons = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))) for n, c in why)))
    return d.withColumn("score", score).withColumn("reasons", reasons).drop("_pen")


def hardest(scored: DataFrame, top: int, key: str = "stem") -> DataFrame:
    """The top images with a positive score, by score then key (O1)."""
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(max(0, top))


def errors_by_class(m: DataFrame) -> DataFrame:
    """(label, fn, fp) over all images (G14), classes without errors left out."""
    fn, fp = (F.col("side") == "gt") & ~F.col("hit"), (F.col("side") == "pred") & F.col("fp")
    return m.filter(fn | fp).groupBy("label").agg(F.count_if(fn).alias("fn"), F.count_if(fp).alias("fp"))


def hard_negatives(scored: DataFrame, key: str = "stem") -> DataFrame:
    """Images without any box in which something was seen."""
    return scored.filter((F.col("gt") == 0) & (F.col("fp") > 0)).select(key)


def prediction_shapes(lines: DataFrame, task: str, line: str = "line", prediction: bool = True) -> DataFrame:
    """Adds class_id, vals and conf to label lines of one task, ``detect``, ``obb`` or ``seg`` (S15):
    predictions may carry a confidence as last number, which is told from a polygon by the odd number
    of values; lines that do not parse or are too short fall out."""
    if task not in ("detect", "obb", "seg"):
        raise ValueError("the task must be detect, obb or seg")
    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+", " ")), " ")
    d = lines.withColumn("_n", F.transform(tokens, lambda x: x.try_cast("double"))).filter(~F.exists("_n", lambda x: x.isNull() | F.isnan(x)))
    vals, n = F.slice("_n", 2, F.greatest(F.size("_n") - 1, F.lit(0))), F.size("_n") - 1
    fixed = {"detect": 4, "obb": 8}.get(task)
    if fixed:
        conf = F.when(F.lit(prediction) & (n > fixed), F.get("_n", F.lit(fixed + 1))).otherwise(1.0)
        d = d.filter(n >= fixed).withColumn("vals", F.slice("_n", 2, fixed))
    else:
        has = F.lit(prediction) & (n >= 7) & (n % 2 == 1)
        conf = F.when(has, F.try_element_at("_n", F.lit(-1))).otherwise(1.0)
        d = d.withColumn("vals", F.when(has, F.slice(vals, 1, F.greatest(n - 1, F.lit(0)))).otherwise(vals)).filter((F.size("vals") >= 6) & (F.size("vals") % 2 == 0))
    return d.withColumn("conf", conf).withColumn("class_id", F.get("_n", F.lit(0)).cast("int")).drop("_n")


def shape_boxes(shapes: DataFrame, task: str) -> DataFrame:
    """Shapes as boxes (cx, cy, w, h), with their polygon in ``points`` for obb and seg."""
    if task == "detect":
        return shapes.withColumns({c: F.get("vals", F.lit(i)) for i, c in enumerate(("cx", "cy", "w", "h"))})
    pts = F.transform(F.sequence(F.lit(0), F.size("vals") - 2, F.lit(2)), lambda i: F.struct(F.get("vals", i).alias("x"), F.get("vals", i + 1).alias("y")))
    d = shapes.withColumn("points", pts)
    b = g.polygon_bbox(F.col("points"))
    return d.withColumns({"cx": (b["x1"] + b["x2"]) / 2, "cy": (b["y1"] + b["y2"]) / 2, "w": b["x2"] - b["x1"], "h": b["y2"] - b["y1"]})
