"""Geometry and scalar helpers as column expressions (normalised boxes unless said otherwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def box_iou(a: Column, b: Column) -> Column:
    """IoU of two corner structs with a guarded denominator (M1)."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    ih = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = iw * ih
    union = F.greatest(zero, a["x2"] - a["x1"]) * F.greatest(zero, a["y2"] - a["y1"]) + F.greatest(zero, b["x2"] - b["x1"]) * F.greatest(zero, b["y2"] - b["y1"]) - inter
    return inter / F.greatest(F.lit(1e-12), union)


def pixel_box_iou(a: Column, b: Column) -> Column:
    """IoU of integer pixel boxes, 0 when disjoint (M2)."""
    return F.when((F.least(a["x2"], b["x2"]) <= F.greatest(a["x1"], b["x1"])) | (F.least(a["y2"], b["y2"]) <= F.greatest(a["y1"], b["y1"])), 0.0).otherwise(box_iou(a, b))


def raster_box_iou(a: Column, b: Column, raster: int = 256) -> Column:
    """IoU of two boxes drawn with their borders on a square grid (M3 for boxes), in closed form."""

    def grid(v: Column) -> Column:
        return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * (raster - 1))

    def side(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), hi - lo + 1)

    ax1, ay1, ax2, ay2 = (grid(a[c]) for c in ("x1", "y1", "x2", "y2"))
    bx1, by1, bx2, by2 = (grid(b[c]) for c in ("x1", "y1", "x2", "y2"))
    inter = side(F.greatest(ax1, bx1), F.least(ax2, bx2)) * side(F.greatest(ay1, by1), F.least(ay2, by2))
    union = side(ax1, ax2) * side(ay1, ay2) + side(bx1, bx2) * side(by1, by2) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """Corner struct clipped to the canvas."""
    cut = lambda v, hi: F.greatest(F.lit(0), F.least(v, hi))
    return F.struct(*(cut(box[c], width if c[0] == "x" else height).alias(c) for c in ("x1", "y1", "x2", "y2")))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0), box["x2"] - box["x1"]) * F.greatest(F.lit(0), box["y2"] - box["y1"])


def visible_ratio(box: Column, clipped: Column) -> Column:
    return F.when(area(box) > 0, area(clipped) / area(box)).otherwise(0.0)


def is_valid_box(box: Column, width: Column, height: Column, min_visible: float = 0.10, min_size: int = 4) -> Column:
    """Clipped box wide and high enough, and enough of it on the canvas."""
    c = clip_box(box, width, height)
    return (c["x2"] - c["x1"] >= min_size) & (c["y2"] - c["y1"] >= max(2, min_size // 2)) & (visible_ratio(box, c) >= min_visible)


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct<x, y>>; 0 below three points (M4)."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2)


def polygon_bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def polygon_place(points: Column, scale: Column, flip: Column, angle: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    """Scale, flip, rotate with expansion about the box centre, translate (M7)."""
    rad = F.radians(angle)
    w, h = width * scale, height * scale
    new_w = F.abs(w * F.cos(rad)) + F.abs(h * F.sin(rad))
    new_h = F.abs(w * F.sin(rad)) + F.abs(h * F.cos(rad))

    def one(p: Column) -> Column:
        px = F.when(flip, w - p["x"] * scale).otherwise(p["x"] * scale) - w / 2
        py = p["y"] * scale - h / 2
        return F.struct((px * F.cos(rad) + py * F.sin(rad) + new_w / 2 + x).alias("x"), (-px * F.sin(rad) + py * F.cos(rad) + new_h / 2 + y).alias("y"))

    return F.transform(points, one)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, clipped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-8) * (F.sqrt(dot(b, b)) + 1e-8))))


def task_seed(seed: int, index: Column) -> Column:
    """Seed of one planned sample, 32 bits (M17); the factors are fixed values."""
    return (F.lit(seed * 1000003).cast("bigint") + index * 9176 + 99537187).bitwiseAND(F.lit(0xFFFFFFFF))


def perspective_height(y: Column, y_far: float, y_near: float, h_far: float, h_near: float) -> Column:
    """Object height by its ground line between a far and a near one."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - y_far) / max(1e-9, y_near - y_far)))
    return h_far + t * (h_near - h_far)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def clamp_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Fixed-width bin number with both ends clamped; null for a value that is not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    v = F.least(F.lit(hi - 1e-12), F.greatest(F.lit(lo), x))
    return F.when(finite, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - lo) / max(1e-12, hi - lo) * bins).cast("int"))))
