"""Scene rendering and object assets (S9, R5, R13, J20, I3-I6, K8), as Arrow functions per sample.

``render`` takes one planned sample at a time: its objects are pasted in order, each moved a few
times until it overlaps the earlier ones little enough and enough of it lies on the canvas; masks
are then cut by what later objects cover. A sample's pixels depend on its own seed only.

Defined results: an object that finds no place is left out and counted; a background that cannot be
read gives a row with a null image; polygons of fewer than three points give no asset.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions import masks as mk
from annolake.functions import pixels as px
from annolake.functions import recipes as rc

ASSET = "asset_id bigint, label string, source string, height int, width int, bgra binary"


def cut_asset(img: np.ndarray, points: np.ndarray, pad: int = 2, feather: int = 1) -> np.ndarray | None:
    """The BGRA crop of a polygon with a soft border."""
    mask = px.rasterize(points, *img.shape[:2])
    box = px.mask_bbox(mask)
    if box is None:
        return None
    x1, y1, x2, y2 = max(0, box[0] - pad), max(0, box[1] - pad), min(img.shape[1], box[2] + pad), min(img.shape[0], box[3] + pad)
    alpha = mask[y1:y2, x1:x2].astype(float)
    for _ in range(feather):
        p = np.pad(alpha, 1, mode="edge")
        alpha = sum(p[i : i + alpha.shape[0], j : j + alpha.shape[1]] for i in range(3) for j in range(3)) / 9
    return np.dstack([img[y1:y2, x1:x2, :3], np.rint(alpha * 255)]).astype(np.uint8)


def extract_assets(shapes: DataFrame, images: DataFrame, classes: list[str]) -> DataFrame:
    """Assets of the wanted classes from shapes (json_path, shape_index, label, points) and decoded
    images (json_path, height, width, nChannels, data). The class filter runs before any pixel."""
    s = shapes.filter(F.col("label").isin(*classes) & (F.size("points") >= 3)).join(images, "json_path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                img = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                cut = cut_asset(np.repeat(img, 3, 2) if r["nChannels"] == 1 else img, np.array([[p["x"], p["y"]] for p in r["points"]]))
                if cut is not None:
                    out.append({"asset_id": r["asset_id"], "label": r["label"], "source": f"{r['json_path'].rsplit('/', 1)[-1]}#{r['shape_index']}", "height": cut.shape[0], "width": cut.shape[1], "bgra": cut.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("asset_id", pa.int64()), ("label", pa.string()), ("source", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("bgra", pa.binary())]))

    keyed = s.select(F.xxhash64("json_path", "shape_index").alias("asset_id"), "json_path", "shape_index", "label", "points", "height", "width", "nChannels", "data")
    return keyed.mapInArrow(rows, ASSET)


def _iou(a: tuple, b: tuple) -> float:
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def scaled(asset: np.ndarray, height: int, flip: bool) -> np.ndarray:
    out = px.resize(asset, max(1, round(asset.shape[1] * height / asset.shape[0])), max(1, height))
    return np.rint(out[:, ::-1] if flip else out).astype(np.uint8)


def compose_scene(
    canvas: np.ndarray, objects: list[dict], assets: dict[int, np.ndarray], seed: int, max_iou: float = 0.2, tries: int = 40, min_visible: float = 0.1, recipe: dict | None = None,
    object_recipe: dict | str | None = "off", colour_match: float = 0.0, blend_mode: str = "alpha", region: np.ndarray | None = None, shadow: bool = False,
):
    """(image, annotations, left out): annotations with box, visible mask's area, polygon box and
    visibility. Objects take their recipe and may be turned (``angle``); where a region is given, they
    stand in it or not at all (R13)."""
    rng, out, placed, masks, lost = random.Random(seed), canvas, [], [], 0
    height, width = canvas.shape[:2]
    for o in objects:
        art = scaled(assets[o["asset_id"]], max(2, round(o["height"] * height)), bool(o.get("flip")))
        if o.get("angle"):
            art = mk.rotate(art, o["angle"])
        h, w = art.shape[:2]
        for attempt in range(tries):
            jitter = 0.0 if attempt == 0 else 0.03 * attempt
            x = round((o["center_x"] + rng.uniform(-jitter, jitter)) * width - w / 2)
            y = round((o["bottom_y"] + rng.uniform(-jitter, jitter)) * height - h)
            box = (max(0, x), max(0, y), min(width, x + w), min(height, y + h))
            seen = max(0, box[2] - box[0]) * max(0, box[3] - box[1]) / (w * h)
            foot = (min(height - 1, max(0, y + h - 1)), min(width - 1, max(0, x + w // 2)))
            if region is not None and not region[foot]:
                continue
            if box[2] - box[0] >= 4 and box[3] - box[1] >= 2 and seen >= min_visible and (o.get("allow_overlap") or all(_iou(box, p["box"]) <= max_iou for p in placed)):
                break
        else:
            lost += 1
            continue
        alpha, colours = art[..., 3] / 255.0, art[..., :3]
        if object_recipe != "off" or colour_match > 0:
            behind = np.zeros_like(colours)
            behind[box[1] - y : box[3] - y, box[0] - x : box[2] - x] = out[box[1] : box[3], box[0] : box[2]]
            colours, _ = rc.prepared_foreground(colours, alpha, behind, rng.getrandbits(32), object_recipe, o["label"], colour_match)
        if shadow:
            out = mk.foot_shadow(out, x + w // 2, y + h, w)
        out = mk.blend_patch(out, colours, alpha, x, y, blend_mode)
        mask = np.zeros((height, width), bool)
        mask[box[1] : box[3], box[0] : box[2]] = alpha[box[1] - y : box[3] - y, box[0] - x : box[2] - x] >= 0.5
        placed.append({"label": o["label"], "box": box, "full": int(mask.sum())})
        masks.append(mask)
    notes = []
    for p, m in zip(placed, px.visible_masks(masks), strict=True):
        b = px.mask_bbox(m)
        if b is not None:
            notes.append({"label": p["label"], "x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "area": int(m.sum()), "visible": m.sum() / max(1, p["full"])})
    if recipe:
        out, _ = px.apply_recipe(out, recipe, seed)
    return out, notes, lost


def render(samples: DataFrame, recipe: dict | None = None) -> DataFrame:
    """(idx, png, annotations, n_lost) from samples (idx, seed, height, width, data, objects
    array<struct<asset_id,label,center_x,bottom_y,height,flip,allow_overlap,asset_height,asset_width,bgra>>)."""
    schema = "idx bigint, png binary, annotations array<struct<label:string,x1:int,y1:int,x2:int,y2:int,area:bigint,visible:double>>, n_lost int"
    note = pa.struct([("label", pa.string()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2")), ("area", pa.int64()), ("visible", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():  # one picture at a time in memory
                row = {"idx": r["idx"], "png": None, "annotations": [], "n_lost": 0}
                if r["data"]:
                    canvas = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], -1)[..., :3]
                    art = {o["asset_id"]: np.frombuffer(o["bgra"], np.uint8).reshape(o["asset_height"], o["asset_width"], 4) for o in r["objects"] or []}
                    img, notes, lost = compose_scene(canvas, r["objects"] or [], art, r["seed"], recipe=recipe)
                    row |= {"png": px.encode_png(img, 1), "annotations": notes, "n_lost": lost}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("idx", pa.int64()), ("png", pa.binary()), ("annotations", pa.list_(note)), ("n_lost", pa.int32())]))

    return samples.mapInArrow(rows, schema)


def synthetic_samples(rows: DataFrame, idx: str, width: int = 800, height: int = 600) -> DataFrame:
    """Samples for ``render`` made from numbers alone: a shaded background, one to three objects of a
    drawn shape. For trials and timing."""
    schema = (
        "idx bigint, seed bigint, height int, width int, data binary, objects array<struct<asset_id:bigint,label:string,center_x:double,bottom_y:double,height:double,flip:boolean,"
        "allow_overlap:boolean,asset_height:int,asset_width:int,bgra:binary>>"
    )
    obj = pa.struct([("asset_id", pa.int64()), ("label", pa.string()), ("center_x", pa.float64()), ("bottom_y", pa.float64()), ("height", pa.float64()), ("flip", pa.bool_()), ("allow_overlap", pa.bool_()), ("asset_height", pa.int32()), ("asset_width", pa.int32()), ("bgra", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:96, :64]
        shape = ((x - 32) / 30) ** 2 + ((y - 48) / 46) ** 2 <= 1
        for b in batches:
            for i in b.column(0).to_pylist():
                rng = random.Random(i)
                shade = np.linspace(rng.randrange(40, 120), rng.randrange(120, 250), height)[:, None, None]
                canvas = np.broadcast_to(shade + np.arange(3) * 4, (height, width, 3)).astype(np.uint8)
                objects = []
                for k in range(rng.randint(1, 3)):
                    art = np.dstack([np.full((96, 64, 3), rng.randrange(255)), shape * 255]).astype(np.uint8)
                    objects.append({"asset_id": k, "label": "abc"[rng.randrange(3)], "center_x": rng.uniform(0.1, 0.9), "bottom_y": rng.uniform(0.5, 0.95), "height": rng.uniform(0.1, 0.35), "flip": rng.random() < 0.5, "allow_overlap": False, "asset_height": 96, "asset_width": 64, "bgra": art.tobytes()})
                row = {"idx": i, "seed": i, "height": height, "width": width, "data": canvas.tobytes(), "objects": objects}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("idx", pa.int64()), ("seed", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("objects", pa.list_(obj))]))

    return rows.select(F.col(idx).cast("bigint").alias("idx")).mapInArrow(make, schema)
