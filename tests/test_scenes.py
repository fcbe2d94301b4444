"""Rendering, assets and whole-dataset reports on drawn pictures."""

import numpy as np
from pyspark.sql import functions as F

from annolake.functions import pixels as px
from annolake.operators import rendering, reports
from annolake.sources import readers, writers


def test_lower_object_is_hidden():
    canvas = np.zeros((80, 100, 3), np.uint8)
    art = np.full((20, 10, 4), 255, np.uint8)
    o = {"label": "x", "center_x": 0.5, "bottom_y": 0.6, "height": 0.25, "allow_overlap": True}
    img, notes, lost = rendering.compose_scene(canvas, [o | {"asset_id": 1}, o | {"asset_id": 1}], {1: art}, 3)
    assert lost == 0 and [n["visible"] for n in notes] == [1.0] and img.max() == 255
    _, notes, _ = rendering.compose_scene(canvas, [o | {"asset_id": 1, "allow_overlap": False}] * 2, {1: art}, 3)
    assert len(notes) == 2 and all(n["visible"] == 1.0 for n in notes)


def test_assets_and_render(spark):
    img = np.zeros((40, 60, 3), np.uint8)
    img[10:30, 20:40] = (10, 200, 30)
    pts = [{"x": x, "y": y} for x, y in ((20.0, 10.0), (39.0, 10.0), (39.0, 29.0), (20.0, 29.0))]
    shapes = spark.createDataFrame([("a.json", 0, "box", pts), ("a.json", 1, "other", pts), ("a.json", 2, "box", pts[:2])], "json_path string, shape_index int, label string, points array<struct<x:double,y:double>>")
    pics = spark.createDataFrame([("a.json", 40, 60, 3, img.tobytes())], "json_path string, height int, width int, nChannels int, data binary")
    a = rendering.extract_assets(shapes, pics, ["box"])
    assert [(r["label"], r["source"], r["height"], r["width"]) for r in a.collect()] == [("box", "a.json#0", 24, 24)]
    o = a.select(F.array(F.struct("asset_id", "label", F.lit(0.5).alias("center_x"), F.lit(0.9).alias("bottom_y"), F.lit(0.5).alias("height"), F.lit(False).alias("flip"), F.lit(False).alias("allow_overlap"), F.col("height").alias("asset_height"), F.col("width").alias("asset_width"), "bgra")).alias("objects"))
    s = o.select(F.lit(1).cast("bigint").alias("idx"), F.lit(5).cast("bigint").alias("seed"), F.lit(40).alias("height"), F.lit(60).alias("width"), F.lit(np.full((40, 60, 3), 90, np.uint8).tobytes()).alias("data"), "objects")
    r = rendering.render(s, {"effects": {"gamma": {"p": 1}}}).first()
    assert r["png"][:4] == b"\x89PNG" and len(r["annotations"]) == 1 and r["n_lost"] == 0
    assert rendering.render(s).first()["png"] == rendering.render(s).first()["png"]
    assert rendering.render(s.withColumn("data", F.lit(None).cast("binary"))).first()["png"] is None


def test_reports(spark, tmp_path):
    rng = np.random.default_rng(1)
    same = rng.integers(0, 255, (48, 64, 3), np.uint8)
    for split, k, img in (("train", 0, same), ("train", 1, rng.integers(0, 255, (48, 64, 3), np.uint8)), ("val", 2, same)):
        (tmp_path / "images" / split).mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / split / f"i{k}.png").write_bytes(px.encode_png(img))
    lines = spark.createDataFrame([("train", "i0", 1, "0 0.5 0.5 0.2 0.2"), ("train", "i1", None, None)], "split string, stem string, line_no int, line string")
    writers.write_label_files(lines, str(tmp_path))
    q = reports.quality(spark, str(tmp_path))
    assert (q["images"], q["objects"], q["missing_labels"], q["empty_labels"], q["duplicates"], q["cross_split_exact"], q["cross_split_embedding"], q["health"]) == (3, 1, 1, 1, 1, 1, 1, "warning")
    assert reports.compare(spark, str(tmp_path), str(tmp_path))["class_distance"] == 0.0
    assert readers.dataset_kind(str(tmp_path)) == "synthetic"
    assert "<table" in writers.report_html("q", q)
