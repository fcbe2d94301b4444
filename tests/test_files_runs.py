"""Files in and out, runs and documents on small folders."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.functions import pixels as px
from annolake.operators import datasets, documents, profile, reports
from annolake.sources import readers, store, writers
from annolake.streaming.run_state import RunMeta, config_hash, latest_resumable, run_id

PNG = px.encode_png(np.full((6, 8, 3), 90, np.uint8))


def put(root, files):
    for name, data in files.items():
        store.write_bytes(f"{root}/{name}", data if isinstance(data, bytes) else data.encode())


def test_listings_and_labels_with_odd_names(spark, tmp_path):
    root = str(tmp_path)
    put(root, {"images/train/a b.png": PNG, "images/train/c+d%20.PNG": PNG, "images/val/e.png": PNG, "images/val/e.txt": "x", "labels/train/a b.txt": "0 .5 .5 .1 .1\n\n1 .5 .5 .1 .1", "labels/train/c+d%20.txt": "2 .5 .5 .1 .1", "labels/val/e.txt": ""})
    assert sorted((r["split"], r["stem"], r["ext"]) for r in readers.list_images(spark, root).collect()) == [("train", "a b", ".png"), ("train", "c+d%20", ".png"), ("val", "e", ".png")]
    got = sorted((r["split"], r["stem"], r["line_no"], r["line"]) for r in readers.read_label_lines(spark, root).collect() if r["line"])
    assert got == [("train", "a b", 1, "0 .5 .5 .1 .1"), ("train", "a b", 3, "1 .5 .5 .1 .1"), ("train", "c+d%20", 1, "2 .5 .5 .1 .1")]
    assert readers.read_label_lines(spark, root).filter("line_no is null").collect()[0]["stem"] == "e" and readers.read_label_lines(spark, root, "labels-seg").count() == 0
    assert readers.list_backgrounds(spark, root).count() == 3 and readers.list_images(spark, f"{root}/none").count() == 0
    assert readers.dataset_kind(root) == "synthetic" and readers.dataset_kind(f"{root}/labels") == "labelme"
    put(root, {"pred/labels/e.txt": "0 .5 .5 .1 .1 .9", "flat/e.txt": "0 .1 .1 .1 .1"})
    assert [readers.read_predictions(spark, f"{root}/{d}").first()["line"][-2:] for d in ("pred", "flat")] == [".9", ".1"]
    p = spark.createDataFrame([(f"file:{root}/objects/car/x.png",), (f"file:{root}/objects/y.png",)], "p string")
    assert [r[0] for r in p.select(readers.label_of_folder(F.col("p"), f"{root}/objects")).collect()] == ["car", "auto"]


def test_pictures_of_labelme_documents(spark, tmp_path):
    root = str(tmp_path)
    doc = lambda **k: json.dumps({"shapes": [], **k})
    put(root, {"in.json": doc(imageData=base64.b64encode(b"inner").decode()), "named.json": doc(imagePath="..\\x\\other one.png"), "other one.png": b"other", "own.json": doc(imagePath="gone.png"), "own.png": b"own", "none.json": doc(), "cfg.json": "{}"})
    got = {r["json_path"].rsplit("/", 1)[-1]: (r["source"], bytes(r["content"]) if r["content"] else None) for r in readers.read_labelme_images(spark, root).collect()}
    assert got == {"in.json": ("embedded", b"inner"), "named.json": ("other one.png", b"other"), "own.json": ("own.png", b"own"), "none.json": (None, None)}


def test_the_newest_log(tmp_path):
    root = str(tmp_path)
    assert readers.latest_log(root) is None
    put(root, {"run_1_log.csv": "a", "run_2_log.csv": "b"})
    assert readers.latest_log(root).endswith("run_2_log.csv")
    put(root, {"generation_log.csv": "c"})
    assert readers.latest_log(root).endswith("/generation_log.csv")
    put(root, {"run_config.json": '{"latest_run_id": "run_1"}'})
    assert readers.latest_log(root).endswith("run_1_log.csv")
    put(root, {"latest_summary.json": '{"log_file": "run_2_log.csv"}', "runs/r9/generation_log.csv": "d"})
    assert readers.latest_log(root).endswith("run_2_log.csv") and readers.latest_log(root, "r9").endswith("r9/generation_log.csv") and readers.latest_log(root, "r8") is None


def test_runs(tmp_path):
    root = str(tmp_path)
    m = RunMeta(root, "run_a")
    first = m.initialize({"b": 1, "a": [1, 2]}, 100)
    assert first["status"] == "running" and first["config_hash"] == config_hash({"a": [1, 2], "b": 1}) and latest_resumable(root) == "run_a"
    m.set(status="interrupted")
    assert m.initialize({"a": [1, 2], "b": 1}, 100)["created_at"] == first["created_at"]
    with pytest.raises(ValueError, match="another configuration"):
        m.initialize({"b": 2}, 100)
    assert [k for k in range(1, 101) if m.live_status(k, 0, 10.0)] == [1, 50, 100] and m.read()["progress"]["per_second"] == 10.0
    RunMeta(root, "run_b").initialize({}, 1)
    RunMeta(root, "run_b").set(status="completed")
    assert latest_resumable(root) == "run_a" and latest_resumable(f"{root}/none") is None and run_id().startswith("run_20")


def test_templates():
    t = {"schema": "scene-template", "version": 1, "instances": [{"label": "a", "source": "/x/y.json#3", "cx_ratio": 0.99, "h_ratio": 0.2}, 5]}
    u = documents.upgraded(t)
    assert u["version"] == 2 and u["instances"][0]["id"] == "slot_001" and u["instances"][0]["source_name"] == "y.json#3" and "id" not in t["instances"][0] and u["parameters"] == documents.EXACT
    p = documents.parameterized(t, scale=0.5, flip=2.0)
    v = p["instances"][0]["variation"]
    assert v["cx_range"] == [0.96, 1.0] and v["h_range"] == [0.1, pytest.approx(0.3)] and v["flip_probability"] == 1.0 and p["parameters"]["scale_jitter"] == 0.5
    assert documents.from_layout(8, 6, [{"label": "b"}])["canvas"] == {"width": 8, "height": 6}
    for bad in ({"version": 3}, {"instances": {}}):
        with pytest.raises(ValueError):
            documents.upgraded(bad)
    assert [documents.normalized_prompt(x) for x in (" A Cat ", "a dog.", "")] == ["a cat.", "a dog.", ""]


def test_configurations_and_projects(tmp_path):
    root = str(tmp_path)
    put(root, {"objects/a.txt": "", "backgrounds/a.txt": "", "profile.json": "{}", "case.json": '{"height_scale": [0.5, 0.6]}'})
    good = {"objects_dir": f"{root}/objects", "backgrounds_dir": f"{root}/backgrounds", "output_dir": f"{root}/out", "class_map": {"a": 0}}
    c = documents.Config(**good, hardcase_recipe="crowded", augmentation_recipe="low-light", object_appearance_recipe="mild").checked()
    assert "workers" not in c.hash_payload() and c.hash_payload()["count"] == 100
    bad = {
        "objects_dir": f"{root}/no", "backgrounds_dir": f"{root}/profile.json", "count": 0, "min_objects": -1, "max_objects": 0, "y_min": 0.95, "far_height": 0.5, "max_iou": 2, "preview_ratio": -1, "background_cache_size": -1,
        "coco_checkpoint_interval": -1, "asset_sampling": "x", "background_sampling": "x", "rectangle_mask_mode": "x", "output_format": "x", "workers": -1, "queue_depth": -1, "profile_strength": 2, "empty_scene_probability": 2,
        "blend_mode": "x", "blend_sigma": -1, "scene_region_mode": "x", "distribution_profile": f"{root}/none", "scene_template": f"{root}/none", "hardcase_recipe": "none such", "object_appearance_recipe": {"effects": {"x": {}}},
    }
    for k, v in bad.items():
        with pytest.raises((ValueError, OSError)):
            documents.Config(**(good | {k: v})).checked()
    p = documents.Project(f"{root}/p.json", "p", {"objects": f"{root}/objects", "backgrounds": "backgrounds", "output": "out", "distribution_profile": "profile.json"}, {"a": 0}, {"workers": 2, "hardcase_recipe": "case.json"})
    doc = p.write()
    assert doc["paths"]["objects"] == "objects" and documents.Project.read(f"{root}/p.json").problems(True) == []
    p.paths |= {"predictions": "none", "scene_template": "objects", "output": "profile.json"}
    p.class_map, p.defaults = {"a": 1}, {"workers": True, "blend_mode": "x", "preview_ratio": "y", "augmentation_recipe": "none"}
    assert len(p.problems()) == 8 and documents.Project(f"{root}/q.json").problems(True) == [f"missing path: {k}" for k in ("objects", "backgrounds", "output")]
    with pytest.raises(ValueError):
        documents.load(f"{root}/profile.json", "project")
    documents.save(f"{root}/d.json", "distribution-profile", {"classes": {}})
    assert documents.load(f"{root}/d.json", "distribution-profile")["version"] == 1


def test_payloads_and_semantic_masks(spark, tmp_path):
    f = spark.createDataFrame([("a", "images", ".PNG", b"i"), ("a", "labels", ".txt", b"l"), ("a", "masks", ".png", b"m"), ("b", "images", ".jpg", b"j"), ("c", "labels", ".txt", b"x")], "stem string, modality string, ext string, data binary")
    im = spark.createDataFrame([(1, "x/a.png", 4, 3), (2, "b.jpg", 4, 3)], "id bigint, file_name string, width int, height int")
    an = spark.createDataFrame([(7, 1, 0, [0.0, 0.0, 1.0, 1.0], 1.0)], "id bigint, image_id bigint, category_id int, bbox array<double>, area double")
    docs = datasets.coco_of_stems(im, an, spark.createDataFrame([(0, "p")], "id int, name string"))
    own = {r["stem"]: json.loads(r["doc"]) for r in docs.collect()}
    assert own["a"]["annotations"][0]["id"] == 7 and own["b"]["annotations"] == []
    rows = {(r["stem"], r["suffix"]): bytes(r["data"]) for r in datasets.sample_payloads(f, docs, "detect", "train").collect()}
    assert set(rows) == {("a", "png"), ("a", "detect.txt"), ("a", "semantic.png"), ("a", "coco.json"), ("a", "json"), ("b", "jpg"), ("b", "coco.json"), ("b", "json")}
    assert json.loads(rows["a", "json"])["modalities"] == ["coco.json", "detect.txt", "semantic.png"] and json.loads(rows["b", "json"])["image_name"] == "b.jpg"
    masks = spark.createDataFrame([("a", 2, 2, 1, bytes([0, 1, 1, 2])), ("b", 2, 2, 1, bytes(4)), ("c", 2, 2, 1, bytes(4)), ("d", -1, -1, 1, None)], "stem string, height int, width int, nChannels int, data binary")
    hints = datasets.object_count_hints(spark.createDataFrame([("b", 0)], "stem string, n_objects int"), spark.createDataFrame([("b", 4), ("c", 2)], "stem string, n_objects int"))
    pixels, one = datasets.semantic_report(datasets.mask_values(masks), hints)
    assert {r["value"]: r["n"] for r in pixels.collect()} == {0: 9, 1: 2, 2: 1} and one.first().asDict() == {"mask_files": 4, "empty": 2, "intentional_empty": 1, "suspicious_empty": 1, "unreadable": 1}
    lines = spark.createDataFrame([("train", "b", 1, "0 0 0 1 0 1 1"), ("train", "a", 2, "0 0"), ("train", "a", 3, "0 0 0 1 0 1 1 0 1"), ("val", "z", None, None)], "split string, stem string, line_no int, line string")
    assert {r["split"]: r["kind"] for r in datasets.primary_kind(lines, ["stem", "line_no"]).collect()} == {"train": "obb", "val": "detect"}
    s = spark.createDataFrame([("j1", " car "), ("j1", "car"), ("j2", ""), ("j2", "car")], "json_path string, label string")
    assert [tuple(r) for r in datasets.labelme_counts(s).collect()] == [("car", 3, 2)]
    assert datasets.compatible_classes([{}, {"a": 0}, {"a": 0}]) == {"a": 0}
    with pytest.raises(ValueError):
        datasets.compatible_classes([{"a": 0}, {"a": 1}])


def test_reports_and_cut_outs(spark, tmp_path):
    root = str(tmp_path)
    rows = [{"stem": "a", "score": 3.0, "gt": 0, "pred": 1, "fn": 0, "fp": 1, "low_conf": 0, "poor_loc": 0, "reasons": ["FP:1"]}, {"stem": "<b>", "score": 1.0, "gt": 1, "pred": 0, "fn": 1, "fp": 0, "low_conf": 0, "poor_loc": 0, "reasons": ["FN:1"]}]
    out = writers.write_hard_examples(root, {"images": 2, "by_class": {"x": 3}}, rows, {"classes": {}})
    assert out["hard_negative_count"] == 1 and store.read_bytes(f"{root}/hard_negative_backgrounds.txt") == b"a\n" and b"&lt;b&gt;" in store.read_bytes(f"{root}/hardmine_dashboard.html")
    assert store.read_bytes(f"{root}/hard_examples.csv").decode("utf-8-sig").splitlines()[1].endswith("FP:1") and store.exists(f"{root}/hard_distribution_profile.json")
    assets = spark.createDataFrame([(5, "car", 2, 3, bytes(24))], "asset_id bigint, label string, height int, width int, bgra binary")
    assert writers.write_cutouts(assets, f"{root}/cut") == 1 and store.read_bytes(f"{root}/cut/car/5.png")[:4] == b"\x89PNG"
    m = np.zeros((8, 9), bool)
    m[2:5, 3:7] = True
    b = writers.write_asset_bundle(root, "obj", np.zeros((8, 9, 3), np.uint8), {"auto": m}, {"label": "car"})
    assert b["bbox"] == (3, 2, 7, 5) and b["pixels"] == 12 and store.read_json(f"{root}/obj/asset.json")["label"] == "car" and store.exists(f"{root}/obj/mask_auto.png")
    assert writers.semantic_png(np.array([[300]]))[24] == 16 and writers.semantic_png(np.array([[3]]))[24] == 8
    p = writers.preview(np.zeros((9, 9, 3), np.uint8), [(2, 2, 7, 7), (20, 20, 30, 30)])
    assert p[2, 4].any() and not p[4, 4].any()
    d = writers.labelme_document([{"points": [(1, 2)]}], "a.png", 3, 4)
    assert d["shapes"][0]["label"] == "object" and d["imageData"] is None and d["imageHeight"] == 3
    writers.write_report(root, "qa", {"n": 1})
    assert reports.drift_warnings({"class": 0.3, "placement": 0.1}, 60, 70) == ["class distribution drift: 0.300"] and reports.drift_warnings({"class": 1.0}, 49, 70) == []
    assert reports.recommendations({"class": 0.2, "placement": None}, 0.5, 0.999) == ["rebalance classes", "close the gap in appearance", "look for leakage"]


def test_profile_documents(spark):
    cols = "stem string, ord string, label string, cx double, cy double, w double, h double"
    b = profile.in_context(spark.createDataFrame([("a", "1", "x", 0.5, 0.5, 0.2, 0.2), ("a", "2", "y", 0.5, 0.5, 0.2, 0.2)], cols))
    im = spark.createDataFrame([("a",), ("b",)], "stem string")
    p = profile.learn(im, b)
    assert p["object_count"]["counts"] == {"0": 1, "2": 1} and p["class_probabilities"] == {"x": 0.5, "y": 0.5} and p["classes"]["x"]["overlap_iou"]["counts"][19] == 1
    with pytest.raises(ValueError):
        profile.learn(im, b.limit(0))
    n = spark.createDataFrame([("s", 0, 3), ("s", 2, 1), ("t", 2, 5)], "domain string, n_objects int, n_images bigint")
    assert {r["n_objects"]: r["n_images"] for r in profile.mix_object_counts(n, {"s": 1, "t": 1}).collect()} == {0: 37500, 2: 62500}
    s = spark.createDataFrame([("j", 0, "car", [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0)], 8, 4), ("j", 1, "", [(0.0, 0.0), (1.0, 1.0)], 8, 4)], "json_path string, shape_index int, label string, points array<struct<x:double,y:double>>, image_w int, image_h int")
    r = profile.labelme_boxes(s).collect()
    assert len(r) == 1 and (r[0]["cx"], r[0]["w"], r[0]["visible_shape_fraction"]) == (0.25, 0.5, 0.5)
