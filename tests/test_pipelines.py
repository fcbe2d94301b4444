"""Data sets through the programmatic entry points and the command line."""

import json
import tarfile

import numpy as np
import pytest

from annolake import cli, pipelines
from annolake.functions import backends
from annolake.functions import pixels as px
from annolake.sources import store


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(3)
    r = f"{tmp_path}/ds one"
    rows = ["generated_stem,background,label,class_id,source_json,shape_index,flipped,box_xyxy,used_paste_zone,run_id"]
    for k in range(10):
        img = rng.integers(0, 255, (40, 50, 3), np.uint8)
        store.write_bytes(f"{r}/images/train/i {k}.png", px.encode_png(img))
        store.write_bytes(f"{r}/labels/train/i {k}.txt", f"{k % 2} 0.5 0.5 0.2 0.2\n".encode() if k else b"")
        rows.append(f"i {k},bg{k % 3}.png,person,0,/x/s{k // 2}.json,{k // 2},False,,,run_1")
    store.write_text(f"{r}/run_1_log.csv", "﻿" + "\n".join(rows) + "\n")
    store.write_text(f"{r}/classes.txt", "0: person\n1: truck\n")
    im = [{"id": k, "file_name": f"i {k}.png", "width": 50, "height": 40} for k in range(10)]
    an = [{"id": 100 + k, "image_id": k, "category_id": 0, "bbox": [1, 2, 10, 8], "area": 40.0, "segmentation": [], "iscrowd": 0} for k in range(10)]
    store.write_json(f"{r}/instances_coco.json", {"images": im, "annotations": an, "categories": [{"id": 0, "name": "person"}]})
    return r


def test_split_merge_shard(spark, root, tmp_path):
    dry = pipelines.split(spark, root, 0.4, apply=False)
    assert dry["total_images"] == 10 and dry["source_groups"] == 5 and dry["val"] == 4 and dry["source_leaks"] == 0 and not store.exists(f"{root}/images/val")
    done = pipelines.split(spark, root, 0.4)
    assert done["files_transferred"] == 8 and len(store.entries(f"{root}/images/val")) == 4 == len(store.entries(f"{root}/labels/val")) and len(store.entries(f"{root}/images/train")) == 6
    coco = store.read_json(f"{root}/annotations/instances_val.json")
    assert len(coco["images"]) == 4 == len(coco["annotations"]) and store.read_json(f"{root}/split_report.json")["val"] == 4 and b"images/val" in store.read_bytes(f"{root}/data.yaml")
    out = f"{tmp_path}/merged"
    m = pipelines.merge(spark, [root, root], out)
    assert m["files"] == 40 and m["coco_images"] == 20 and m["coco_annotations"] == 20 and m["log_rows"] == 20
    assert sorted(i.base_name for i in store.entries(f"{out}/images/val"))[0].startswith("01_ds_one_i ")
    s = pipelines.shard(spark, root, f"{tmp_path}/shards", "train", max_samples=4)
    assert [x["samples"] for x in s["shards"]] == [4, 2] and s["samples"] == 6 and s["primary_label_kind"] == "detect"
    names = tarfile.open(f"{tmp_path}/shards/{s['shards'][0]['file']}").getnames()
    assert len(names) == 16 and sum(n.endswith(".detect.txt") for n in names) == 4 and sum(n.endswith("coco.json") for n in names) == 4


def test_profiles_hard_examples_diversity(spark, root, tmp_path):
    p = pipelines.learn_profile(spark, root)
    assert p["image_count"] == 10 and p["classes"]["person"]["count"] == 10 and p["classes"]["person"]["visible_shape_fraction"]["counts"][10] == 10
    store.write_json(f"{root}/x.json", {})
    for k in range(10):
        store.write_text(f"{tmp_path}/pred/labels/i {k}.txt", f"{k % 2} 0.5 0.5 0.2 0.2 0.9\n" if k < 5 else "")
    r = pipelines.hardmine(spark, root, f"{tmp_path}/pred", f"{tmp_path}/hard", "train")
    assert (r["images"], r["fn"], r["fp"], r["hard_images"]) == (10, 5, 1, 6) and r["hard_negative_count"] == 1 and r["fn_by_class"] == {"0": 2, "1": 3}
    assert store.read_json(f"{tmp_path}/hard/hard_distribution_profile.json")["image_count"] == 5
    d = pipelines.diversity(spark, root, f"{tmp_path}/div", 3)
    assert d["samples"] == 10 and d["n_unique"] == 10 and d["copied"] == 3 and len(store.entries(f"{tmp_path}/div/images/train")) == 3
    assert pipelines.leakage(spark, root)["health"] == "ok"


def test_command_line_without_a_session(tmp_path, capsys):
    t = f"{tmp_path}/t.json"
    store.write_json(t, {"schema": "scene-template", "version": 1, "instances": [{"label": "a"}]})
    assert cli.main(["template", t, f"{tmp_path}/u.json", "--parameterize"]) == 0 and store.read_json(f"{tmp_path}/u.json")["instances"][0]["variation"]["cx_range"] == [0.47, 0.53]
    store.write_json(f"{tmp_path}/p.json", {"schema": "project", "version": 1, "paths": {"objects": "none"}})
    assert cli.main(["project", f"{tmp_path}/p.json"]) == 1 and not json.loads(capsys.readouterr().out)["ok"]
    assert cli.main(["recipe", "object", "mild"]) == 0 and len(cli.parser()._subparsers._group_actions[0].choices) == 15


def test_backends():
    with pytest.raises(px.Unavailable):
        backends.cutout("general")
    with pytest.raises(ValueError):
        backends.cutout("none such")
    backends.register_cutout("all", lambda img: np.ones(img.shape[:2]))
    assert backends.cutout("all")(np.zeros((2, 3, 3))).sum() == 6 and backends.worker_state("appearance-v1") is px.appearance
    disc = np.hypot(*np.mgrid[-9:10, -9:10]) <= 8
    assert backends.plausible_mask(disc) and not backends.plausible_mask(np.ones((9, 9), bool)) and not backends.plausible_mask(np.zeros((9, 9), bool))
