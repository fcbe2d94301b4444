"""Operators of the annotation catalogue against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.functions import pixels as px
from annolake.operators import compose, graph, hard_examples, labels, lineage, planning, ranking, similarity
from annolake.sources import readers, writers
from annolake.streaming.run_state import RunState


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    root = {v: v for v in [*range(200), *range(300, 341)]}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    v = spark.createDataFrame([(x,) for x in root], "v bigint")
    got = {r["v"]: r["root"] for r in graph.components(v, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == root
    assert graph.components(v.limit(0), spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_split_assignment_equals_greedy(spark):
    import hashlib

    rng = random.Random(3)
    sizes = {i: rng.choice([1, 1, 2, 3, 8]) for i in range(60)}
    order = sorted(sizes, key=lambda k: (sizes[k], hashlib.sha256(f"42:{k}".encode()).hexdigest()[:16]))
    target, now, val = round(sum(sizes.values()) * 0.2), 0, set()
    for k in order:
        if now < target and abs(now + sizes[k] - target) <= abs(now - target):
            val.add(k)
            now += sizes[k]
    rows = spark.createDataFrame([(k * 100 + i, k) for k, n in sizes.items() for i in range(n)], "stem bigint, gid bigint")
    assert {r["gid"] for r in lineage.assign_split(rows, 0.2).filter("split = 'val'").collect()} == val


def test_running_positions(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(rng.choice("ab"), x) for x in rng.sample(range(10_000), 300)], "k string, x bigint")
    r = ranking.running(d, [F.col("x")], [F.floor(F.col("x") / 700)], keys=["k"]).collect()
    for k in "ab":
        own = sorted((x["x"], x["before"]) for x in r if x["k"] == k)
        assert [b for _, b in own] == list(range(len(own)))


def test_running_broadcasts_no_rows(spark):
    import hashlib

    d = spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("x")).withColumn("v", F.when(F.col("x") >= 100, F.col("x")))
    for late in (False, True):
        r = ranking.running(d, [F.sha2(F.col("x").cast("string"), 256)], [F.substring(F.sha2(F.col("x").cast("string"), 256), 1, 1)], value=F.col("v"), keys=["id"], late=late)
        assert "BuildLeft" not in r._jdf.queryExecution().executedPlan().toString()
        rows, total = r.collect(), 0
        at = {(x["id"], x["x"]): x["before"] for x in rows}
        assert len(at) == len(rows) == 900
        for x in sorted(range(300), key=lambda x: hashlib.sha256(str(x).encode()).hexdigest()):
            assert {at[k, x] for k in range(3)} == {total}
            total += x if x >= 100 else 0


def test_background_cycle(spark):
    import hashlib

    samples = spark.range(2000).select((F.col("id") * 3).alias("s"), F.col("id").alias("idx"))
    backgrounds = spark.range(40).select(F.when(F.col("id") < 37, F.pmod("id", F.lit(30))).alias("b"))  # seven twice, a null
    r = planning.background_cycle(samples, backgrounds, "b", 7)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "_rcycle" in x and "BuildLeft" in x]
    order = [sorted(range(30), key=lambda b: hashlib.sha256(f"7:{c}:{b}".encode()).hexdigest()) for c in range(67)]
    assert sorted((x["s"], x["cycle"], x["slot"], x["b"]) for x in r.collect()) == [(3 * i, i // 30, i % 30, order[i // 30][i % 30]) for i in range(2000)]
    assert not planning.background_cycle(samples.limit(0), backgrounds, "b", 7).collect() and not planning.background_cycle(samples, backgrounds.limit(0), "b", 7).collect()


def test_label_lines_and_boxes(spark):
    lines = ["0 0.5 0.5 0.2 0.2", "1.9 0.1 0.1 0.1 0.1", "0 0.5 0.5 0 0.2", "0 0 0 1 0 1 1 0 1", "0 0 0 1 0 1 1", "0 0.1", "a b c d e", "0 nan 0.5 0.1 0.1", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    p = {r["line_no"]: r for r in labels.with_tokens(d).collect()}
    assert [(p[i]["kind"], p[i]["is_valid"]) for i in range(6)] == [("detect", True), ("detect", True), ("detect", False), ("obb", True), ("seg", True), ("unknown", False)]
    assert p[1]["class_id"] == 1 and not p[6]["is_object"] and not p[7]["is_object"] and 8 not in p
    box = F.struct(F.lit(-5).alias("x1"), F.lit(0).alias("y1"), F.lit(5).alias("x2"), F.lit(10).alias("y2"))
    r = spark.range(1).select(g.is_valid_box(box, F.lit(100), F.lit(100)).alias("a"), g.visible_ratio(box, g.clip_box(box, F.lit(100), F.lit(100))).alias("v"), g.is_valid_box(box, F.lit(3), F.lit(100)).alias("b")).first()
    assert (r["a"], r["v"], r["b"]) == (True, 0.5, False)
    tri = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))))
    assert spark.range(1).select(g.polygon_area(tri)).first()[0] == 0.5


def test_hard_examples_known_cases(spark):
    im = spark.createDataFrame([("a", ), ("b", ), ("c", )], "stem string")
    cols = "stem string, ord string, label string, cx double, cy double, w double, h double, conf double"
    gt = spark.createDataFrame([("a", "1", "x", 0.5, 0.5, 0.2, 0.2, 1.0), ("b", "1", "x", 0.3, 0.3, 0.2, 0.2, 1.0)], cols)
    pr = spark.createDataFrame([("a", "1", "x", 0.5, 0.5, 0.2, 0.2, 0.9), ("b", "1", "x", 0.8, 0.8, 0.1, 0.1, 0.91), ("c", "1", "y", 0.8, 0.8, 0.1, 0.1, 0.3)], cols)
    s = {r["stem"]: r for r in hard_examples.scores(hard_examples.matched(im, gt, pr)).collect()}
    assert (s["a"]["score"], s["b"]["fn"], s["b"]["fp"], s["b"]["score"], s["c"]["score"]) == (0.0, 1, 1, 5.0, 3.0)
    assert s["b"]["reasons"] == ["FN:1", "FP:1"]


def test_nearest_over_blocks_and_hashes(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, vec array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    got = {r["id"]: r["best_id"] for r in similarity.nearest(v, v, exclude_self=True).collect()}
    assert got == {i: int(s[i].argmax()) for i in range(90)}
    one = similarity.uniqueness(v.limit(1)).first()
    assert one["samples"] == 1 and one["mean_uniqueness"] == 1.0 and similarity.uniqueness(v.limit(0)).first()["mean_uniqueness"] is None
    hs = [int(x) for x in rng.integers(-(2**62), 2**62, 20)]
    hs += [h ^ 0b1011 for h in hs[:10]] + hs[:3]
    d = spark.createDataFrame(list(enumerate(hs)), "pos bigint, phash bigint")
    want = {}
    for i, h in enumerate(hs):
        c = min(((((h ^ x) & (2**64 - 1)).bit_count(), j) for j, x in enumerate(hs[:i])), default=(99, 0))
        if c[0] <= 6:
            want[i] = (c[1], c[0])
    assert {r["pos"]: (r["owner"], r["distance"]) for r in similarity.near_hashes(d, 6).collect()} == want


def test_nearest_over_cells_reaches_the_recall(spark):
    """Many cells, some of them cut into blocks: rows whose id is divisible by 20 against all rows."""
    rng = np.random.default_rng(14)
    hot = np.repeat(rng.normal(size=(1, 16)), 1500, 0) + 0.3 * rng.normal(size=(1500, 16))
    m = np.vstack((hot, np.repeat(rng.normal(size=(60, 16)), 50, 0) + 0.5 * rng.normal(size=(3000, 16))))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, vec array<double>")
    q = v.filter("id % 20 = 0")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n[::20] @ n.T
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -2
    got = {r["id"]: r["best_id"] for r in similarity.nearest(q, v, cell_rows=128, exclude_self=True).collect()}
    hit = [got[20 * k] == int(s[k].argmax()) for k in range(len(s))]
    assert len(got) == len(s) and np.mean(hit) >= 0.9


def test_hash_pairs_lose_none(spark):
    rng = random.Random(15)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 255]
    hs = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(6)} | set(base)
    signed = [h - 2**64 if h >> 63 else h for h in hs]
    got = [tuple(r) for r in similarity.hash_pairs(spark.createDataFrame([(h,) for h in signed], "h bigint"), 7).collect()]
    d = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert len(got) == len(set(got)) and set(got) == {(a, b, d(a, b)) for a in signed for b in signed if a != b and d(a, b) <= 7}


def test_cross_split_near_leaves_exact_copies_out(spark):
    order = {"train": 0, "val": 1, "test": 2}
    rows = [(1, 5, "train", "a"), (2, 5, "val", "a"), (3, 7, "val", "b"), (4, 5, "test", "a"), (5, 5, "train", "c"), (6, None, "test", "d"), (7, 5, None, "e"), (8, 4, "train", None)]
    got = {r["pos"]: (r["owner"], r["owner_split"], r["distance"]) for r in similarity.cross_split_near(spark.createDataFrame(rows, "pos bigint, phash bigint, split string, digest string"), order).collect()}
    assert got == {2: (5, "train", 0), 3: (1, "train", 1), 4: (5, "train", 0)}


def test_crowding_over_a_grid(spark):
    from annolake.operators import neighbours, profile

    rng = random.Random(6)
    rows = [(k % 3, f"{k:05d}", "x", 1.4 * rng.random() - 0.2, rng.random(), 0.1 * rng.random(), 0.1 * rng.random()) for k in range(400)] + [(9, "0", "y", 0.5, 0.5, 0.1, 0.1)]
    b = spark.createDataFrame(rows, "stem bigint, ord string, label string, cx double, cy double, w double, h double")

    def iou(a, c):
        w = min(a[3] + a[5] / 2, c[3] + c[5] / 2) - max(a[3] - a[5] / 2, c[3] - c[5] / 2)
        h = min(a[4] + a[6] / 2, c[4] + c[6] / 2) - max(a[4] - a[6] / 2, c[4] - c[6] / 2)
        i = max(0, w) * max(0, h)
        return i / max(1e-12, a[5] * a[6] + c[5] * c[6] - i)

    want = {(r[0], r[1]): round(max((iou(r, c) for c in rows if c[0] == r[0] and c[1] != r[1]), default=0.0), 9) for r in rows}
    assert neighbours.CROWDED < 130
    assert {(r["stem"], r["ord"]): round(r["max_iou"], 9) for r in profile.crowding(b).collect()} == want and max(want.values()) > 0.1
    assert profile.crowding(b.limit(0)).count() == 0


def test_matching_equals_the_greedy_order(spark):
    """Against the loop over predictions, in a crowded image and in small ones."""
    rng = random.Random(16)
    cols = "stem bigint, ord string, label string, cx double, cy double, w double, h double, conf double"
    box = lambda k, s: (s, f"{k:05d}", rng.choice("xy"), rng.random(), rng.random(), 0.03 + 0.05 * rng.random(), 0.03 + 0.05 * rng.random(), round(rng.random(), 1))
    gt = [box(k, 0 if k < 300 else k % 20) for k in range(400)]
    near = lambda b, k: (b[0], f"{k:05d}", b[2], *(v + rng.gauss(0, 0.01) for v in b[3:5]), *b[5:7], round(rng.random(), 1))
    pred = [near(rng.choice(gt), k) for k in range(500)]

    def grid(b):
        return [round(min(1, max(0, v)) * 255) for v in (b[3] - b[5] / 2, b[4] - b[6] / 2, b[3] + b[5] / 2, b[4] + b[6] / 2)]

    def iou(a, c):
        (ax, ay, au, av), (bx, by, bu, bv) = grid(a), grid(c)
        i = max(0, min(au, bu) - max(ax, bx) + 1) * max(0, min(av, bv) - max(ay, by) + 1)
        return i / ((au - ax + 1) * (av - ay + 1) + (bu - bx + 1) * (bv - by + 1) - i)

    want, used = set(), set()
    for p in sorted(pred, key=lambda p: (-p[7], p[1])):
        c = [(-iou(p, q), q[1]) for q in gt if q[0] == p[0] and q[2] == p[2] and (q[0], q[1]) not in used]
        if c and -min(c)[0] >= 0.3:
            used.add((p[0], min(c)[1]))
            want.add((p[0], p[1], min(c)[1]))
    g_, p_ = spark.createDataFrame(gt, cols), spark.createDataFrame(pred, cols)
    got = {(r["stem"], r["p"]["ord"], r["g"]) for r in hard_examples.claims(g_, p_, "stem", 0.3).collect()}
    assert got == want and len(want) > 200
    m = hard_examples.matched(spark.range(25).withColumnRenamed("id", "stem"), g_, p_, match_iou=0.3)
    assert hard_examples.scores(m).count() == 25 and hard_examples.scores(m).agg(F.sum("gt")).first()[0] == 400
    assert hard_examples.claims(g_.limit(0), p_, "stem", 0.3).count() == 0 == hard_examples.errors_by_class(hard_examples.matched(spark.range(0).withColumnRenamed("id", "stem"), g_, p_)).count()


def test_predictions_of_every_task(spark):
    text = {"detect": ["1 .5 .5 .2 .2 .9", "1 .5 .5 .2 .2", "1 .5", "x 1 1 1 1"], "obb": ["0 0 0 1 0 1 1 0 1 .4", "0 0 0 1 0"], "seg": ["2 0 0 1 0 1 1 .7", "2 0 0 1 0 1 1", "2 0 0 1 0"]}
    for task, lines in text.items():
        d = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)], "stem string, line_no int, line string")
        r = hard_examples.shape_boxes(hard_examples.prediction_shapes(d, task), task).orderBy("line_no").collect()
        assert [x["conf"] for x in r] == {"detect": [0.9, 1.0], "obb": [0.4], "seg": [0.7, 1.0]}[task]
        assert task == "detect" or len(r[0]["points"]) == {"obb": 4, "seg": 3}[task]
    tri = lambda *p: [(float(x), float(y)) for x, y in p]
    cols = "stem string, ord string, label string, cx double, cy double, w double, h double, conf double, points array<struct<x:double,y:double>>"
    a = spark.createDataFrame([("s", "1", "k", 0.5, 0.5, 1.0, 1.0, 1.0, tri((0, 0), (1, 0), (0, 1)))], cols)
    b = spark.createDataFrame([("s", "1", "k", 0.5, 0.5, 1.0, 1.0, 0.9, tri((1, 1), (1, 0), (0, 1))), ("s", "2", "k", 0.5, 0.5, 1.0, 1.0, 0.8, tri((0, 0), (1, 0), (0, 1)))], cols)
    assert [(r["p"]["ord"], r["iou"]) for r in hard_examples.claims(a, b, "stem", 0.5).collect()] == [("2", 1.0)]



def test_files_round_trip(spark, tmp_path):
    root = str(tmp_path)
    for s in ("train", "val"):
        (tmp_path / "images" / s).mkdir(parents=True)
        for k in range(3):
            img = np.full((40, 60, 3), 40 * k, np.uint8)
            img[5:20, 5 : 20 + k] = 255
            (tmp_path / "images" / s / f"{s}{k}.png").write_bytes(px.encode_png(img))
    lines = spark.createDataFrame([("train", "train0", 1, "0 0.5 0.5 0.2 0.2"), ("train", "train0", 2, "1 0.1 0.1 0.1 0.1"), ("train", "train1", None, None)], "split string, stem string, line_no int, line string")
    writers.write_label_files(lines, root)
    images = readers.list_images(spark, root)
    assert images.count() == 6
    read = readers.read_label_lines(spark, root)
    assert sorted((r["stem"], r["line"]) for r in read.collect() if r["line"]) == [("train0", "0 0.5 0.5 0.2 0.2"), ("train0", "1 0.1 0.1 0.1 0.1")]
    assert {r["stem"] for r in labels.missing_labels(images, read).collect()} == {"train2", "val0", "val1", "val2"}  # the empty file is there
    f = {r["path"].rsplit("/", 1)[-1]: r for r in px.image_features(readers.read_images(spark, root + "/images")).collect()}
    assert f["train1.png"]["phash"] == f["val1.png"]["phash"] and len(f["train1.png"]["vec"]) == 167 and f["train0.png"]["width"] == 60
    writers.write_classes(root, {0: "person", 1: "truck"})
    assert readers.read_classes(spark, f"{root}/classes.txt") == {0: "person", 1: "truck"}
    im = spark.createDataFrame([(1, "a.jpg", 4, 3)], "id bigint, file_name string, width int, height int")
    an = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 1.0, 1.0], 1.0)], "id bigint, image_id bigint, category_id int, bbox array<double>, area double")
    writers.write_coco(f"{root}/c.json", im, an, spark.createDataFrame([(0, "p")], "id int, name string"))
    assert [x.count() for x in readers.read_coco(spark, f"{root}/c.json")] == [1, 1, 1]
    (tmp_path / "lm").mkdir()
    (tmp_path / "lm" / "a.json").write_text(json.dumps({"version": "1", "imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "zone:person", "shape_type": "polygon", "points": [[0, 0], [1, 0], [1, 1]]}]}))
    (tmp_path / "lm" / "b.json").write_text("{}")
    s = readers.read_labelme(spark, f"{root}/lm").withColumn("z", readers.zone_class(F.col("label")))
    assert [r["z"] for r in s.collect()] == ["person"]


def test_shards_are_deterministic(spark, tmp_path):
    s = spark.createDataFrame([(0, f"s{i}", "txt", b"x" * i) for i in range(5)] + [(1, "t", "txt", b"y")], "shard bigint, stem string, suffix string, data binary")
    a, b = (sorted(map(tuple, writers.write_shards(s, str(tmp_path / d), "train").collect())) for d in "ab")
    assert a == b and [x[1] for x in a] == [5, 1] and all(len(x[3]) == 64 for x in a)


def test_plans(spark):
    c = planning.PlanConfig(planning.parse_class_map("person=0,truck=1"), min_objects=2, max_objects=4, empty_probability=0.2)
    a = planning.plan(spark, 300, 7, c).collect()
    assert sorted(map(str, a)) == sorted(map(str, planning.plan(spark, 300, 7, c).collect()))
    assert {r["idx"] for r in a} == set(range(300)) and 30 < sum(r["intentional_empty"] for r in a) < 90
    left = planning.plan(spark, 300, 7, c, done=spark.range(290).withColumnRenamed("id", "idx"))
    assert {r["idx"] for r in left.collect()} == set(range(290, 300))
    t = {"instances": [{"id": "a", "label": "person", "variation": {"cx_range": [0, 1]}}, {"id": "b", "label": "truck", "variation": {"cx_range": [0, 1]}}], "constraints": [{"type": "left_of", "a": "a", "b": "b", "margin": 0.1}]}
    rows = planning.plan(spark, 40, 1, planning.PlanConfig(c.class_map), template=t).collect()
    x = {(r["idx"], r["label"]): r["center_x"] for r in rows}
    assert all(x[i, "person"] + 0.1 <= x[i, "truck"] for i in range(40))
    t["constraints"].append({"type": "right_of", "a": "a", "b": "b"})
    rows = planning.plan(spark, 3, 1, planning.PlanConfig(c.class_map), template=t).collect()
    assert {(r["origin"], r["intentional_empty"]) for r in rows} == {("unsatisfied", False)}
    assets = spark.createDataFrame([(1, 0), (2, 0)], "asset_id bigint, class_id int")
    got = planning.choose_assets(spark.createDataFrame(a).filter("slot is not null"), assets).collect()
    assert all(r["asset_id"] in (1, 2) and r["fallback"] == (r["class_id"] == 1) for r in got)
    with pytest.raises(ValueError):
        planning.parse_class_map("a=0,b=2")


def test_pixels():
    img = np.random.default_rng(0).integers(0, 255, (64, 80, 3), np.uint8)
    out, applied = px.apply_recipe(img, {"effects": {k: {"p": 1} for k in px.EFFECTS}}, 3)
    again, _ = px.apply_recipe(img, {"effects": {k: {"p": 1} for k in px.EFFECTS}}, 3)
    assert (out == again).all() and len(applied) == len(px.EFFECTS) and out.shape == img.shape
    with pytest.raises(px.Unavailable):
        px.backend("clip")
    m = px.rasterize(np.array([[10, 10], [30, 10], [30, 20], [10, 20]]), 40, 50)
    assert m.sum() == 21 * 11 and px.mask_bbox(m) == (10, 10, 31, 21)
    hole = m.copy()
    hole[14:16, 15:20] = False
    assert (px.fill_holes(hole) == m).all() and px.grow(px.grow(m, 2), -2)[15, 20]
    a, b = px.visible_masks([m, m])
    assert a.sum() == 0 and b.sum() == m.sum()
    c = px.oriented_box(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [2, 1]]))
    assert np.allclose(c[0], [0, 0]) and np.isclose(abs(np.cross(c[1] - c[0], c[3] - c[0])), 8)


def test_run_state_stream(spark, tmp_path):
    src = tmp_path / "in"
    e = spark.createDataFrame([(1, "running", 0, 1), (1, "completed", 3, 2), (2, "failed", 0, 1)], "idx bigint, status string, objects bigint, updated_at bigint")
    e.write.parquet(str(src / "a"))
    state = RunState(spark, f"file://{tmp_path}/state", "idx bigint, status string, objects bigint, updated_at bigint")
    seen = []
    stream = lambda: spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(str(src))
    state.follow(stream(), str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(2, "completed", 5, 4), (1, "running", 0, 1)], e.schema).write.parquet(str(src / "b"))
    state.follow(stream(), str(tmp_path / "cp"), seen.append).awaitTermination(60)
    got = state.read()
    assert {(r["idx"], r["status"]) for r in got.collect()} == {(1, "completed"), (2, "completed")}
    assert compose.state_counts(got).first()["objects"] == 8
    assert compose.pending(spark.range(4).withColumnRenamed("id", "idx"), got).count() == 2 and seen == [{"completed": 2}]
    # a replayed batch changes nothing, a new one only the buckets it touches
    before = state.table.manifest()
    state.merge(e, 1)
    assert state.table.manifest() == before
    state.merge(spark.createDataFrame([(7, "failed", 0, 9)], e.schema), 2)
    now = state.table.manifest()
    assert now["version"] == before["version"] + 1 and all(x in now["entries"] for x in before["entries"]) and state.read().count() == 3


def test_diverse_subset_takes_every_vector(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(5200, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[5100] = -10 * m.mean(0) / np.linalg.norm(m.mean(0))  # the farthest by far, beyond any prefix of 5000
    df = spark.createDataFrame([*((i, v) for i, v in enumerate(m.tolist())), (9000, None), (9001, [1.0])], "id bigint, vec array<double>").repartition(5)
    mid = m.mean(0) / np.linalg.norm(m.mean(0))
    want = [int(np.argmin(m @ mid))]
    while len(want) < 8:
        far = (1 - m @ m[want].T).min(1)
        far[want] = -np.inf
        want.append(int(np.argmax(far)))
    got = sorted(similarity.select_diverse(df, 8).collect())
    assert [r["id"] for r in got] == want and want[0] == 5100 and [r["rank"] for r in got] == list(range(1, 9))
    assert similarity.select_diverse(df, 8, 5000).filter("id >= 5000").isEmpty() and similarity.select_diverse(df.limit(0), 8).isEmpty()
