"""Whole data sets in and out: the library's programmatic entry points (E5), thin over the operators.

Each takes roots by URI and gives a report as a dict; files that are moved, copied or packed are handled
by the executors, a table of them says where each one goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import pixels as px
from annolake.operators import compose, datasets, documents, hard_examples, labels, lineage, profile, reports, similarity
from annolake.operators.ranking import running
from annolake.session import scratch
from annolake.sources import readers, store, writers

FOLDERS = ("images", "labels", "labels-seg", "labels-obb", "masks")


def transfer(files: DataFrame, move: bool = False) -> int:
    """Copies or moves files (path, target), one after the other in every task; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store.write_bytes(dst, store.read_bytes(src))
                if move:
                    fs_, p = store._split(src)
                    fs_.delete_file(p)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("path", "target").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def files_of(spark: SparkSession, root: str, splits: tuple[str, ...] = readers.SPLITS) -> DataFrame:
    """(modality, split, stem, ext, path, length) of a data set."""
    own = [(f"{m}/{s}", f"{root}/{m}/{s}") for m in FOLDERS for s in splits]
    f = readers.list_folders(spark, own)
    return f.select(F.substring_index("split", "/", 1).alias("modality"), F.substring_index("split", "/", -1).alias("split"), "stem", "ext", "path", "length")


def boxes(spark: SparkSession, root: str, modality: str = "labels") -> DataFrame:
    """A data set's boxes with their polygons where it has any."""
    names = readers.read_classes(spark, f"{root}/classes.txt", strict=False) if store.exists(f"{root}/classes.txt") else {}
    return reports.boxes_of(labels.with_tokens(readers.read_label_lines(spark, root, modality)), names)


def learn_profile(spark: SparkSession, root: str, modality: str | None = None, bins: int = 20) -> dict:
    """The distribution profile of a data set (G10): of its COCO document, its label files (polygons
    before boxes) or its LabelMe documents."""
    if store.exists(f"{root}/instances_coco.json"):
        images, anns, cats = readers.read_coco(spark, f"{root}/instances_coco.json")
        own, im = profile.coco_boxes(anns, images, cats), images.select(F.col("id").alias("stem"))
    elif store.is_dir(f"{root}/images"):
        modality = modality or next((m for m in ("labels-seg", "labels-obb", "labels") if store.is_dir(f"{root}/{m}")), "labels")
        own, im = boxes(spark, root, modality), readers.list_images(spark, root).select("stem")
    else:
        shapes = readers.read_labelme(spark, root)
        own, im = profile.labelme_boxes(shapes), shapes.select(F.col("json_path").alias("stem"))
    return documents.load_checked("distribution-profile", profile.learn(im, profile.in_context(own), bins, source=root))


def split(spark: SparkSession, root: str, val_ratio: float = 0.2, seed: int = 42, run: str = "latest", mode: str = "move", apply: bool = True) -> dict:
    """Splits train by source objects and moves or copies what goes to val, in all modalities (W7, U4,
    U5, K27)."""
    log = readers.latest_log(root, run)
    if log is None:
        raise FileNotFoundError(f"no generation log in {root}")
    rows = readers.read_log(spark, log)
    edges = rows.select("stem", lineage.source_key(F.col("source_json"), F.col("shape_index")).alias("source")).filter(F.col("stem").isNotNull())
    side = scratch(spark, "groups")
    lineage.source_groups(edges).write.parquet(side)
    groups = spark.read.schema("stem string, gid string").parquet(side)
    s = lineage.assign_split(groups, val_ratio, seed)
    stems = groups.join(s.select("gid", "split"), "gid").select("stem", "split")
    leaks = lineage.split_leaks(edges.join(stems, "stem"))
    report = datasets.split_summary(s, val_ratio, leaks).first().asDict() | {"log_file": log.rsplit("/", 1)[-1], "mode": mode}
    if not apply:
        return report
    val = stems.filter("split = 'val'").select("stem")
    f = files_of(spark, root, ("train",))
    plan = datasets.apply_split(f.select("stem", "modality", "ext"), val, root).filter("split = 'val'")
    todo = f.join(plan.select("stem", "modality", "ext", "target"), ["stem", "modality", "ext"])
    report["files_transferred"] = transfer(todo, mode == "move")
    if store.exists(f"{root}/instances_coco.json"):
        images, anns, cats = readers.read_coco(spark, f"{root}/instances_coco.json")
        named = images.withColumn("_stem", F.regexp_extract("file_name", r"([^/\\]+?)(\.[^./\\]*)?$", 1)).join(stems.withColumnRenamed("stem", "_stem").withColumnRenamed("split", "_split"), "_stem")
        for part in ("train", "val"):
            own = named.filter(F.col("_split") == part).drop("_stem", "_split")
            writers.write_coco(f"{root}/annotations/instances_{part}.json", own, anns.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi").select(*anns.columns), cats)
    classes = readers.read_classes(spark, f"{root}/classes.txt") if store.exists(f"{root}/classes.txt") else {}
    if classes:
        writers.write_classes(root, classes)
    store.write_json(f"{root}/split_report.json", report)
    return report


def merge(spark: SparkSession, roots: list[str], out: str) -> dict:
    """Several data sets as one, their stems prefixed."""
    maps = [({n: i for i, n in readers.read_classes(spark, f"{r}/classes.txt").items()} if store.exists(f"{r}/classes.txt") else {}) for r in roots]
    classes = datasets.compatible_classes(maps)
    names = [r.rstrip("/").rsplit("/", 1)[-1] for r in roots]
    report: dict = {"datasets": names, "files": 0}
    for i, (root, name) in enumerate(zip(roots, names, strict=True), 1):
        place = F.concat_ws("/", F.lit(out), "modality", "split", F.concat(F.lit(f"{compose.safe_prefix(name, i)}_"), "stem", "ext"))
        report["files"] += transfer(files_of(spark, root).withColumn("target", place))
    if classes:
        writers.write_classes(out, {i: n for n, i in classes.items()})
    logs = [(n, readers.read_log(spark, p)) for r, n in zip(roots, names, strict=True) if (p := readers.latest_log(r))]
    if logs:
        merged = datasets.merge_logs(logs)
        writers.write_log(out, "generation_log", merged)
        report["log_rows"] = merged.count()
    coco = [(n, *readers.read_coco(spark, f"{r}/instances_coco.json")) for r, n in zip(roots, names, strict=True) if store.exists(f"{r}/instances_coco.json")]
    if coco:
        images, anns, cats = compose.merge_coco(coco)
        writers.write_coco(f"{out}/instances_coco.json", images.drop("part"), anns.drop("part"), cats)
        report |= {"coco_images": images.count(), "coco_annotations": anns.count()}
    return report


def shard(spark: SparkSession, root: str, out: str, part: str = "train", max_samples: int = 10_000, max_bytes: int = 0) -> dict:
    """A split as tar shards with their manifest."""
    f = files_of(spark, root, (part,))
    raw = spark.read.format("binaryFile").load([f"{root}/{m}/{part}" for m in FOLDERS if store.is_dir(f"{root}/{m}/{part}")])
    place = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    raw = raw.select(F.regexp_extract(place, r"([^/]+)/[^/]+/[^/]*$", 1).alias("modality"), F.regexp_extract(place, r"([^/]*)$", 1).alias("name"), "content")
    # zero-byte files are listed but not scanned
    files = f.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).join(raw, ["modality", "name"], "left").select("stem", "modality", "ext", F.coalesce("content", F.lit(b"")).alias("data"))
    lines = readers.read_label_lines(spark, root, splits=(part,))
    kind = datasets.primary_kind(lines, ["stem", "line_no"]).first()
    docs = datasets.coco_of_stems(*readers.read_coco(spark, f"{root}/instances_coco.json")) if store.exists(f"{root}/instances_coco.json") else None
    rows = datasets.sample_payloads(files, docs, kind["kind"] if kind else "detect", part)
    size = rows.groupBy("stem").agg(F.sum(F.length("data")).alias("bytes"))
    ranked = running(size, [F.col("stem")], [F.substring("stem", 1, 2)], name="pos").withColumn("split", F.lit(part))
    to = compose.shard_by_bytes(ranked, max_samples, max_bytes).join(ranked.select("pos", "stem"), "pos")
    shards = writers.write_shards(rows.join(to.select("stem", "shard"), "stem"), out, part).orderBy("file").collect()
    manifest = {"version": 1, "split": part, "samples": sum(r["samples"] for r in shards), "max_samples": max_samples, "max_bytes": max_bytes, "primary_label_kind": kind["kind"] if kind else "detect", "shards": [r.asDict() for r in shards]}
    for name in ("classes.txt", "data.yaml", "semantic_classes.json"):
        if store.exists(f"{root}/{name}"):
            store.write_bytes(f"{out}/{name}", store.read_bytes(f"{root}/{name}"))
    store.write_json(f"{out}/{part}-shards.json", manifest)
    return manifest


def hardmine(spark: SparkSession, root: str, predictions: str, out: str, part: str = "val", task: str = "detect", top: int = 200, match_iou: float = 0.5) -> dict:
    """Predictions against the labels of a split: scores, totals, the hardest images and their profile
    (S15, J11, G13, G14, K14)."""
    modality = {"seg": "labels-seg", "obb": "labels-obb"}.get(task, "labels")
    modality = modality if store.is_dir(f"{root}/{modality}/{part}") else "labels"
    images = readers.list_images(spark, root, (part,)).select("stem")
    order = F.lpad(F.col("line_no").cast("string"), 9, "0")
    side = lambda lines, own: hard_examples.shape_boxes(hard_examples.prediction_shapes(lines.filter("line is not null"), task, prediction=own), task).withColumns({"ord": order, "label": F.col("class_id").cast("string")})
    gt = side(readers.read_label_lines(spark, root, modality, (part,)), False)
    m = hard_examples.matched(images, gt, side(readers.read_predictions(spark, predictions), True), match_iou=match_iou)
    place = scratch(spark, "scores")
    hard_examples.scores(m).write.parquet(place)
    s = spark.read.parquet(place)
    total = s.agg(F.count(F.lit(1)).alias("images"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), F.sum("low_conf").alias("low_conf"), F.sum("poor_loc").alias("poor_loc")).first().asDict()
    by = {r["label"]: r for r in hard_examples.errors_by_class(m).collect()}
    rows = [r.asDict() for r in hard_examples.hardest(s, top).collect()]
    report = total | {"task": task, "split": part, "hard_images": len(rows), "fn_by_class": {k: r["fn"] for k, r in by.items() if r["fn"]}, "fp_by_class": {k: r["fp"] for k, r in by.items() if r["fp"]}}
    wanted = [r["stem"] for r in rows if r["gt"] > 0]
    own = None
    if wanted:
        chosen = spark.createDataFrame([(w,) for w in wanted], "stem string")
        cols = ["stem", "ord", "label", "cx", "cy", "w", "h", *(["points"] if "points" in gt.columns else [])]
        own = profile.learn(chosen, profile.in_context(gt.join(chosen, "stem", "left_semi").select(*cols)), source=root)
    return writers.write_hard_examples(out, report, rows, own)


def _features(spark: SparkSession, root: str) -> DataFrame:
    key = F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]+/[^/]+)$", 1)
    f = px.image_features(readers.read_images(spark, f"{root}/images")).withColumn("key", key).filter(F.col("vec").isNotNull())
    return f.withColumn("id", F.xxhash64("key"))


def diversity(spark: SparkSession, root: str, out: str, count: int = 0) -> dict:
    """How unlike a data set's pictures are, and the most different ones of them."""
    side = scratch(spark, "features")
    _features(spark, root).select("id", "key", "phash", "vec").write.parquet(side)
    f = spark.read.parquet(side)
    report = similarity.uniqueness(f.select("id", "vec")).first().asDict() | similarity.perceptual_diversity(f).first().asDict()
    chosen = similarity.select_diverse(f.select("id", "vec"), count).join(f.select("id", "key"), "id").orderBy("rank").select("rank", "key", "score") if count else None
    rows = [r.asDict() for r in chosen.collect()] if count else []
    writers.write_report(out, "diversity", report, rows)
    if rows:
        keys = spark.createDataFrame([(r["key"],) for r in rows], "key string")
        own = readers.list_images(spark, root).withColumn("key", F.concat_ws("/", "split", F.regexp_extract("path", r"([^/]*)$", 1)))
        report["copied"] = transfer(own.join(keys, "key", "left_semi").withColumn("target", F.concat(F.lit(f"{out}/images/"), "key")))
    return report


def leakage(spark: SparkSession, root: str, threshold: int = 6, embedding_threshold: float = 0.995) -> dict:
    """What of val and test is in an earlier split, exactly, nearly or by appearance."""
    q = reports.quality(spark, root, threshold, embedding_threshold)
    keys = ("cross_split_exact", "cross_split_near", "cross_split_embedding")
    return {k: q[k] for k in keys} | {"health": "ok" if not any(q[k] for k in keys) else "warning"}
