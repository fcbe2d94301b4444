"""File sources: image and label listings, label text, COCO and LabelMe JSON, generation logs.

Presence and content are two things: zero-byte files vanish from Spark's file scans, yet an empty
label file is a valid negative and a missing one an error. So a listing, made by the executors, one
task a folder, says what exists, and the scan says what is inside; they are joined by folder and name,
left outer. Neither lists nor contents pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import masks
from annolake.sources import store

SPLITS = ("train", "val", "test")
#: Image suffixes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
MODALITIES = ("labels", "labels-seg", "labels-obb", "masks")
LISTING = "split string, stem string, ext string, path string, length bigint"


def list_folders(spark: SparkSession, folders: list[tuple[str, str]], recursive: bool = False) -> DataFrame:
    """The files of folders (split, uri) as LISTING; folders that do not exist have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for split, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = store.entries(uri, recursive)
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    dots = [i.base_name.rpartition(".") for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([split] * len(part)), pa.array([s if d else e for s, d, e in dots]), pa.array([f".{e.lower()}" if d else "" for _, d, e in dots]), pa.array([i.path for i in part]), pa.array([i.size for i in part], pa.int64())],
                        names=["split", "stem", "ext", "path", "length"],
                    )

    if not folders:
        return spark.createDataFrame([], LISTING)
    return spark.createDataFrame(folders, "split string, uri string").repartition(len(folders)).mapInArrow(rows, LISTING)


def list_images(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Images under images/<split>, else all images below the folder with split ``all``."""
    own = [(s, f"{root}/images/{s}") for s in splits if store.is_dir(f"{root}/images/{s}")]
    some = list_folders(spark, own).filter(F.col("ext").isin(*IMAGE_SUFFIXES))
    if own and not some.isEmpty():
        return some
    return list_folders(spark, [("all", root)], True).filter(F.col("ext").isin(*IMAGE_SUFFIXES))


def list_backgrounds(spark: SparkSession, root: str) -> DataFrame:
    """All images below a folder (S3)."""
    return list_folders(spark, [("all", root)], True).filter(F.col("ext").isin(*IMAGE_SUFFIXES))


def list_labels(spark: SparkSession, root: str, modality: str = "labels", splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Label files with their lengths, zero-byte ones included."""
    return list_folders(spark, [(s, f"{root}/{modality}/{s}") for s in splits]).filter(F.col("ext").isin(".txt", ".png"))


def _place(path: Column) -> tuple[Column, Column]:
    """Folder and name of a scan's path, whose odd characters are percent codes."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_extract(plain, r"([^/]+)/[^/]*$", 1), F.regexp_extract(plain, r"([^/]*)$", 1)


def read_label_lines(spark: SparkSession, root: str, modality: str = "labels", splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(split, stem, line_no, line): one row per line, and one with nulls for a file without any."""
    files = list_labels(spark, root, modality, splits).filter("ext = '.txt'")
    have = [f"{root}/{modality}/{s}" for s in splits if store.is_dir(f"{root}/{modality}/{s}")]
    if not have:
        return files.select("split", "stem", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"))
    folder, name = _place(F.col("_metadata.file_path"))
    text = spark.read.text(have, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").select(folder.alias("split"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.split("value", r"\r\n|\n|\r").alias("ls"))
    lines = text.select("split", "stem", F.posexplode("ls").alias("i", "line")).filter(F.trim("line") != "")
    return files.join(lines, ["split", "stem"], "left").select("split", "stem", (F.col("i") + 1).alias("line_no"), "line")


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem, line_no, line) of a folder of prediction texts, or of its ``labels`` folder where
    it has one (S15); the split is empty."""
    own = f"{root}/labels" if store.is_dir(f"{root}/labels") else root
    parent, _, name = own.rstrip("/").rpartition("/")
    grand, _, modality = parent.rpartition("/")
    return read_label_lines(spark, grand or "/", modality, (name,)).withColumn("split", F.lit(""))


def read_classes(spark: SparkSession, path: str, strict: bool = True) -> dict[int, str]:
    """``id: name`` lines; lenient reading takes the line number where no id stands."""
    out: dict[int, str] = {}
    for i, (line,) in enumerate(spark.read.text(path).collect()):  # one line per class
        head, colon, tail = line.partition(":")
        if colon and head.strip().isdigit():
            out[int(head)] = tail.strip()
        elif not strict and line.strip():
            out[i] = line.strip()
    return out


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a COCO document."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int,background:string,stem:string>>,"
        "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area double,segmentation:array<array<double>>,iscrowd:int>>,"
        "categories array<struct<id:int,name:string,supercategory:string>>"
    ).replace("area double", "area:double")
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(doc.select(F.explode(c).alias("x")).select("x.*") for c in ("images", "annotations", "categories"))


def read_labelme(spark: SparkSession, root: str) -> DataFrame:
    """One row per shape of the LabelMe documents below a folder; others have no shapes and fall out."""
    schema = "version string, imagePath string, imageData string, imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>,group_id:int>>, _corrupt_record string"
    doc = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    s = doc.select(F.col("_metadata.file_path").alias("json_path"), "imagePath", "imageWidth", "imageHeight", F.posexplode("shapes").alias("shape_index", "s"))
    pts = F.transform("s.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return s.select("json_path", "shape_index", F.col("s.label").alias("label"), F.col("s.shape_type").alias("shape_type"), pts.alias("points"), F.col("imageWidth").alias("image_w"), F.col("imageHeight").alias("image_h"))


def zone_class(label: Column) -> Column:
    """The class a zone label is for (``zone:person``), empty for all classes, null for no zone."""
    text = F.trim(label)
    own = F.lit(None).cast("string")
    for prefix in reversed(masks.ZONE_PREFIXES):
        own = F.when(F.lower(text).startswith(prefix), F.trim(F.substring(text, len(prefix) + 1, 2**20))).otherwise(own)
    return F.coalesce(own, F.when(F.lower(text).isin(*masks.ZONE_LABELS), F.lit("")))


def read_labelme_images(spark: SparkSession, root: str) -> DataFrame:
    """(json_path, source, content): the picture of every LabelMe document (S8): the one inside it,
    else the file it names, else one of its own stem; null without any."""
    doc = spark.read.schema("imagePath string, imageData string, shapes array<string>").json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", mode="PERMISSIVE")
    d = doc.filter(F.col("shapes").isNotNull()).select(F.col("_metadata.file_path").alias("json_path"), "imagePath", F.try_to_binary(F.col("imageData"), F.lit("base64")).alias("inside"))
    folder, name = (F.url_decode(F.regexp_replace(F.regexp_extract("json_path", p, 1), r"\+", "%2B")) for p in (r"^(.*)/[^/]*$", r"([^/]*)$"))
    d = d.withColumns({"folder": folder, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "named": F.regexp_extract(F.regexp_replace("imagePath", r"\\", "/"), r"([^/]*)$", 1)})
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG}").load(root)
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    f = f.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), "content")
    by_name = d.join(f.select("folder", F.col("name").alias("named"), F.col("content").alias("c1")), ["folder", "named"], "left")
    own = f.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).groupBy("folder", "stem").agg(F.min_by("content", "name").alias("c2"), F.min("name").alias("own_name"))
    j = by_name.join(own, ["folder", "stem"], "left")
    source = F.when(F.col("inside").isNotNull(), "embedded").when(F.col("c1").isNotNull(), F.col("named")).when(F.col("c2").isNotNull(), F.col("own_name"))
    return j.select("json_path", source.alias("source"), F.coalesce("inside", "c1", "c2").alias("content"))


def label_of_folder(path: Column, root: str, otherwise: str = "auto") -> Column:
    """The first folder below the root as label, for pictures without annotations."""
    below = F.regexp_replace(path, f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).otherwise(otherwise)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A generation log: the byte-order mark is dropped, ``generated_stem`` or the older ``stem`` read."""
    d = spark.read.csv(path, header=True)
    d = d.toDF(*(c.lstrip("﻿") for c in d.columns))
    have = [F.col(c) for c in ("generated_stem", "stem") if c in d.columns]
    shape = F.coalesce(F.col("shape_index"), F.lit("0")) if "shape_index" in d.columns else F.lit("0")
    return d.withColumn("_stem", F.coalesce(*have)).drop("generated_stem", "stem").withColumnRenamed("_stem", "stem").withColumn("shape_index", shape)


def latest_log(root: str, run_id: str = "latest") -> str | None:
    """The log of a run, or of the newest (S12): the one the summary points to, else that of the run
    configuration's last run, else the unnamed one, else the file written last."""
    of = lambda r: [f"{root}/{r}_log.csv", f"{root}/runs/{r}/generation_log.csv"]
    if run_id and run_id != "latest":
        return next((p for p in reversed(of(run_id)) if store.exists(p)), None)
    named = (store.read_json(f"{root}/latest_summary.json", {}) or {}).get("log_file")
    last = (store.read_json(f"{root}/run_config.json", {}) or {}).get("latest_run_id")
    for p in [*([f"{root}/{named}"] if named else []), *(of(last) if last else []), f"{root}/generation_log.csv"]:
        if store.exists(p):
            return p
    logs = [i for i in store.entries(root) if i.base_name.startswith("run_") and i.base_name.endswith("_log.csv")]
    newest = max(logs, key=lambda i: i.mtime_ns, default=None)
    return f"{root}/{newest.base_name}" if newest else None


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, mode, data); unreadable ones keep a row."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.*")


def dataset_kind(root: str) -> str:
    """``synthetic`` with images, masks or a COCO document, else ``labelme``."""
    own = store.is_dir(f"{root}/images") or store.is_dir(f"{root}/masks") or store.exists(f"{root}/instances_coco.json")
    return "synthetic" if own else "labelme"
