"""Whole data sets: hints, payloads, merging of logs, applying of splits, summaries, semantic masks
(S13, S16, S20, G2, G4, G6, G22, G24, J4, J18, J19, K10, K12, K27, O5, O6, U1, U2, U4, X5, X7).

Defined results: the first source that knows a stem gives its object count; a modality without a file
for a sample is left out of its payload; logs without a stem lose the row; null and blank labels are
no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators import labels
from annolake.operators.compose import safe_prefix
from annolake.operators.ranking import running

#: The columns of a merged and of a finished generation log.
MERGED_LOG = ("dataset", "stem", "background", "label", "class_id", "source_json", "shape_index", "flip", "angle", "box_xyxy")
FINISHED_LOG = ("generated_stem", "background", "label", "class_id", "source_json", "shape_index", "flipped", "box_xyxy", "used_paste_zone", "run_id")
#: The folders of a data set and the files in them.
MODALITIES = {"images": (".jpg", ".jpeg", ".png", ".webp", ".bmp"), "labels": (".txt",), "labels-seg": (".txt",), "labels-obb": (".txt",), "masks": (".png",)}


def object_count_hints(*sources: DataFrame) -> DataFrame:
    """(stem, n_objects, source) from tables (stem, n_objects) in order of trust: the first that
    knows a stem counts (S16)."""
    rows = None
    for i, s in enumerate(sources, 1):
        r = s.filter(F.col("stem").isNotNull() & F.col("n_objects").isNotNull()).groupBy("stem").agg(F.max(F.col("n_objects").cast("bigint")).alias("n_objects")).withColumn("source", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("stem").agg(F.min_by("n_objects", "source").alias("n_objects"), F.min("source").alias("source"))


def line_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(stem, n_objects): the lines of a label file that are not blank."""
    some = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s", "")) != ""
    return lines.filter(F.col("stem").isNotNull()).groupBy("stem").agg(F.count_if(some).alias("n_objects"))


def coco_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(stem, n_objects) of a COCO document."""
    n = annotations.select("id", "image_id").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    own = images.filter(F.col("stem").isNotNull()).groupBy(F.col("id").alias("image_id")).agg(F.min("stem").alias("stem"))
    return own.join(n, "image_id", "left").groupBy("stem").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_objects"))


def primary_kind(lines: DataFrame, order: list[str], default: str = "detect", line: str = "line") -> DataFrame:
    """(split, kind): the kind of the first line, in order of the files, that tells one."""
    p = labels.with_tokens(lines, line)
    n = F.col("n_tokens")
    kind = F.when(n == 5, "detect").when(n == 9, "obb").when((n >= 7) & (n % 2 == 1), "seg")
    first = p.filter(kind.isNotNull()).groupBy("split").agg(F.min_by(kind, F.struct(*order)).alias("kind"))
    return lines.select("split").distinct().join(first, "split", "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def segmentation_faults(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: files, objects and faults of a segmentation folder; a file of another kind has one
    fault more (G2)."""
    key = ["split", "stem"]
    safe = lines.withColumns({k: F.coalesce(F.col(k), F.lit("\x00")) for k in key})
    p = labels.with_tokens(safe, line)
    per = p.groupBy(*key).agg(F.count_if("is_object").alias("objects"), F.count_if(~F.col("is_valid")).alias("bad"))
    wrong = labels.file_kind(p, *key).select(*key, (F.col("kind") != "seg").cast("int").alias("wrong"))
    a = safe.select(*key).distinct().join(per, key, "left").join(wrong, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.agg(F.count(F.lit(1)).alias("label_files"), F.coalesce(F.sum(zero("objects")), F.lit(0)).alias("objects"), F.coalesce(F.sum(zero("bad") + zero("wrong")), F.lit(0)).alias("invalid"))


def modalities(samples: DataFrame, have: dict[str, DataFrame], key: str = "stem") -> DataFrame:
    """(key, modalities): which of the tables, in their order, know a sample."""
    out = samples.select(key).distinct()
    for i, (_, t) in enumerate(have.items()):
        out = out.join(t.select(key).distinct().withColumn(f"_{i}", F.lit(True)), key, "left")
    return out.select(key, F.array_compact(F.array(*(F.when(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(have)))).alias("modalities"))


def coco_of_stems(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(stem, doc): each image's part of a COCO document as JSON (J4). An image's annotations are one
    document by definition."""
    cats = categories.agg(F.collect_list(F.struct("id", "name")).alias("categories"))
    anns = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "bbox", "area"))).alias("annotations"))
    stem = F.regexp_extract("file_name", r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    i = images.filter(stem != "").select(stem.alias("stem"), F.struct("id", "file_name", "width", "height").alias("image"), F.col("id").alias("image_id"))
    j = i.join(anns, "image_id", "left").join(F.broadcast(cats))
    return j.select("stem", F.to_json(F.struct("image", F.coalesce("annotations", F.expr("cast(array() as array<struct<id:bigint,category_id:int,bbox:array<double>,area:double>>)")).alias("annotations"), "categories")).alias("doc"))


def sample_payloads(files: DataFrame, documents: DataFrame | None, primary: str, split: str) -> DataFrame:
    """(stem, suffix, data): everything a shard holds of a sample, from files (stem, modality, ext,
    data), and the sample's own description last (K12)."""
    suffix = (
        F.when(F.col("modality") == "images", F.ltrim(F.lower("ext"), F.lit(".")))
        .when(F.col("modality") == "labels", F.lit(f"{primary}.txt")).when(F.col("modality") == "labels-seg", "seg.txt").when(F.col("modality") == "labels-obb", "obb.txt").when(F.col("modality") == "masks", "semantic.png")
    )
    own = files.filter("modality = 'images'").select("stem").distinct()
    rows = files.join(own, "stem", "left_semi").select("stem", "modality", suffix.alias("suffix"), "data").filter(F.col("suffix").isNotNull())
    if documents is not None:
        rows = rows.unionByName(documents.join(own, "stem", "left_semi").select("stem", F.lit("coco").alias("modality"), F.lit("coco.json").alias("suffix"), F.encode("doc", "UTF-8").alias("data")))
    names = F.array_sort(F.collect_list(F.when(F.col("modality") != "images", F.col("suffix"))))
    image = F.max(F.when(F.col("modality") == "images", F.concat("stem", F.lit("."), "suffix")))
    about = rows.groupBy("stem").agg(names.alias("modalities"), image.alias("image_name"))
    meta = F.to_json(F.struct(F.lit(1).alias("version"), "stem", F.lit(split).alias("split"), "image_name", "modalities"))
    return rows.select("stem", "suffix", "data").unionByName(about.select("stem", F.lit("json").alias("suffix"), F.encode(meta, "UTF-8").alias("data")))


def merge_logs(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """The logs of several data sets under one header (U2): stems prefixed, columns a log does not
    have left empty, rows without a stem dropped. Older column names are read too."""
    out = None
    for i, (name, log) in enumerate(parts, 1):
        have = lambda *names: [F.col(n).cast("string") for n in names if n in log.columns]  # noqa: E731, B023
        stem = F.coalesce(*(F.when(c != "", c) for c in have("generated_stem", "stem")), F.lit(None).cast("string"))
        cols = {c: F.coalesce(*have(c), F.lit("")) for c in MERGED_LOG[2:]}
        cols["flip"] = F.coalesce(*have("flip", "flipped"), F.lit(""))
        cols["shape_index"] = F.coalesce(*have("shape_index"), F.lit("0"))
        rows = log.filter(stem.isNotNull()).select(F.lit(name).alias("dataset"), F.concat(F.lit(f"{safe_prefix(name, i)}_"), stem).alias("stem"), *(x.alias(c) for c, x in cols.items()))
        out = rows if out is None else out.unionByName(rows)
    return out.select(*MERGED_LOG)


def compatible_classes(maps: list[dict[str, int]]) -> dict[str, int]:
    """The class map all data sets share, those without one aside; an error where two differ."""
    own = [m for m in maps if m]
    for m in own[1:]:
        if m != own[0]:
            raise ValueError(f"class maps differ: {own[0]} and {m}")
    return own[0] if own else {}


def finished_log(rows: DataFrame, completed: DataFrame, order: list[str], bucket: list[Column]) -> DataFrame:
    """The rows of the completed samples (idx) in order of their index, numbered from 0 as the lines
    of the finished log (K10)."""
    kept = rows.join(completed.select("idx").distinct(), "idx", "left_semi")
    return running(kept, [F.col(c) for c in order], bucket, name="line").withColumn("line", F.col("line").cast("bigint"))


def apply_split(files: DataFrame, val: DataFrame, root: str, key: str = "stem") -> DataFrame:
    """Files (key, modality, ext) with the split they go to and their place in it, in all modalities
    alike (U4); what moves or copies them reads this table."""
    v = val.select(key).distinct().withColumn("_v", F.lit(True))
    split = F.when(F.col("_v"), "val").otherwise("train")
    place = F.concat_ws("/", F.lit(root.rstrip("/")), "modality", split, F.concat(F.col(key).cast("string"), "ext"))
    return files.join(v, key, "left").select(key, "modality", "ext", split.alias("split"), place.alias("target"))


def split_summary(groups: DataFrame, val_ratio: float, leaks: DataFrame | None = None) -> DataFrame:
    """One row about groups (gid, size, split): totals, target and actual ratio, leaks."""
    size = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("size"))), F.lit(0))
    one = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_images"), F.count(F.lit(1)).alias("source_groups"), size("train").alias("train"), size("val").alias("val"))
    one = one.select("*", F.lit(float(val_ratio)).alias("target_val_ratio"), F.when(F.col("total_images") > 0, F.col("val") / F.col("total_images")).otherwise(0.0).alias("actual_val_ratio"))
    n = leaks.agg(F.count(F.lit(1)).alias("source_leaks")) if leaks is not None else None
    return one.join(F.broadcast(n)) if n is not None else one.withColumn("source_leaks", F.lit(0).cast("bigint"))


def label_class_map(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, class_id): the labels that occur, numbered from 0 in their order (G22). Labels are a
    vocabulary; their first letters spread them over tasks."""
    own = rows.select(F.trim(label).alias("label")).filter(F.col("label") != "").distinct()
    return running(own, [F.col("label")], [F.substring("label", 1, 2)], name="class_id").withColumn("class_id", F.col("class_id").cast("bigint"))


def labelme_counts(shapes: DataFrame) -> DataFrame:
    """(label, n, n_images) of LabelMe shapes."""
    s = shapes.select(F.trim("label").alias("label"), "json_path").filter(F.col("label") != "")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("json_path").alias("n_images"))


def effect_counts(rows: DataFrame, effects: str = "effects") -> DataFrame:
    """(effect, n, place) over JSON lists of effects, which are names or objects with ``effect`` or
    ``name``; most frequent first, then by name (X5, G18, O6)."""
    v = F.explode(F.from_json(effects, "array<string>"))
    e = rows.select(v.alias("e")).filter("e is not null")
    name = F.coalesce(F.get_json_object("e", "$.effect"), F.get_json_object("e", "$.name"), F.col("e"))
    n = e.groupBy(name.alias("effect")).agg(F.count(F.lit(1)).alias("n"))
    return running(n, [F.desc("n"), F.col("effect")], [-F.col("n")], name="place").withColumn("place", (F.col("place") + 1).cast("bigint"))


def counter_maps(counts: DataFrame, key: str, name: str = "label", n: str = "n") -> DataFrame:
    """(key, counts): counters as JSON objects with their keys in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("k"), F.col(n).alias("v"))))
    return counts.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def examples(rows: DataFrame, key: str, order: str, text: Column, most: int = 10) -> DataFrame:
    """(key, n, examples): how many rows there are and the first of them (O5). Each task keeps its
    first ``most`` before anything is shuffled."""
    from pyspark.sql import Window

    first = rows.withColumn("_t", text).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= most)
    own = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("examples"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(own, key)


def mask_values(masks: DataFrame) -> DataFrame:
    """(stem, readable, counts map<int,bigint>) of decoded masks (stem, height, width, nChannels, data),
    one pass of NumPy (G4, S13)."""
    schema = "stem string, readable boolean, counts map<int,bigint>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stems, out = b.column(0).to_pylist(), []
            for c, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v, n = np.unique(np.frombuffer(data, np.uint8)[:: max(1, c)], return_counts=True) if data else ([], [])
                out.append(list(zip(map(int, v), map(int, n), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([bool(x) for x in out]), pa.array(out, pa.map_(pa.int32(), pa.int64()))], names=["stem", "readable", "counts"])

    return masks.select(F.col("stem").cast("string"), "nChannels", "data").mapInArrow(rows, schema)


def semantic_report(values: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(value, n) over all masks, and one row of counts: an empty mask is intended where the hints
    know of no object in it (G4, J18)."""
    pixels = values.select(F.explode("counts").alias("value", "n")).groupBy("value").agg(F.sum("n").alias("n"))
    v = values.withColumn("empty", F.col("readable") & ~F.exists(F.map_keys("counts"), lambda x: x != 0))
    v = v.join(hints.select("stem", "n_objects"), "stem", "left") if hints is not None else v.withColumn("n_objects", F.lit(None).cast("bigint"))
    meant = F.coalesce(F.col("n_objects") == 0, F.lit(False))
    return pixels, v.agg(
        F.count(F.lit(1)).alias("mask_files"), F.count_if("empty").alias("empty"), F.count_if(F.col("empty") & meant).alias("intentional_empty"),
        F.count_if(F.col("empty") & ~meant).alias("suspicious_empty"), F.count_if(~F.col("readable")).alias("unreadable"),
    )
