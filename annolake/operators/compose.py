"""Merging, sharding and run state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.ranking import dense_ids, running


def safe_prefix(name: str, index: int) -> str:
    """``NN_name`` with other characters than letters, digits, underscore and hyphen as underscores."""
    import re

    return f"{index:02d}_" + (re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or f"ds{index}")


def merge_coco(parts: list[tuple[str, DataFrame, DataFrame, DataFrame]], bucket: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of several sets (name, images, annotations, categories)
    with dense ids: categories by name in order of first appearance, annotations of unknown images
    or categories dropped."""
    img = ann = cat = None
    for i, (name, a, b, c) in enumerate(parts):
        p = F.lit(safe_prefix(name, i + 1))
        x = a.select(F.lit(i).alias("part"), F.col("id").alias("old"), F.concat(p, F.lit("_"), "file_name").alias("file_name"), "width", "height").dropDuplicates(["part", "old"])
        y = b.select(F.lit(i).alias("part"), F.col("id").alias("old"), F.col("image_id").alias("old_image"), F.col("category_id").alias("old_category"), "bbox", "area").dropDuplicates(["part", "old"])
        z = c.select(F.lit(i).alias("part"), F.col("id").alias("old"), "name").dropDuplicates(["part", "old"])
        img, ann, cat = (x, y, z) if img is None else (img.unionByName(x), ann.unionByName(y), cat.unionByName(z))
    order, bucks = [F.col("part"), F.col("old")], [F.col("part"), F.floor(F.col("old") / bucket)]
    images = dense_ids(img, order, bucks, "id")
    first = cat.groupBy("name").agg(F.min(F.struct("part", "old")).alias("f")).select("name", "f.part", "f.old")
    names = dense_ids(first, order, bucks, "id").select("name", F.col("id"))
    cats = cat.join(names, "name").select("part", F.col("old").alias("old_category"), F.col("id").alias("category_id"))
    kept = ann.join(images.select("part", F.col("old").alias("old_image"), F.col("id").alias("image_id")), ["part", "old_image"]).join(cats, ["part", "old_category"])
    return images.drop("old"), dense_ids(kept, order, bucks, "id").select("id", "image_id", "category_id", "bbox", "area", "part"), names


def shard_by_count(samples: DataFrame, max_samples: int, pos: str, bucket: Column, keys: list[str] | None = None) -> DataFrame:
    """Adds shard: floor(position / max_samples) in order of ``pos`` within ``keys``."""
    r = running(samples, [F.col(pos)], [bucket], keys=keys, name="_p")
    return r.withColumn("shard", F.floor(F.col("_p") / max(1, max_samples))).drop("_p")


def shard_by_bytes(samples: DataFrame, max_samples: int, max_bytes: int, split: str = "split", pos: str = "pos", size: str = "bytes") -> DataFrame:
    """(split, pos, shard): a new shard when the next sample would pass the byte or sample cap.
    Each split's rows stream once, in order, through one task that keeps three counters."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, n, used = object(), 0, 0, 0
        for b in batches:
            out = []
            for s, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != now:
                    now, shard, n, used = s, 0, 0, 0
                elif n >= max_samples or (max_bytes and n > 0 and used + (v or 0) > max_bytes):
                    shard, n, used = shard + 1, 0, 0
                n, used = n + 1, used + (v or 0)
                out.append(shard)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64()), pa.array(out, pa.int64())], names=["split", "pos", "shard"])

    rows = samples.select(F.col(split).alias("split"), F.col(pos).cast("bigint").alias("pos"), F.col(size).cast("bigint").alias("bytes"))
    return rows.repartition("split").sortWithinPartitions("split", "pos").mapInArrow(fold, "split string, pos bigint, shard bigint")


def last_state(events: DataFrame, idx: str = "idx", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last written row of every task."""
    rest = [c for c in events.columns if c != idx]
    o = F.struct(*order)
    return events.groupBy(idx).agg(F.max_by(F.struct(*rest), o).alias("s")).select(idx, "s.*")


def state_counts(state: DataFrame) -> DataFrame:
    """Tasks by status and the objects of the completed."""
    done = F.when(F.col("status") == "completed", F.col("objects"))
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(done), F.lit(0)).alias("objects"))


def pending(plan: DataFrame, state: DataFrame, idx: str = "idx") -> DataFrame:
    """Planned samples not completed yet."""
    return plan.join(state.filter("status = 'completed'").select(idx), idx, "left_anti")


def progress(completed: int, failed: int, requested: int, elapsed_s: float) -> dict:
    """Rate and time left."""
    rate = completed / elapsed_s if elapsed_s > 0 else 0.0
    left = max(0, requested - completed - failed)
    return {"completed": completed, "failed": failed, "requested": requested, "per_second": rate, "eta_seconds": left / rate if rate > 0 else None}
