"""Problem 4: references to records that do not exist at the time of the reference.

Sorted integer parent keys are compressed into contiguous runs (``parent_runs``). The distinct keys
referred to are matched as-of to the preceding run start, by one sort per block of the key space, and
a key beyond that run's end is missing. Of the others only those are looked into whose earliest
reference lies before their parent stands for good: the references to these, and to the missing ones,
are taken out of the table and judged by their own time; what the two times of a key do not settle
takes an anti join against the parents' lifetimes.

Scale: references are first combined to one row a key (map-side, so a key with any share of them is
one row a task), parents to one row a key and to runs; the sorts see distinct keys only, at most
``2 * BLOCK`` a block. The table of references is read twice, three columns of it, and shuffled never
or only where the keys to be looked into, a table written before, are too many for the engine to
broadcast; it then splits hot keys too. Lifetimes are joined row by row.

Defined results: a null reference is no orphan; a reference without time can only be ``missing``; a
parent row with a null ``added_at`` was never present; empty parent tables make every reference
``missing``; repeated reference or parent rows count once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.session import scratch

BLOCK = 1 << 16


def _block(key: str, size: int):
    return F.expr(f"({key} - pmod({key}, {size})) div {size}")


def _lifetimes(parent: DataFrame, key: str, added: str, removed: str) -> DataFrame:
    """(k, first_added, open_from): when each key first appeared, and from when on it is there for good."""
    p = parent.select(F.col(key).cast("bigint").alias("k"), F.col(added).alias("a"), F.col(removed).alias("r")).filter(F.col("k").isNotNull())
    return p.groupBy("k").agg(F.min("a").alias("first_added"), F.min(F.when(F.col("r").isNull(), F.col("a"))).alias("open_from"))


def parent_runs(keys: DataFrame, size: int = BLOCK) -> DataFrame:
    """(blk, run_start, run_end): distinct keys (k) as runs without gaps, cut at the blocks' ends."""
    b = keys.select("k", _block("k", size).alias("blk"))
    run = F.col("k") - F.row_number().over(Window.partitionBy("blk").orderBy("k"))
    return b.withColumn("run", run).groupBy("blk", "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("run")


def within_runs(refs: DataFrame, runs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds ``known`` to distinct keys (k, ...): whether the run that starts at or before the key
    reaches it."""
    rest = [c for c in refs.columns if c != "k"]
    marks = runs.select("blk", F.col("run_start").alias("k"), F.col("run_end"), F.lit(False).alias("is_ref"))
    both = refs.withColumns({"blk": _block("k", size), "is_ref": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("blk").orderBy("k", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    asof = both.withColumn("end", F.last("run_end", ignorenulls=True).over(before))
    return asof.filter("is_ref").select("k", *rest, F.coalesce(F.col("k") <= F.col("end"), F.lit(False)).alias("known"))


def orphans(
    refs: DataFrame, parent: DataFrame, ref_id: str, ref: str, at: str, key: str = "id", added: str = "added_at", removed: str = "removed_at", size: int = BLOCK
) -> DataFrame:
    """(ref_id, at, reason) of the references that do not hold: missing, late or deleted."""
    r = refs.select(F.col(ref_id).alias("_id"), F.col(ref).cast("bigint").alias("_k"), F.col(at).alias("_t")).filter(F.col("_k").isNotNull())
    used = r.groupBy(F.col("_k").alias("k")).agg(F.min("_t").alias("earliest"))
    lives = _lifetimes(parent, key, added, removed)
    keys = within_runs(used, parent_runs(lives.select("k"), size), size)
    # a key all of whose references come after it stands for good needs no further look
    doubtful = keys.join(lives, "k", "left").filter(~F.col("known") | F.coalesce(F.col("earliest") < F.col("open_from"), F.col("earliest").isNotNull()))
    # written, so that the engine knows its size before it plans the join
    side = scratch(refs.sparkSession, "doubtful")
    doubtful.select(F.col("k").alias("_k"), "known", "first_added", "open_from").write.parquet(side)
    j = r.join(refs.sparkSession.read.schema("_k bigint, known boolean, first_added timestamp, open_from timestamp").parquet(side), "_k")
    state = (
        F.when(~F.col("known"), "missing")
        .when(F.col("_t").isNull() | (F.col("_t") >= F.col("open_from")), "present")
        .when(F.col("_t") < F.col("first_added"), "late")
        .otherwise("unsettled")
    )
    settled = j.select("_id", "_k", "_t", state.alias("reason")).filter("reason <> 'present'")
    gone = parent.select(F.col(key).cast("bigint").alias("lk"), F.col(added).alias("la"), F.col(removed).alias("lr")).filter("la < lr").distinct()
    # one pass: a row is dropped if it is unsettled and some lifetime of its key covers its time
    out = settled.join(
        gone, (F.col("_k") == F.col("lk")) & (F.col("la") <= F.col("_t")) & (F.col("_t") < F.col("lr")) & (F.col("reason") == "unsettled"), "left_anti"
    )
    return (
        out.select(F.col("_id").alias(ref_id), F.col("_t").alias(at), F.when(F.col("reason") == "unsettled", "deleted").otherwise(F.col("reason")).alias("reason"))
        .distinct()
    )


def annotation_orphans(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """(annotation_id, added_at, ref_table, reason) over both references of the annotations."""
    out = None
    for name, ref, parent in (("image", "image_id", images), ("category", "category_id", categories)):
        o = orphans(annotations, parent, "id", ref, "added_at").select(F.col("id").alias("annotation_id"), "added_at", F.lit(name).alias("ref_table"), "reason")
        out = o if out is None else out.unionByName(o)
    return out


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, reason and month of ``added_at``."""
    return found.groupBy("ref_table", "reason", F.date_format("added_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
