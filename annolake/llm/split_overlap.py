"""Problem 3: the same or nearly the same pictures in train and in val or test.

Every distinct capture id of a side becomes a bit fingerprint: six bits a character in reading
order, plus a 128-bit similarity hash that sets a bit per character pair. Four permutations of the
code (from the front or the back, each with a second piece next to it or at the far end) give
54-bit leading blocks; two ids within one edit agree in the block of at least one permutation,
whatever the place of the edit, so the block join across splits loses none. Candidates must lie
within ``RADIUS`` bits of similarity hash (one edit changes at most four pairs), then pass the
exact edit check. Copies are joined in only at the end, as pairs are what is asked for.

Defined results: records without split, or without hash and id, take part in nothing; repeated rows
count once; empty sides give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.capture import image_keys, split_of

RADIUS = 4
HEAD, TAIL = 6, 3


def fingerprint(c: Column) -> Column:
    """Two longs with one bit per distinct character pair, by its hash."""
    bit = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(c, i, 2)), F.lit(128)).cast("int"))

    def half(lo: int) -> Column:
        return F.aggregate(
            F.filter(bit, lambda b: (b >= lo) & (b < lo + 64)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b - lo))
        )

    return F.array(half(0), half(64))


def blocks(c: Column) -> Column:
    """array<struct<perm, block>>: the leading code blocks of the four permutations."""
    r = F.reverse(c)
    head, back = F.substring(c, 1, HEAD), F.substring(r, 1, HEAD)
    return F.array(
        F.struct(F.lit(0).alias("perm"), F.concat(head, F.substring(c, HEAD + 1, TAIL)).alias("block")),
        F.struct(F.lit(1).alias("perm"), F.concat(head, F.substring(r, 1, TAIL)).alias("block")),
        F.struct(F.lit(2).alias("perm"), F.concat(back, F.substring(r, HEAD + 1, TAIL)).alias("block")),
        F.struct(F.lit(3).alias("perm"), F.concat(back, F.substring(c, 1, TAIL)).alias("block")),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def near_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): distinct ids of two sides that are equal or one edit apart."""

    def coded(df: DataFrame, name: str) -> DataFrame:
        ids = df.filter(F.col("cid").isNotNull()).select("cid").distinct()
        return ids.select(F.col("cid").alias(name), fingerprint(F.col("cid")).alias(f"f{name}"), F.explode(blocks(F.col("cid"))).alias("b")).select(name, f"f{name}", "b.perm", "b.block")

    j = coded(left, "l").join(coded(right, "r"), ["perm", "block"])
    return j.filter((hamming(F.col("fl"), F.col("fr")) <= RADIUS) & (F.levenshtein("l", "r") <= 1)).select("l", "r").distinct()


def overlaps(images: DataFrame) -> DataFrame:
    """(train_id, eval_id, eval_split, train_dataset, eval_dataset, how): every overlapping pair."""
    k = image_keys(images, split_of().alias("sp"), "dataset").filter(F.col("sp").isNotNull())
    tr = k.filter("sp = 'train'").select(F.col("image_id").alias("train_id"), F.col("sha1").alias("ts"), F.col("cid").alias("tc"), F.col("dataset").alias("train_dataset"))
    ev = k.filter("sp <> 'train'").select(F.col("image_id").alias("eval_id"), F.col("sha1").alias("es"), F.col("cid").alias("ec"), F.col("sp").alias("eval_split"), F.col("dataset").alias("eval_dataset"))
    ids = near_ids(tr.select(F.col("tc").alias("cid")), ev.select(F.col("ec").alias("cid")))
    same_id = ids.join(ev, F.col("r") == F.col("ec")).join(tr, F.col("l") == F.col("tc"))
    cols = ["train_id", "eval_id", "eval_split", "train_dataset", "eval_dataset"]
    by_id = same_id.select(*cols, F.when(F.col("l") == F.col("r"), "same_id").otherwise("near_id").alias("how"))
    # by hash, less the pairs found by id: the two parts are disjoint, no distinct over pairs is needed
    by_hash = tr.join(ev, F.col("ts") == F.col("es")).filter(~F.coalesce(F.levenshtein("tc", "ec") <= 1, F.lit(False))).select(*cols, F.lit("same_hash").alias("how"))
    return by_id.unionByName(by_hash)


def overlap_counts(pairs: DataFrame) -> DataFrame:
    """Pairs, and evaluation records with any, per evaluation split and data set."""
    return pairs.groupBy("eval_split", F.col("eval_dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("eval_id").alias("n_records"))
