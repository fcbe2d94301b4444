"""Problem 5: a new train/val/test split that keeps related records together.

Records that share a link key (a background, a plan) form components: every key hooks its records
to the smallest of them, then rounds of hooking (the larger root of an edge under the smaller) and
shortcutting (parent := grandparent) over a parent table run until no edge joins two roots. The
split fills val and test to the closest reachable totals by subset-sum bitsets over the component
sizes with their multiplicities; the rest is train.

Scale: vertices are longs; the keys' stars are pre-aggregated minima, so a key that holds any share
of the records adds one edge per record and is never collected. Only the table of distinct sizes
(at most about the square root of twice the number of records) goes to the driver; the totals are
exact at every size. The wanted number of components of a size is taken
by a two-level rank (bucket counts, then places in the bucket), never by one sort of the size.

Defined results: a null or blank background links nothing; an image whose plan does not exist, or
with none, is a component of its own; repeated rows count once; empty tables give empty splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.llm.capture import split_of
from annolake.operators.graph import components, star_edges
from annolake.session import checkpoint

NEAR_BITS = 1 << 22
RATIOS = {"val": 0.1, "test": 0.1}


def background_name(c: Column) -> Column:
    """The file name in lower case, without directories, outer blanks and extension, ``%20`` read
    as a blank; null for null and blank."""
    x = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "%20", " "), r"\\", "/")))
    x = F.regexp_replace(x, "^.*/", "")
    x = F.trim(F.regexp_replace(F.trim(x), r"\.[^.]*$", ""))
    return F.when(F.length(x) > 0, x)


def _in_powers(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(size, number) in powers of two, so that any number up to the given one can be made."""
    items: list[tuple[int, int]] = []
    for s, n in sorted(sizes.items()):
        k = 1
        while n > 0:
            items.append((s, min(k, n)))
            n -= k
            k *= 2
    return items


def _reach(items: list[tuple[int, int]], bits: int, keep: int) -> int:
    for s, k in items:
        bits |= bits << (s * k) & keep
    return bits


def _trace(items: list[tuple[int, int]], bits: int, total: int, keep: int, out: dict[int, int]) -> int:
    """Notes the items that make ``total`` and gives what was there before them. Bitsets are built
    again by halves, so that only as many as the logarithm of the items stand in memory."""
    if not items:
        return total
    if len(items) == 1:
        s, k = items[0]
        if bits >> total & 1:
            return total
        out[s] = out.get(s, 0) + k
        return total - s * k
    mid = len(items) // 2
    total = _trace(items[mid:], _reach(items[:mid], bits, keep), total, keep, out)
    return _trace(items[:mid], bits, total, keep, out)


def _subset_sum(sizes: dict[int, int], goal: float) -> tuple[int, dict[int, int]]:
    """The reachable total closest to the goal, the smaller on ties, and the numbers that make it."""
    items = _in_powers(sizes)
    keep = (1 << (int(2 * goal) + 2)) - 1
    reach = _reach(items, 1, keep)
    lo = (reach & ((1 << (int(goal) + 1)) - 1)).bit_length() - 1
    up = reach >> (int(goal) + 1)
    hi = int(goal) + 1 + ((up & -up).bit_length() - 1) if up else None
    total = hi if hi is not None and hi - goal < goal - lo else lo
    out: dict[int, int] = {}
    _trace(items, 1, total, keep, out)
    return total, out


def closest_counts(sizes: dict[int, int], target: float, near_bits: int = NEAR_BITS) -> dict[int, int]:
    """How many components of each size make the total closest to ``target`` (the smaller on ties).

    Large targets are first filled, largest sizes first, up to ``near_bits`` records, and the bitsets
    place the rest; a total that meets the target to the nearest whole number cannot be bettered. Where
    none does, the bitsets run over the whole target."""
    goal = max(0.0, target)
    useful = {s: n for s, n in sizes.items() if s <= 2 * goal and n > 0}  # a larger one is worse than none
    taken: dict[int, int] = {}
    if 2 * goal > near_bits:
        rest = goal
        for s, n in sorted(useful.items(), reverse=True):
            k = min(n, max(0, int((rest - near_bits // 2) // s)))
            if k:
                taken[s] = k
                rest -= s * k
        total, more = _subset_sum({s: n - taken.get(s, 0) for s, n in useful.items() if s <= 2 * rest}, rest) if 2 * rest <= 2 * near_bits else (0, {})
        if abs(total - rest) <= abs(goal - round(goal)) + 1e-6:
            return {s: k for s in useful if (k := taken.get(s, 0) + more.get(s, 0))}
    return _subset_sum(useful, goal)[1]


def _ranked(comps: DataFrame, buckets: int = 1024) -> DataFrame:
    """Adds ``rank``, from 1 within each size in a fixed random order, without sorting a size whole."""
    b = comps.withColumn("_b", F.pmod(F.xxhash64("root", F.lit("split")), F.lit(buckets)))
    before = b.groupBy("n", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.sum("_c").over(Window.partitionBy("n").orderBy("_b")) - F.col("_c"))
    own = F.row_number().over(Window.partitionBy("n", "_b").orderBy(F.xxhash64("root"), "root"))
    return b.withColumn("_own", own).join(before.drop("_c"), ["n", "_b"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def assign(parent: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """(v, root, split): whole components, split totals closest to the ratios."""
    ratios = ratios or RATIOS
    comps = checkpoint(parent.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["n"]: r["k"] for r in comps.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = sum(n * k for n, k in sizes.items())
    left, cuts = dict(sizes), []
    for name, share in ratios.items():
        # every size gives its share first, so that a split is no set of loners; the bitsets place the rest
        even = {n: min(left.get(n, 0), int(k * share)) for n, k in sizes.items()}
        spare = {n: k - even.get(n, 0) for n, k in left.items() if k > even.get(n, 0)}
        more = closest_counts(spare, total * share - sum(n * k for n, k in even.items()))
        take = {n: k for n in left if (k := even.get(n, 0) + more.get(n, 0))}
        cuts += [(n, name, sizes[n] - left[n], sizes[n] - left[n] + k) for n, k in take.items()]
        left = {n: k - take.get(n, 0) for n, k in left.items() if k > take.get(n, 0)}
    spark = parent.sparkSession
    cut = spark.createDataFrame(cuts, "n bigint, split string, lo bigint, hi bigint")
    r = _ranked(comps).join(cut, "n", "left").groupBy("root").agg(F.max(F.when((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")), F.col("split"))).alias("split"))
    return parent.join(r, "root").select("v", "root", F.coalesce("split", F.lit("train")).alias("split"))


def linked_records(plans: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (plan idx * 2, image_id * 2 + 1), star edges, and the facts of each vertex."""
    p = plans.filter(F.col("idx").isNotNull()).select((F.col("idx") * 2).alias("v"), background_name(F.col("background")).alias("background")).distinct()
    i = images.filter(F.col("image_id").isNotNull()).select((F.col("image_id") * 2 + 1).alias("v"), (F.col("plan_idx") * 2).alias("plan"), split_of().alias("old")).dropDuplicates(["v"])
    made = i.join(p.select(F.col("v").alias("plan")).distinct(), "plan").select(F.col("v").alias("u"), F.col("plan").alias("v"))
    by_background = star_edges(p.filter(F.col("background").isNotNull()).select("v", "background"))
    vertices = p.select("v").unionByName(i.select("v")).distinct()
    facts = p.select("v", "background", F.lit(None).cast("bigint").alias("plan"), F.lit(None).cast("string").alias("old")).unionByName(i.select("v", F.lit(None).cast("string").alias("background"), "plan", "old"))
    return vertices, made.unionByName(by_background), facts


def torn_backgrounds(parent: DataFrame, facts: DataFrame) -> DataFrame:
    """Backgrounds whose images lie in more than one of today's splits. Only components with images
    of more than one split are looked into; a component then goes by the backgrounds of its plans."""
    f = facts.join(parent, "v")
    torn = f.filter(F.col("old").isNotNull()).groupBy("root").agg(F.min("old").alias("a"), F.max("old").alias("b")).filter("a <> b").select("root")
    inside = f.join(torn, "root", "left_semi")
    backgrounds = inside.filter(F.col("background").isNotNull()).select(F.col("v").alias("plan"), "background")
    old = inside.filter(F.col("old").isNotNull()).select("plan", "old").distinct()
    return old.join(backgrounds, "plan").groupBy("background").agg(F.min("old").alias("a"), F.max("old").alias("b")).filter("a <> b").select("background")
