"""Global positions and running sums without one global sort: a monotone bucket of the order key
gets its offset from the bucket totals, rows get their place inside their bucket. The totals' own sums are
made in two levels, within coarse buckets and over these, so that no window holds all buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

FINE = 1024  # buckets of numbers in a coarse one


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equal in all columns, nulls among them. Columns without nulls are compared plainly: rows placed by
    them are then not shuffled again."""
    nulls = {f.name for d in (left, right) for f in d.schema if f.nullable}
    each = (left[c].eqNullSafe(right[f"_r{c}"]) if nulls & {c, f"_r{c}"} else left[c] == right[f"_r{c}"] for c in columns)
    return reduce(lambda x, y: x & y, each, F.lit(True))


def _offsets(totals: DataFrame, keys: list[str], b: list[str]) -> DataFrame:
    """Adds ``_off``: the totals of the buckets before, within the keys."""
    kind = totals.schema[b[0]].dataType
    coarse = F.col(b[0]) if len(b) > 1 or not isinstance(kind, NumericType) else F.floor(F.col(b[0]) / FINE)
    t = totals.withColumn("_c", coarse)
    sums = t.groupBy(*keys, "_c").agg(F.sum("_t").alias("_ct"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    sums = sums.withColumn("_before", F.sum("_ct").over(over.orderBy("_c")) - F.col("_ct")).drop("_ct")
    sums = sums.withColumnsRenamed({c: f"_r{c}" for c in [*keys, "_c"]})
    own = F.sum("_t").over(Window.partitionBy(*keys, "_c").orderBy(*b)) - F.col("_t")
    t = t.withColumn("_own", own)
    return t.join(sums, _same(t, sums, [*keys, "_c"])).select(*keys, *b, (F.col("_own") + F.col("_before")).alias("_off"))


def running(df: DataFrame, order: list, bucket: list[Column], value: Column | None = None, keys: list[str] | None = None, name: str = "before", late: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (count if None) over the rows before this one in
    ``order`` within ``keys``. ``bucket`` must be monotone in the order; nulls come first in both.
    ``late``: what the order computes is computed after the shuffle, not carried through it."""
    keys = keys or []
    b = [f"_b{i}" for i in range(len(bucket))]
    v = (value if value is not None else F.lit(1)).cast("bigint")
    d = df.withColumns(dict(zip(b, bucket, strict=True)))
    totals = d.withColumn("_v", v).groupBy(*keys, *b).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_t"))
    offsets = _offsets(totals, keys, b).withColumnsRenamed({c: f"_r{c}" for c in [*keys, *b]})
    own = Window.partitionBy(*keys, *b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = (d.repartition(*keys, *b) if late else d).withColumn("_v", v).withColumn("_place", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    # every row has an offset: the left join is there since it never broadcasts the rows, coalesce since else it becomes an inner one
    out = j.join(offsets, _same(j, offsets, [*keys, *b]), "left").withColumn(name, F.col("_place") + F.coalesce("_off", F.lit(0)))
    return out.drop(*b, *(f"_r{c}" for c in [*keys, *b]), "_v", "_place", "_off")


def dense_ids(df: DataFrame, order: list, bucket: list[Column], name: str = "new_id") -> DataFrame:
    """Ids from 1 in order."""
    return running(df, order, bucket, name="_before").withColumn(name, F.col("_before") + 1).drop("_before")
