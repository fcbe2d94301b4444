"""Problem 2: duplicates and near-duplicates of new batches against everything accepted so far.

``HistoryIndex`` keeps, in the shared folder, an inverted index of the accepted records: per distinct
capture id the postings of its rare-token prefix, and one posting per hash, partitioned by token
bucket and appended batch by batch. Accepted records themselves are never read again, and batches
that stand in the index are not prepared again; the index may be kept from one call to the next.

Tokens of an id are its pieces of ``Q`` characters and, for each piece, what stands around it. Its
prefix of two is the rarest piece, by the counts of all batches so far, and that piece's surroundings:
one edit leaves one of the two whole, whichever piece was chosen, so the order of rarity may change
from batch to batch and a piece that a third of all ids share is no posting but where all pieces are
so. A batch probes with all its own tokens; candidates pass a filter of places and lengths, an overlap
count and an exact edit check.

Within a batch records count in order of image_id, each rejected by an accepted earlier one. The
records with one and the same (hash, id) are one node, so a group of copies of any size is one row;
nodes that share no key with another node of the batch are settled at once, the others in rounds: a
node that is the first of all its keys is accepted and rejects the others. Keys are the hash, the id
and each pair of near ids; only they carry the messages, groups are never paired out.

Scale: a batch reads its own rows and, of the index, the three narrow columns of the buckets its
tokens fall into; the number of buckets is fixed when the index is made, by the size of its first
batch (``ROWS_PER_BUCKET``). Nothing but batch and bucket numbers reaches the driver.

Defined results: a record without hash and id says nothing and is accepted; repeated rows count
once; a null ``batch_no`` comes after the last batch; an empty batch changes nothing; ids have at
least 2 * ``Q`` characters, as capture ids do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.capture import image_keys
from annolake.session import checkpoint, delete_path, scratch

Q = 6
COMMON = 8  # pieces with fewer occurrences in a batch count as equally rare
ROWS_PER_BUCKET = 1 << 20
LAST_BATCH = 2**31 - 1


def grams(c: Column, q: int = Q) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1))), lambda i: F.substring(c, i, q))


def near(a: Column, b: Column) -> Column:
    """At most one edit, behind the cheap filters: lengths, then places of one with a gram of the other."""
    shared = F.size(F.filter(grams(a), lambda g: F.array_contains(grams(b), g)))
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (shared >= F.length(a) - 2 * Q + 1) & (F.levenshtein(a, b) <= 1)


def _around(c: Column, at: Column, size: Column) -> Column:
    """What stands around the piece of ``size`` at ``at``, with the piece's place."""
    return F.xxhash64(F.lit("around"), at, F.substring(c, F.lit(1), at - 1), F.substring(c, at + size, F.length(c)))


def pieces(c: Column) -> Column:
    """array<struct<pos, gram>> of the disjoint pieces of an id."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - Q + 1, F.lit(1)), F.lit(Q)), lambda i: F.struct(i.alias("pos"), F.substring(c, i, Q).alias("gram")))


def probes(c: Column) -> Column:
    """array<struct<token, pos>>: every token an id within one edit may be posted under."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - Q + 2, F.lit(1)), F.lit(Q))
    places = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i - 1, i, i + 1))))
    own = F.transform(F.filter(places, lambda i: (i >= 1) & (i <= F.greatest(F.length(c) - Q + 1, F.lit(1)))), lambda i: F.struct(F.xxhash64(F.lit("piece"), F.substring(c, i, Q)).alias("token"), i.alias("pos")))
    # an edit inside the piece leaves it one longer, one shorter or as long as it was
    around = F.flatten(F.transform(starts, lambda i: F.transform(F.array(*(F.lit(Q + d) for d in (-1, 0, 1))), lambda n: F.struct(_around(c, i, n).alias("token"), i.alias("pos")))))
    return F.array_distinct(F.concat(own, around))


def nodes_of(keys: DataFrame) -> DataFrame:
    """(batch, ord, sha1, cid): the records of a batch with one and the same hash and id, by the
    first of them."""
    return keys.filter(F.col("sha1").isNotNull() | F.col("cid").isNotNull()).groupBy("batch", "sha1", "cid").agg(F.min("image_id").alias("ord"))


class HistoryIndex:
    """The accepted records' postings (token, pos, cid, sha1, bucket, batch) under ``path``.

    ``prepare`` turns incoming batches into nodes, index tokens and within-batch near pairs, looking
    at those batches only; ``admit`` then takes one prepared batch. Both may be repeated: what they
    write replaces what an interrupted run of the same batch left."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.spark, self.path, self.rows_per_bucket = spark, path.rstrip("/"), rows_per_bucket

    def _list(self, name: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read(self, name: str, schema: str) -> DataFrame:
        """A part of the index; empty while nothing has been written to it."""
        if not self._list(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def done(self) -> list[int]:
        """The batches that are settled; a batch's accepted records are written last."""
        return sorted(int(n.removeprefix("batch=")) for n in self._list("accepted") if "_SUCCESS" in self._list(f"accepted/{n}"))

    def buckets(self) -> int:
        """The number of token buckets, by the rows of the first batch that was prepared."""
        sizes = [int(n.removeprefix("n=")) for n in self._list("buckets")]
        if sizes:
            return sizes[0]
        rows = self.nodes().count() * 3
        n = 1 << max(0, (rows // self.rows_per_bucket).bit_length())
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/buckets/n={n}")
        return n

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def prepare(self, keys: DataFrame, batches: list[int]) -> None:
        """keys (batch, image_id, sha1, cid) of the batches to come."""
        self._write(nodes_of(keys.filter(F.col("batch").isin(batches))), "plain")
        plain = self._read("plain", "sha1 string, cid string, ord bigint, batch int").filter(F.col("batch").isin(batches))
        ids = plain.filter(F.col("cid").isNotNull()).select("batch", "cid").distinct()
        each = ids.select("batch", "cid", F.explode(pieces(F.col("cid"))).alias("p")).select("batch", "cid", "p.pos", "p.gram")
        self._write(each.groupBy("batch", "gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= COMMON), "common")
        common = self._read("common", "gram string, df bigint, batch int").groupBy("gram").agg(F.sum("df").alias("df"))
        rare = each.join(common, "gram", "left").groupBy("batch", "cid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "pos")).alias("r"))
        prefix = F.array(F.xxhash64(F.lit("piece"), F.col("r.gram")), _around(F.col("cid"), F.col("r.pos"), F.lit(Q)))
        self._write(rare.select("batch", "cid", F.col("r.pos").alias("pos"), F.explode(prefix).alias("token")), "incoming")
        own = self.incoming().filter(F.col("batch").isin(batches))
        probe = ids.select("batch", F.col("cid").alias("other"), F.explode(probes(F.col("cid"))).alias("t")).select("batch", "other", "t.token", F.col("t.pos").alias("at"))
        hit = own.join(probe, ["batch", "token"]).filter((F.col("cid") != F.col("other")) & (F.abs(F.col("pos") - F.col("at")) <= 1)).filter(near(F.col("cid"), F.col("other")))
        self._write(hit.select("batch", F.least("cid", "other").alias("cid"), F.greatest("cid", "other").alias("other")).distinct(), "pairs")
        pairs = self._read("pairs", "cid string, other string, batch int").filter(F.col("batch").isin(batches))
        name = F.concat_ws(" ", F.lit("p"), "cid", "other").alias("key")
        sides = pairs.select("batch", "cid", name).unionByName(pairs.select("batch", F.col("other").alias("cid"), name))
        own = F.array_compact(F.array(F.concat(F.lit("s"), "sha1"), F.concat(F.lit("c"), "cid")))
        keyed = plain.select("batch", "ord", F.explode(own).alias("key")).unionByName(plain.join(sides, ["batch", "cid"]).select("batch", "ord", "key"))
        shared = keyed.groupBy("batch", "key").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a < b").select("batch", "key")
        self._write(keyed.join(shared, ["batch", "key"], "left_semi"), "shared")

    def nodes(self) -> DataFrame:
        return self._read("plain", "sha1 string, cid string, ord bigint, batch int")

    def shared(self) -> DataFrame:
        """(ord, key) of the nodes that share a key with another of their batch."""
        return self._read("shared", "ord bigint, key string, batch int")

    def incoming(self) -> DataFrame:
        return self._read("incoming", "cid string, pos int, token bigint, batch int")

    def postings(self) -> DataFrame:
        return self._read("postings", "token bigint, pos int, cid string, sha1 string, batch int, bucket int")

    def append(self, batch: int, accepted: DataFrame) -> None:
        """Adds the postings of a batch's accepted nodes, then the nodes themselves."""
        ids = accepted.filter(F.col("cid").isNotNull()).select("cid").distinct()
        grams_ = self.incoming().filter(F.col("batch") == batch).join(ids, "cid", "left_semi").select("token", "pos", "cid", F.lit(None).cast("string").alias("sha1"))
        shas = accepted.filter(F.col("sha1").isNotNull()).select(F.xxhash64("sha1").alias("token"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("cid"), "sha1").distinct()
        rows = grams_.unionByName(shas).withColumn("bucket", F.pmod("token", F.lit(self.buckets())).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        accepted.select("ord").write.mode("overwrite").parquet(f"{self.path}/accepted/batch={batch}")

    def accept_whole(self, batch: int) -> None:
        self.append(batch, self.nodes().filter(F.col("batch") == batch))

    def admit(self, batch: int) -> None:
        """Settles a prepared batch against the index and appends what is accepted."""
        nodes = self.nodes().filter(F.col("batch") == batch).drop("batch")
        near_tokens = nodes.filter(F.col("cid").isNotNull()).select("cid").distinct().select(F.col("cid").alias("own"), F.explode(probes(F.col("cid"))).alias("t")).select("own", F.lit(None).cast("string").alias("own_sha"), "t.token", F.col("t.pos").alias("at"))
        sha_tokens = nodes.filter(F.col("sha1").isNotNull()).select(F.lit(None).cast("string").alias("own"), F.col("sha1").alias("own_sha"), F.xxhash64("sha1").alias("token"), F.lit(0).alias("at")).distinct()
        mine, stored, n = near_tokens.unionByName(sha_tokens), self.postings().filter(F.col("batch") < batch), self.buckets()
        if n > 1:
            touched = [r[0] for r in mine.select(F.pmod("token", F.lit(n)).cast("int").alias("b")).distinct().collect()]
            stored = stored.filter(F.col("bucket").isin(touched)) if len(touched) < n else stored
        hit = stored.join(mine, "token").filter(F.abs(F.col("pos") - F.col("at")) <= 1)
        hit = hit.filter((F.col("sha1") == F.col("own_sha")) | near(F.col("own"), F.col("cid"))).select("own", "own_sha").distinct()
        seen = hit.select(F.explode(F.array(F.struct(F.lit("c").alias("k"), F.col("own").alias("v")), F.struct(F.lit("s").alias("k"), F.col("own_sha").alias("v")))).alias("x")).filter("x.v is not null").select("x.k", "x.v")
        fresh = f"{self.path}/fresh/batch={batch}"
        left = nodes.join(seen.filter("k = 'c'").select(F.col("v").alias("cid")), "cid", "left_anti").join(seen.filter("k = 's'").select(F.col("v").alias("sha1")), "sha1", "left_anti")
        left.write.mode("overwrite").parquet(fresh)
        left = self.spark.read.schema("sha1 string, cid string, ord bigint").parquet(fresh)
        shared = self.shared().filter(F.col("batch") == batch).select("ord", "key")
        lost = self._lost(checkpoint(shared.join(left.select("ord"), "ord", "left_semi")))
        self.append(batch, left if lost is None else left.join(lost, "ord", "left_anti"))

    @staticmethod
    def _lost(keys: DataFrame) -> DataFrame | None:
        """The nodes (ord) among those that share keys (ord, key) which are rejected: first come,
        first served."""
        lost = None
        while not keys.isEmpty():
            first = keys.groupBy("key").agg(F.min("ord").alias("m"))
            won = checkpoint(keys.join(first, "key").groupBy("ord").agg(F.min(F.col("ord") <= F.col("m")).alias("w")).filter("w").select("ord"))
            taken = keys.join(won, "ord", "left_semi").select("key").distinct()
            out = keys.join(won, "ord", "left_anti").join(taken, "key", "left_semi").select("ord").distinct()
            out = checkpoint(out)
            keys = checkpoint(keys.join(won.unionByName(out), "ord", "left_anti"))
            lost = out if lost is None else lost.unionByName(out)
        return lost


def reject_over_history(images: DataFrame, index_path: str | None = None) -> DataFrame:
    """(image_id, batch_no) of the records to reject, batch after batch. With ``index_path`` the index
    is kept there and only batches it has not seen are taken; without, it lasts for this call."""
    spark = images.sparkSession
    index = HistoryIndex(spark, index_path or scratch(spark, "index"))
    before = index.done()
    keyed, out = scratch(spark, "keys"), scratch(spark, "rejected")
    batch = F.coalesce(F.col("batch_no"), F.lit(LAST_BATCH)).cast("int")
    new = images.filter(~batch.isin(before)) if before else images
    image_keys(new, batch.alias("batch")).write.partitionBy("batch").parquet(keyed)
    keys = spark.read.schema("image_id bigint, sha1 string, cid string, batch int").parquet(keyed)
    batches = sorted(r[0] for r in keys.select("batch").distinct().collect())
    if batches:
        index.prepare(keys, batches)
    for b in batches:
        index.accept_whole(b) if b == 0 else index.admit(b)
        # a settled batch's plans and generated classes are garbage: a small driver stays small
        spark.sparkContext._jvm.System.gc()
    accepted = index._read("accepted", "ord bigint, batch int").filter(F.col("batch").isin(batches))
    rows = keys.filter((F.col("batch") != 0) & (F.col("sha1").isNotNull() | F.col("cid").isNotNull()))
    # a record stands for its node: the node's first record is accepted or nothing of it is
    rows.join(accepted.select("ord"), F.col("image_id") == F.col("ord"), "left_anti").select("image_id", F.col("batch").alias("batch_no")).write.parquet(out)
    if index_path is None:
        delete_path(spark, index.path)
    delete_path(spark, keyed)
    return spark.read.schema("image_id bigint, batch_no int").parquet(out)
