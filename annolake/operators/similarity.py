"""Duplicates, leakage and diversity over hashes and embeddings.

Near hashes: a hash of 64 bits is cut into ``threshold + TOGETHER`` pieces, so any two within the
threshold have ``TOGETHER`` pieces in common; every choice of so many pieces is a key, and a pair is
taken only under its first common choice, so none comes twice.

Nearest neighbours: cells are fitted by spherical k-means on a bounded sample (``FIT_ROWS``), every
reference row is indexed in its nearest cell, a query goes to as many nearest cells as hold the
nearest neighbour of ``COVER`` of the sampled queries. Large cells are cut into blocks and the queries
of a block into batches, so a task holds one block and one batch, whatever the sizes; a block answers
a batch with one matrix product and the best over blocks is a map-side combined ``max``. Up to
``CELL_ROWS`` reference rows make one cell, and the answer is exact.

Defined results: null vectors and vectors of other lengths than the first take no part; ties go to
the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOGETHER = 3
CELL_ROWS = 4096
MAX_CELLS = 1024
FIT_ROWS = 20_000
COVER = 0.97


def exact_duplicates(rows: DataFrame, digest: str = "digest", pos: str = "pos") -> DataFrame:
    """Rows whose digest came before, with the first owner."""
    first = rows.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(pos).alias("owner"))
    return rows.join(first, digest).filter(F.col(pos) > F.col("owner")).select(pos, "owner")


def cross_split_exact(rows: DataFrame, order: dict[str, int], digest: str = "digest", split: str = "split", pos: str = "pos") -> DataFrame:
    """Rows whose digest is in an earlier split, with that split."""
    m = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    r = rows.withColumn("so", F.try_element_at(m, F.col(split))).filter(F.col("so").isNotNull() & F.col(digest).isNotNull())
    first = r.groupBy(digest).agg(F.min("so").alias("first_so"), F.min_by(split, "so").alias("owner_split"))
    return r.join(first, digest).filter("so > first_so").select(pos, split, "owner_split")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def piece_keys(h, threshold: int, together: int = TOGETHER):
    """array<struct<mask, earlier, key>> of a 64-bit hash: the bits of every choice of ``together``
    pieces, and the pieces that stand before the choice's last one without being in it."""
    n = threshold + together
    edge = [round(i * 64 / n) for i in range(n + 1)]
    piece = [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edge, edge[1:], strict=False)]
    rows = []
    for c in combinations(range(n), together):
        mask = _signed(sum(piece[i] & ((1 << 64) - 1) for i in c))
        earlier = [F.lit(piece[i]).cast("bigint") for i in range(c[-1]) if i not in c]
        none = F.array().cast("array<bigint>")
        rows.append(F.struct(F.lit(mask).cast("bigint").alias("mask"), (F.array(*earlier) if earlier else none).alias("earlier")))
    return F.transform(F.array(*rows), lambda r: F.struct(r["mask"].alias("mask"), r["earlier"].alias("earlier"), h.bitwiseAND(r["mask"]).alias("key")))


def hash_pairs(hashes: DataFrame, threshold: int, together: int = TOGETHER) -> DataFrame:
    """(x, y, distance): all pairs of different hashes (h, distinct) within the threshold, both ways."""
    b = hashes.select(F.col("h").alias("x"), F.explode(piece_keys(F.col("h"), threshold, together)).alias("k")).select("x", "k.*")
    other = b.select(F.col("x").alias("y"), "mask", "key")
    apart = F.col("x").bitwiseXOR(F.col("y"))
    first = F.forall("earlier", lambda m: apart.bitwiseAND(m) != 0)
    return b.join(other, ["mask", "key"]).filter((F.col("x") != F.col("y")) & (F.bit_count(apart) <= threshold) & first).select("x", "y", F.bit_count(apart).cast("int").alias("distance"))


def near_hashes(rows: DataFrame, threshold: int = 6, pos: str = "pos", h: str = "phash") -> DataFrame:
    """(pos, owner, distance): each row's nearest earlier row within the threshold, at most 7; the
    lowest position on ties (J7). Distinct hashes are joined, copies come back at the end, so a hot
    hash is one row in the join."""
    t = max(0, min(7, threshold))
    per = rows.filter(F.col(h).isNotNull()).groupBy(F.col(h).alias("h")).agg(F.min(pos).alias("first"))
    reach = hash_pairs(per.select("h"), t).join(per.select(F.col("h").alias("y"), F.col("first").alias("owner")), "y").select("x", "owner", "distance")
    same = per.select(F.col("h").alias("x"), F.col("first").alias("owner"), F.lit(0).alias("distance"))
    hit = rows.select(pos, F.col(h).alias("x")).join(reach.unionByName(same), "x").filter(F.col("owner") < F.col(pos))
    return hit.groupBy(pos).agg(F.min(F.struct("distance", "owner")).alias("m")).select(pos, "m.owner", "m.distance")


def cross_split_near(rows: DataFrame, order: dict[str, int], threshold: int = 6, pos: str = "pos", h: str = "phash", split: str = "split", digest: str = "digest") -> DataFrame:
    """(pos, split, owner, owner_split, distance): rows with a near hash in an earlier split that is
    no exact copy of theirs; the nearest, then the lowest position (J7 across splits). Of a hash and
    split two owners of different digests are kept: one of them is no copy of a given row."""
    t = max(0, min(7, threshold))
    m = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    r = rows.select(pos, F.col(h).alias("h"), F.col(split).alias("split"), F.coalesce(F.col(digest), F.concat(F.lit("row "), F.col(pos).cast("string"))).alias("digest"), F.try_element_at(m, F.col(split)).alias("so"))
    r = r.filter(F.col("so").isNotNull() & F.col("h").isNotNull())
    one = r.groupBy("h", "so", "split").agg(F.min(F.struct(F.col(pos).alias("owner"), "digest")).alias("o"))
    two = r.join(one, ["h", "so", "split"]).filter(F.col("digest") != F.col("o.digest")).groupBy("h", "so", "split").agg(F.min(F.struct(F.col(pos).alias("owner"), "digest")).alias("o"))
    owners = one.unionByName(two).select(F.col("h").alias("y"), F.col("so").alias("oso"), F.col("split").alias("owner_split"), "o.owner", F.col("o.digest").alias("od"))
    hashes = r.select("h").distinct()
    pairs = hash_pairs(hashes, t).unionByName(hashes.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance")))
    reach = pairs.join(owners, "y").select(F.col("x").alias("h"), "oso", "owner_split", "owner", "od", "distance")
    hit = r.join(reach, "h").filter((F.col("oso") < F.col("so")) & (F.col("digest") != F.col("od")))
    return hit.groupBy(pos, "split").agg(F.min(F.struct("distance", "owner", "owner_split")).alias("m")).select(pos, "split", "m.owner", "m.owner_split", "m.distance")


def _unit(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(n, -1) if n else np.zeros((0, 1))
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` rows as unit vectors, the ones with the smallest hashes."""
    t = rows.select("vec", F.xxhash64("id", F.lit("fit")).alias("o")).orderBy("o").limit(n).select("vec").toArrow()
    return _unit(t.column("vec").combine_chunks(), t.num_rows)


def fit_cells(reference: DataFrame, queries: DataFrame, cells: int, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, int]:
    """Cell centres and the number of cells a query must look into."""
    ref, q = _sample(reference, FIT_ROWS), _sample(queries, 1000)
    if cells <= 1 or not len(q):
        return ref[:1], 1
    centres = ref[np.random.default_rng(seed).choice(len(ref), min(cells, len(ref)), replace=False)]
    for _ in range(rounds):
        own = (ref @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, ref)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    own = (ref @ centres.T).argmax(1)
    sims = q @ ref.T
    sims[sims > 1 - 1e-6] = -2.0  # a query's own row tells nothing
    home = own[sims.argmax(1)]
    order = np.argsort(-(q @ centres.T), axis=1)
    rank = (order == home[:, None]).argmax(1) + 1
    return centres, int(np.quantile(rank, COVER, method="higher"))


def _to_cells(centres: np.ndarray, probes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _unit(b.column(1), b.num_rows) @ centres.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["cell", "id", "vec"])

    return rows


def nearest(queries: DataFrame, reference: DataFrame, cell_rows: int = CELL_ROWS, exclude_self: bool = False) -> DataFrame:
    """(id, best_id, sim): best cosine of each query (id, vec) among the reference rows."""
    schema = "cell int, id bigint, vec array<double>"
    some = lambda df: df.filter(F.col("vec").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    ref, q = some(reference), some(queries)
    n, size = ref.agg(F.count(F.lit(1)), F.min_by(F.size("vec"), "id")).first()
    if not n:
        return queries.sparkSession.createDataFrame([], "id bigint, best_id bigint, sim double")
    ref, q = ref.filter(F.size("vec") == size), q.filter(F.size("vec") == size)
    centres, probes = fit_cells(ref, q, min(MAX_CELLS, -(-n // cell_rows)))
    ref, q = ref.mapInArrow(_to_cells(centres, 1), schema), q.mapInArrow(_to_cells(centres, probes), schema)
    # one small table of block and batch numbers a cell, at most MAX_CELLS rows
    plan = ref.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("blocks")).join(q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * cell_rows)).cast("int").alias("sets")), "cell")
    to = lambda df, own, n_own, all_, n_all: df.join(F.broadcast(plan), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_all) - 1)).alias(all_), "id", "vec").select("cell", "blk", "part", "id", "vec")
    ref, q = to(ref, "blk", "blocks", "part", "sets"), to(q, "part", "sets", "blk", "blocks")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sims, owners = [], [], []
        ri, rm = right.column("id").to_numpy(), _unit(right.column("vec").combine_chunks(), right.num_rows)
        order = np.argsort(ri, kind="stable")
        ri, rm = ri[order], rm[order]
        for k in range(0, left.num_rows if len(ri) else 0, 1024):
            part = left.slice(k, 1024)
            qi = part.column("id").to_numpy()
            s = np.clip(_unit(part.column("vec").combine_chunks(), part.num_rows) @ rm.T, -1.0, 1.0)
            if exclude_self:
                s[qi[:, None] == ri[None, :]] = -2.0
            j = s.argmax(1)
            ids += qi.tolist()
            owners += ri[j].tolist()
            sims += s[np.arange(len(j)), j].tolist()
        return pa.table({"id": pa.array(ids, pa.int64()), "best_id": pa.array(owners, pa.int64()), "sim": pa.array(sims, pa.float64())})

    keys = ["cell", "blk", "part"]
    found = q.groupBy(*keys).cogroup(ref.groupBy(*keys)).applyInArrow(best, "id bigint, best_id bigint, sim double")
    return found.filter("sim >= -1").groupBy("id").agg(F.max(F.struct("sim", (-F.col("best_id")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("best_id"), "m.sim")


def cross_split_nearest(vectors: DataFrame, order: dict[str, int], threshold: float, split: str = "split") -> DataFrame:
    """(id, split, best_id, owner_split, sim) of the rows whose best match in some earlier split
    reaches the threshold, one row a pair of splits (J9)."""
    out, names = None, sorted(order, key=order.get)
    for i, own in enumerate(names):
        for other in names[:i]:
            near = nearest(vectors.filter(F.col(split) == own), vectors.filter(F.col(split) == other)).filter(F.col("sim") >= threshold)
            near = near.select("id", F.lit(own).alias("split"), "best_id", F.lit(other).alias("owner_split"), "sim")
            out = near if out is None else out.unionByName(near)
    return out


def uniqueness(vectors: DataFrame) -> DataFrame:
    """Summary of 1 - best similarity to another vector (G16); a vector alone is unique."""
    near = nearest(vectors, vectors, exclude_self=True)
    own = vectors.filter(F.col("vec").isNotNull()).select(F.col("id").cast("bigint").alias("id")).join(near, "id", "left")
    u = own.select(F.when(F.col("sim").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sim")))).alias("u"), "sim")
    p = F.percentile("u", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return u.agg(F.count(F.lit(1)).alias("samples"), F.avg("u").alias("mean_uniqueness"), p.alias("p"), F.avg("sim").alias("mean_nearest")).select(
        "samples", "mean_uniqueness", F.get("p", F.lit(1)).alias("median_uniqueness"), F.get("p", F.lit(0)).alias("p10"), F.get("p", F.lit(2)).alias("p90"), "mean_nearest"
    )


def perceptual_diversity(rows: DataFrame, h: str = "phash") -> DataFrame:
    """Images with a hash, distinct hashes and their ratio, null for none."""
    r = rows.agg(F.count(h).alias("n"), F.count_distinct(h).alias("n_unique"))
    return r.withColumn("diversity", F.when(F.col("n") > 0, F.col("n_unique") / F.col("n")))


def centroid(vectors: DataFrame) -> DataFrame:
    """One row: the mean vector, normalised."""
    each = vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = each.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(F.col("m.x").alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v)) + 1e-8
    return m.select(F.transform("m", lambda v: v / norm).alias("centroid"))


def select_diverse(vectors: DataFrame, count: int, limit: int | None = None) -> DataFrame:
    """(rank, id, score): greedy farthest points among all vectors, or the first ``limit`` by id.
    Each round is one pass that sends the chosen vectors, ``count`` at most, to the rows and brings
    back the farthest one."""
    spark, schema = vectors.sparkSession, "rank int, id bigint, score double"
    own = vectors.filter(F.col("vec").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    if limit is not None:
        own = own.orderBy("id").limit(limit)
    size = own.agg(F.min_by(F.size("vec"), "id")).first()[0]
    if size is None or count <= 0:
        return spark.createDataFrame([], schema)
    own = own.filter(F.size("vec") == size)

    def farthest(points: np.ndarray, chosen: list[int]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                ids = b.column(0).to_numpy()
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                free = ~np.isin(ids, chosen)
                if not free.any():
                    continue
                ids, m = ids[free], m[free]
                far = (1.0 - m @ points.T).min(1)
                k = np.lexsort((ids, -far))[0]
                if best is None or (-far[k], ids[k]) < best[:2]:
                    best = -far[k], ids[k], m[k].tolist()
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([int(best[1])], pa.int64()), pa.array([float(-best[0])], pa.float64()), pa.array([best[2]], pa.list_(pa.float64()))], names=["id", "far", "vec"])

        each = own.mapInArrow(rows, "id bigint, far double, vec array<double>")
        return each.agg(F.max_by(F.struct("id", "far", "vec"), F.struct("far", -F.col("id"))).alias("m")).first()["m"]

    # the first is the farthest from the middle, each next one from those chosen
    points, out = np.array([centroid(own).first()[0]]), []
    while len(out) < count and (best := farthest(points, [i for _, i, _ in out])):
        points = np.array([best["vec"]]) if not out else np.vstack((points, best["vec"]))
        out.append((len(out) + 1, best["id"], max(0.0, best["far"]) if out else best["far"]))
    return spark.createDataFrame(out, schema)


def first_rows(rows: DataFrame, limit: int, pos: str = "pos") -> DataFrame:
    """The first rows in scan order (O3)."""
    return rows.orderBy(pos).limit(max(0, limit))
