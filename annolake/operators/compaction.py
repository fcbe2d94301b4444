"""Problem 7: millions of tiny result files into few files of good size, one record per key.

Partition-local compaction of a versioned table (``SnapshotTable``). New fragments are parsed and
appended as they come, as landing files of no partition. ``compact_fragments`` then finds the
partitions (hash buckets of the run) that have landing records or more small files than wanted, and
rewrites only these: the last writer of every key survives, in files near the wanted size, and the
partitions that occur in the rewrite replace theirs in the next version (dynamic overwrite), all
others stay where they are. A version is a manifest, made in one exclusive step after its data are
written: readers see the files of one version whatever is written beside them, a crash leaves files
that no version names, and of two writers based on one version the second is refused.

Scale: parsing and landing are narrow; the survivors take one shuffle by key, cut to one record a key
and task before it, and one by partition and file. A partition of any size is written by as many
tasks as its bytes need, a run with any share of the rows likewise. The driver holds one entry per
partition of a version; the number of partitions follows from the input's bytes when the table is made.

Defined results: a body that holds nothing gives no record; text that is not JSON, and JSON values
that are no objects, are records with ``problem`` set and no key; a record without a numeric
``index`` has no key, never competes and survives; ``index`` may be a number or its text in any
writing (``"000007"``, ``7.0``); a null ``run_id`` is a run of its own; a null ``modified_at`` is the
earliest; repeated rows count once; other columns pass by unread.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolake.session import delete_path

RECORD = "fragment_id bigint, rec_no int, run_id string, modified_at timestamp, index_key string, ok boolean, stem string, objects bigint, error string, problem string, n_bytes bigint"
_ARROW = pa.schema([
    ("fragment_id", pa.int64()), ("rec_no", pa.int32()), ("run_id", pa.string()), ("modified_at", pa.timestamp("us", tz="UTC")), ("index_key", pa.string()),
    ("ok", pa.bool_()), ("stem", pa.string()), ("objects", pa.int64()), ("error", pa.string()), ("problem", pa.string()), ("n_bytes", pa.int64()),
])
_SPACE = " \t\r\n\x00\x0b\x0c\x1e﻿,"


def index_key(v: object) -> str | None:
    """The number's canonical text, or None where the value is no finite number."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int):
        return str(v)
    try:
        d = Decimal(v.strip() if isinstance(v, str) else repr(v))
    except (InvalidOperation, AttributeError):
        return None
    if not d.is_finite() or abs(d.adjusted()) > 400:
        return None
    return str(int(d)) if d == d.to_integral_value() else format(d.normalize(), "f")


def read_objects(body: str | None) -> Iterator[tuple[object, str | None]]:
    """The JSON values one after the other, items of a list counting singly; the rest of a text
    that cannot be read comes as one value with its problem."""
    if not body:
        return
    decode, p, n = json.JSONDecoder(strict=False).raw_decode, 0, len(body)
    while True:
        while p < n and body[p] in _SPACE:
            p += 1
        if p >= n:
            return
        try:
            v, p = decode(body, p)
        except (ValueError, RecursionError):
            yield body[p:], "not_json"
            return
        for x in v if isinstance(v, list) else [v]:
            yield x, None if isinstance(x, dict) else "not_an_object"


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _whole(v: object) -> int | None:
    k = index_key(v)
    return int(k) if k and k.lstrip("-").isdigit() and len(k) < 19 else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: dict[str, list] = {f.name: [] for f in _ARROW}
        for fid, run, at, body in zip(b.column("fragment_id").to_pylist(), b.column("run_id").to_pylist(), b.column("modified_at").cast(pa.int64()).to_pylist(), b.column("body").to_pylist(), strict=True):
            for no, (o, problem) in enumerate(read_objects(body), 1):
                d = o if isinstance(o, dict) else {}
                ok = d.get("ok")
                row = (fid, no, run, at, index_key(d.get("index")), ok if isinstance(ok, bool) else None, _text(d.get("stem")), _whole(d.get("objects")), _text(d.get("error")), problem, len(str(o)) if problem else 80)
                for name, v in zip(cols, row, strict=True):
                    cols[name].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols["modified_at"], pa.int64()).cast(f.type) if f.name == "modified_at" else pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)


def records(fragments: DataFrame) -> DataFrame:
    """One row per JSON value of the bodies, ``rec_no`` counting from 1."""
    ts = F.col("modified_at").cast("timestamp")
    return fragments.select(F.col("fragment_id").cast("bigint").alias("fragment_id"), "run_id", ts.alias("modified_at"), "body").mapInArrow(_records, RECORD)


def survivors(recs: DataFrame) -> DataFrame:
    """The last record written of every (run, index); records without a key, each once."""
    key = [F.coalesce(F.concat(F.lit("r"), "run_id"), F.lit("")), F.col("index_key"), *(F.when(F.col("index_key").isNull(), F.col(c)) for c in ("fragment_id", "rec_no"))]
    # the rank is cut to 1 in every task before the shuffle, so no key is ever collected
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last("modified_at"), F.desc("fragment_id"), F.desc("rec_no"))
    return recs.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


class Conflict(RuntimeError):
    """Another writer committed since the snapshot this commit is based on."""


class SnapshotTable:
    """Parquet files of one int partition column, as a chain of versions.

    ``_versions/v<N>.json`` names what version N consists of: per entry a folder that one writer
    wrote and nobody changes, the partition in it (null for landing files, which are of no
    partition), its files, bytes, rows and the number of small files."""

    def __init__(self, spark: SparkSession, path: str, partition: str, schema: str, small_bytes: int = 32 << 20) -> None:
        self.spark, self.path, self.partition, self.schema, self.small_bytes = spark, path.rstrip("/"), partition, schema, small_bytes
        self._jvm = spark.sparkContext._jvm

    def _p(self, s: str):
        return self._jvm.org.apache.hadoop.fs.Path(s)

    def _fs(self):
        return self._p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        d = self._p(f"{self.path}/_versions")
        fs = self._fs()
        names = [s.getPath().getName() for s in (fs.listStatus(d) if fs.exists(d) else [])]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "parent": None, "why": "empty", "entries": []}
        s = self._fs().open(self._p(f"{self.path}/_versions/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()

    def _commit(self, base: int, why: str, entries: list[dict]) -> int:
        """The manifest of the version after ``base``, written aside and renamed into a place that must be free."""
        new = base + 1
        aside, place = self._p(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._p(f"{self.path}/_versions/v{new}.json")
        out = self._fs().create(aside, False)
        out.write(bytearray(json.dumps({"version": new, "parent": base, "why": why, "entries": entries}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs().makeQualified(aside), self._fs().makeQualified(place), options)
        except Exception as e:
            self._fs().delete(aside, False)
            raise Conflict(f"version {new} exists already") from e
        return new

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")

    def _entries(self, name: str, landing: bool) -> list[dict]:
        """What a folder that was just written holds, one entry per partition."""
        part = F.lit(None).cast("int") if landing else F.col(self.partition)
        files = self._folder(name).groupBy(part.alias("part"), F.col("_metadata.file_path").alias("f")).agg(F.max("_metadata.file_size").alias("b"), F.count(F.lit(1)).alias("n"))
        per = files.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows"), F.count_if(F.col("b") < self.small_bytes).alias("small"))
        return [{"dir": name, **r.asDict()} for r in per.orderBy("part").collect()]

    def _of(self, entries: list[dict]) -> DataFrame:
        out = None
        for name in dict.fromkeys(e["dir"] for e in entries):
            own = [e["part"] for e in entries if e["dir"] == name]
            if None in own:
                df = self._folder(name)
            else:
                base = f"{self.path}/data/{name}"
                df = self.spark.read.schema(self.schema).option("basePath", base).parquet(*(f"{base}/{self.partition}={p}" for p in own))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one) as its manifest names them."""
        return self._of(self.manifest(version)["entries"])

    def _write(self, rows: DataFrame, landing: bool) -> tuple[str, list[dict]]:
        name = f"{'landing' if landing else 'parts'}-{uuid.uuid4().hex[:12]}"
        w = rows.write if landing else rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition)
        w.parquet(f"{self.path}/data/{name}")
        return name, self._entries(name, landing)

    def append(self, rows: DataFrame, why: str = "append") -> int:
        """Adds rows as landing files, without a shuffle."""
        base = self.manifest()
        _, new = self._write(rows, True)
        return self._commit(base["version"], why, base["entries"] + new)

    def rewrite(self, rows: DataFrame, base: int, why: str, gone: set[int | None] = frozenset()) -> int:
        """The version after ``base`` in which the partitions that occur in ``rows`` are replaced and
        those named in ``gone`` (None: the landing files) dropped. Refused if ``base`` is not the last."""
        if self.version() != base:
            raise Conflict(f"the table is at version {self.version()}, the rewrite is based on {base}")
        name, new = self._write(rows, False)
        drop = gone | {e["part"] for e in new}
        try:
            return self._commit(base, why, [e for e in self.manifest(base)["entries"] if e["part"] not in drop] + new)
        except Conflict:
            delete_path(self.spark, f"{self.path}/data/{name}")
            raise

    def crowded(self, max_small: int, version: int | None = None) -> set[int]:
        """Partitions with more than ``max_small`` small files."""
        n: dict[int, int] = {}
        for e in self.manifest(version)["entries"]:
            if e["part"] is not None:
                n[e["part"]] = n.get(e["part"], 0) + e["small"]
        return {p for p, k in n.items() if k > max_small}

    def compact(self, target_bytes: int = 128 << 20, max_small: int = 1, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Rewrites the partitions that have landing rows or too many small files, with what ``keep``
        leaves of their rows; gives the version unchanged where there are none."""
        m = self.manifest()
        landing = [e for e in m["entries"] if e["part"] is None]
        weight = sum(e["bytes"] for e in m["entries"]) / max(1, sum(e["rows"] for e in m["entries"]))
        rows_in = {r[0]: r[1] for r in self._of(landing).groupBy(self.partition).agg(F.count(F.lit(1))).collect()} if landing else {}
        chosen = self.crowded(max_small, m["version"]) | set(rows_in)
        if not chosen and not landing:
            return m["version"]
        old = [e for e in m["entries"] if e["part"] in chosen]
        for e in old:
            rows_in[e["part"]] = rows_in.get(e["part"], 0) + e["rows"]
        counts = {p: max(1, round(n * weight / target_bytes)) for p, n in rows_in.items()}
        files = self.spark.createDataFrame(list(counts.items()), f"{self.partition} int, _files int")
        spread = keep(self._of(landing + old)).join(files, self.partition).withColumn("_slot", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
        return self.rewrite(spread.repartition(sum(counts.values()), self.partition, "_slot").drop("_slot", "_files"), m["version"], "compaction", chosen | {None})


def task_results(spark: SparkSession, path: str, small_bytes: int = 32 << 20) -> SnapshotTable:
    """The table of task results: records in hash buckets of their run."""
    return SnapshotTable(spark, path, "part", f"{RECORD}, part int", small_bytes)


def compact_fragments(fragments: DataFrame, path: str, target_bytes: int = 128 << 20, max_small: int = 1, small_bytes: int = 32 << 20) -> tuple[SnapshotTable, int]:
    """Appends the fragments' records to the table at ``path`` and compacts it to one record per run
    and index. Gives the table and the version before the compaction, with all records in it."""
    spark = fragments.sparkSession
    t = task_results(spark, path, small_bytes)
    first = t.manifest(min(1, t.version()))
    parts = int(first["why"].split()[-1]) if first["version"] else 0
    if not parts:
        size = fragments.agg(F.coalesce(F.sum(F.greatest(F.coalesce(F.col("n_bytes").cast("bigint"), F.lit(0)), F.lit(0))), F.lit(0))).first()[0]
        parts = max(1, -(-int(size) // target_bytes))
    bucket = F.pmod(F.xxhash64(F.coalesce("run_id", F.lit(""))), F.lit(parts)).cast("int").alias("part")
    raw = t.append(records(fragments).select("*", bucket), f"fragments of runs in buckets: {parts}")
    t.compact(target_bytes, max_small, survivors)
    return t, raw


def superseded(t: SnapshotTable, raw: int) -> DataFrame:
    """(fragment_id, rec_no) of the records of version ``raw`` that its compaction left out."""
    ids = ["fragment_id", "rec_no"]
    return t.read(raw).select(ids).distinct().join(t.read(min(raw + 1, t.version())).select(ids), ids, "left_anti")
