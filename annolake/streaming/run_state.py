"""Run state fed by a stream of task events.

``foreachBatch`` merges each micro-batch into a snapshot table of the last row per task, in hash
buckets of the task: only the buckets that the batch touches are read and rewritten. A version names
the batch it came from, so a batch that is replayed after a failure changes nothing. What is known of
a run as a whole stands in documents beside it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annolake.operators.compaction import SnapshotTable
from annolake.operators.compose import last_state, progress, state_counts
from annolake.session import scratch
from annolake.sources import store

BUCKETS = 64


class RunState:
    """The last row of every task. ``buckets`` is fixed when the state is made: about as many as give
    buckets of a good file size for the tasks to come."""

    def __init__(self, spark: SparkSession, path: str, schema: str, idx: str = "idx", order: tuple[str, ...] = ("updated_at",), buckets: int = BUCKETS) -> None:
        self.spark, self.idx, self.order, self.buckets = spark, idx, order, buckets
        self.table = SnapshotTable(spark, path, "part", f"{schema}, part int")

    def read(self) -> DataFrame:
        return self.table.read().drop("part")

    def merge(self, events: DataFrame, batch_id: int) -> None:
        """Takes in a batch of events; one that was taken in before is not again."""
        m = self.table.manifest()
        if m["version"] and int(m["why"].split()[-1]) >= batch_id:
            return
        new = events.withColumn("part", F.pmod(F.xxhash64(self.idx), F.lit(self.buckets)).cast("int"))
        touched = {r[0] for r in new.select("part").distinct().collect()}  # at most the buckets
        if not touched:
            return
        old = self.table._of([e for e in m["entries"] if e["part"] in touched])
        side = scratch(self.spark, "state")
        both = old.unionByName(new.select(*old.columns))
        last_state(both, self.idx, self.order).select(*old.columns).repartition("part").write.parquet(side)
        self.table.rewrite(self.spark.read.schema(self.table.schema).parquet(side), m["version"], f"batch {batch_id}", touched)

    def follow(self, stream: DataFrame, checkpoint: str, status: Callable[[dict], None] | None = None) -> StreamingQuery:
        """Starts keeping the state of a stream of events; stop() leaves a resumable state (T7). After
        every batch ``status`` gets the counts so far (T5)."""

        def take(events: DataFrame, batch_id: int) -> None:
            self.merge(events, batch_id)
            if status:
                status({r["status"]: r["n"] for r in state_counts(self.read()).collect()})

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def config_hash(payload: dict) -> str:
    """SHA-256 of a configuration with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def run_id(now: dt.datetime | None = None) -> str:
    """``run_YYYYMMDD_HHMMSS``."""
    return f"run_{(now or dt.datetime.now(dt.UTC)):%Y%m%d_%H%M%S}"


class RunMeta:
    """What is known of one run, a document in the folder of all runs."""

    def __init__(self, root: str, run: str) -> None:
        self.root, self.run = root.rstrip("/"), run

    @property
    def path(self) -> str:
        return f"{self.root}/runs/{self.run}.json"

    def read(self) -> dict:
        return store.read_json(self.path, {}) or {}

    def set(self, **facts: object) -> dict:
        out = self.read() | facts | {"updated_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
        store.write_json(self.path, out)
        return out

    def initialize(self, config: dict, count: int) -> dict:
        """Starts or resumes the run; refused where it was begun with another configuration."""
        own, h = self.read(), config_hash(config)
        if own.get("config_hash") not in (None, h):
            raise ValueError(f"run {self.run} was begun with another configuration: resume it with that, or give a new run id")
        began = own.get("created_at") or dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        return self.set(run_id=self.run, config_hash=h, config=config, count=count, created_at=began, status="running")

    def live_status(self, completed: int, failed: int, elapsed_s: float, every: int = 50) -> bool:
        """Writes the run's progress at the first and last task and every ``every`` ones (T5)."""
        count = int(self.read().get("count", 0))
        due = completed + failed in (1, count) or (completed + failed) % every == 0
        if due:
            self.set(progress=progress(completed, failed, count, elapsed_s))
        return due


def latest_resumable(root: str) -> str | None:
    """The newest run that is not completed."""
    runs = [(i.mtime_ns, i.base_name[:-5]) for i in store.entries(f"{root.rstrip('/')}/runs") if i.base_name.endswith(".json")]
    return next((r for _, r in sorted(runs, reverse=True) if RunMeta(root, r).read().get("status") != "completed"), None)
