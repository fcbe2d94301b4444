"""Session builder, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "annolake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for (AQE and skew joins on, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may fall back to a
    folder of its own; on a cluster a missing setting is an error, as a machine-local path would
    lose data with its executor."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if sc.master.startswith("local[") or sc.master == "local":
            d = sc._jsc.sc().getCheckpointDir()
            d = d.get() if d.isDefined() else ""
            if not d:
                d = tempfile.mkdtemp(prefix="annolake-")
                atexit.register(shutil.rmtree, d, True)
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: a folder shared by all executors is needed")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d if "://" in d or d.startswith("file:") else f"file://{os.path.abspath(d)}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex[:12]}/{name}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """Shuffles rows over all cores only where the input comes in fewer pieces than there are cores
    (one small file, say); larger inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
