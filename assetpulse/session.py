"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "assetpulse",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the local
    master is only a convenience for tests and the bench.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when unset (tests) make one.

    The folder must be shared storage on a cluster (HDFS/S3/...), which the
    cluster names in its config: without it a session on a cluster is an error.
    A machine-local folder is only made for a local master, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="assetpulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Reliable checkpoint to the shared folder, computing ``df`` once.

    An eager ``checkpoint()`` runs a count and then writes the data; the
    temporary cache makes the write read the counted partitions instead of
    recomputing them. The cache is dropped afterwards.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    Cuts the lineage, gives later plans true sizes, and survives the loss of
    executors. Later readers scan only the columns that they use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def open_folder(folder: str):
    """The file system and the path of a shared folder, for tasks that read its files without Spark's readers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


#: Rows that are worth a task of their own where every row is much work (walking a forest, training).
ROWS_PER_TASK = 20_000
#: Rows that a task holds at most when many small tasks are merged.
ROWS_PER_MERGED_TASK = 200_000


def even_tasks(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as its rows keep busy, for steps whose rows are few bytes but much work.

    Tasks follow the bytes of the files (a small file, or one row group, is one task) or the
    shuffle's setting (hundreds of nearly empty ones). Rows are dealt out anew when the
    fullest task holds over twice an even share of the cores, and merged when there are over
    twice as many tasks as that. A table of up to ``ROWS_PER_TASK`` rows stays as it is, and so does a stream.
    """
    if df.isStreaming:
        return df
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a row for each task
    n = sum(sizes)
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_TASK))
    if tasks <= 1:
        return df
    wanted = max(tasks, math.ceil(n / ROWS_PER_MERGED_TASK))
    if max(sizes) > 2 * n / tasks:
        return df.repartition(wanted)
    return df.coalesce(wanted) if len(sizes) > 2 * wanted else df
