"""Intermediate tables in the shared folder, and the limit on what reaches a Python worker at once."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from assetpulse.session import materialise, scratch  # noqa: F401 (the operators take them from here)


#: Bytes of one batch of rows that Spark hands to a Python worker (at least one row).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches by bytes where long texts travel; a tighter setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's freed memory to the system: between its tasks the executor's own work needs it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
