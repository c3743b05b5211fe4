"""Sinks (K1, K2, K4): tables and dashboard sections.

Writes are plain DataFrame writers: parallel, one file per task, atomic commit
through the output committer. Nothing is collected to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import order as O
from . import folders


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, sort_by: list | None = None) -> None:
    """K1/K4: write a table. ``sort_by`` range-partitions and sorts so the files,
    read in name order, hold the rows in that order (a sorted export without
    a single-task sort)."""
    out = df
    if sort_by:
        out = out.orderBy(*sort_by)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_relabelled(df: DataFrame, path: str, source_path: str | None = None) -> None:
    """K4: the relabelled readings go to a *new* path (Spark cannot overwrite
    a path that the same plan is reading)."""
    if source_path and path.rstrip("/") == source_path.rstrip("/"):
        raise ValueError("write the relabelled table to a new path, not over its input")
    write_table(df, path)


def write_sections(sections: dict[str, DataFrame], root: str) -> None:
    """K2: one JSON-lines table per dashboard section under ``root/<name>``."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def section_document(df: DataFrame, name: str) -> DataFrame:
    """K2 for a bounded section: the section as one JSON string (one row).

    Only for sections whose size is bounded by construction (top-k lists,
    per-level counts); never for a per-reading table.
    """
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))


# --- K2/S5 for sections that grow: chunks in order, with a manifest ----------------------

CHUNK_ROWS = 50_000
MANIFEST_SCHEMA = "chunk long, first_row long, n_rows long, digest long"


def _chunk_counts(spark: SparkSession, path: str, rows_per_chunk: int) -> DataFrame:
    """The manifest rows of the chunks that are there: rows and the XOR of their lines' hashes, each."""
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{path}/chunks").select(
        "value", F.regexp_extract(F.col("_metadata.file_path"), "/chunk=([0-9]+)/[^/]*$", 1).cast("long").alias("chunk"))
    return lines.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64("value")).alias("digest")).select(
        "chunk", (F.col("chunk") * rows_per_chunk).alias("first_row"), "n_rows", "digest")


def write_chunked(df: DataFrame, path: str, order: list[str], rows_per_chunk: int = CHUNK_ROWS) -> None:
    """K2: a section of any size as an ordered JSON document in chunks, with a manifest.

    Rows get their 0-based ``position`` in ``order`` (which must be total), and chunk k holds
    positions k * ``rows_per_chunk`` and up as JSON lines in order, in one file
    ``chunks/chunk=<k>/``, whatever the partitions of ``df``. So a page is found without
    reading others, and no task holds more than a chunk. The manifest, written last, has one
    row a chunk (``MANIFEST_SCHEMA``); the header has the schema and the chunk size. An empty
    section has no chunks. A column called ``position`` is refused.
    """
    if "position" in df.columns:
        raise ValueError("the section already has a column called position")
    spark = df.sparkSession
    rows = O.row_index(df, order, "position").withColumn("chunk", F.floor(F.col("position") / rows_per_chunk).cast("long"))
    (rows.repartition("chunk").sortWithinPartitions("chunk", "position")
         .write.mode("overwrite").partitionBy("chunk").json(f"{path}/chunks"))
    header = {"rows_per_chunk": rows_per_chunk, "schema": json.loads(rows.drop("chunk").schema.json())}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    _chunk_counts(spark, path, rows_per_chunk).orderBy("chunk").write.mode("overwrite").json(f"{path}/manifest")


def read_chunked(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """A chunked section with its ``position`` and ``chunk``.

    ``verify`` compares the chunks with the manifest first, in one pass over their lines; a
    chunk that is missing, cut, changed or too many is a ValueError. Without a manifest the
    section was not written to its end: FileNotFoundError.
    """
    if not folders.exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no manifest in {path}")
    header = json.loads(spark.read.text(f"{path}/header").first()[0])
    size = header["rows_per_chunk"]
    if verify:
        listed, there = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest"), _chunk_counts(spark, path, size)
        both = listed.withColumn("side", F.lit(1)).unionByName(there.withColumn("side", F.lit(-1)))
        wrong = both.groupBy("chunk", "first_row", "n_rows", "digest").agg(F.sum("side").alias("d")).where("d <> 0")
        bad = sorted({r.chunk for r in wrong.limit(10).collect()}, key=str)
        if bad:
            raise ValueError(f"chunks {bad} of {path} differ from the manifest")
    rows = spark.read.option("recursiveFileLookup", "true").schema(T.StructType.fromJson(header["schema"])).json(f"{path}/chunks")
    return rows.withColumn("chunk", F.floor(F.col("position") / size).cast("long"))
