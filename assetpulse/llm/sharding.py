"""Sharding by sampled splitters.

1. Every record's size is known from one scan; a record enters the sample with a
   probability in proportion to its size, so the quantiles of the sampled keys
   cut the key space into ranges of about equal bytes. The sample holds about
   ``PER_RANGE`` keys for each range, whatever the table's size.
2. Records go to their range. A range that is overfull (one key may hold a third
   of all records) is subdivided by a row number dealt at the scan.
3. The bytes and rows of all ranges (one small row each) give every range its
   offset; within a range a running sum gives every record its exact place in
   the whole order. A shard is an equal share of all bytes in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise

RANGES_PER_SHARD = 8
PER_RANGE = 64
#: A range is overfull beyond so many times its share of the rows.
OVERFULL = 2


def splitters(rows: DataFrame, ranges: int, total: int, salt: int = 11) -> np.ndarray:
    """Quantile boundaries of a size-weighted sample of ``key``."""
    p = F.least(F.lit(1.0), F.col("size") * (ranges * PER_RANGE / max(total, 1)))
    u = (F.xxhash64("row", F.lit(salt)) / F.lit(2.0**64)) + 0.5
    keys = np.sort([r[0] for r in rows.filter((u < p) & F.col("key").isNotNull()).select("key").collect()])
    if not len(keys):
        return np.empty(0, np.int64)
    at = (np.arange(1, ranges) * len(keys)) // ranges
    cut, often = np.unique(keys[at], return_counts=True)
    return np.union1d(cut, cut[often > 1] + 1).astype(np.int64)  # a key over several quantiles gets its own range


def shard_by_bytes(records: DataFrame, shards: int) -> DataFrame:
    """``records(key long, size long, ...)`` with ``shard`` and ``slot``; law: bytes.

    Records lie in key order (null keys first, equal keys in any one order). A
    record goes to shard ``floor(bytes before it * shards / all bytes)``, so two
    shards' bytes differ by less than two records' sizes; slots count from 0 in
    the same order. Sizes must be positive; extra columns come along. An empty table
    gives no rows, and a table with fewer records than shards leaves shards empty.
    """
    rows = materialise(records.withColumn("row", F.monotonically_increasing_id()), "records")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = int(total or 0)
    ranges = shards * RANGES_PER_SHARD
    cut = splitters(rows.select("key", "size", "row"), ranges, total)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = part["key"].notna().to_numpy()
            key = part["key"].fillna(0).to_numpy(np.int64)
            part["range"] = np.where(known, np.searchsorted(cut, key, side="right") + 1, 0)
            yield part[["row", "key", "size", "range"]]

    placed = rows.select("row", "key", "size").mapInPandas(place, "row long, key long, size long, range long")
    # The least and largest key tell an overfull range of one key (cut by row)
    # from one that a further key boundary would cut.
    fill = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"),
                                       F.min("key").alias("lo"), F.max("key").alias("hi"))
    limit = max(1, OVERFULL * (count or 0) // max(ranges, 1))
    fill = fill.withColumn("parts", F.ceil(F.col("n") / limit))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    width = (F.col("hi") - F.col("lo")) / F.col("parts") + 1
    sub = F.when(F.col("parts") == 1, 0).when(one, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(
        F.floor((F.col("key") - F.col("lo")) / width))
    placed = placed.join(F.broadcast(fill.select("range", "lo", "hi", "parts")), "range").withColumn(
        "sub", sub.cast("long")).select("row", "key", "size", "range", "sub")
    sums = placed.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    # At most (1 + 1 / OVERFULL) * ranges rows, whatever the table's size.
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                          F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("range", "sub").orderBy(F.col("key").asc_nulls_first(), "row")
    ran = placed.withColumn("b", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ran = ran.withColumn("c", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["range", "sub"])
    shard = F.least(F.floor((F.col("b0") + F.col("b")) * shards / F.lit(max(total, 1))), F.lit(shards - 1))
    ran = materialise(ran.select("row", shard.cast("int").alias("shard"), (F.col("c0") + F.col("c")).alias("at")), "places")
    first = ran.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    ran = ran.join(F.broadcast(first), "shard").select("row", "shard", (F.col("at") - F.col("first")).alias("slot"))
    return rows.join(ran, "row").drop("row")


def document_records(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, size, text_crc32)``; a null text has no bytes and the crc of the empty text."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                       (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
