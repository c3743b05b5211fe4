"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document that holds at least ``PERCENT`` of its distinct
five-word shingles. Documents may be thousands of times longer than an item, so
the sketch follows the item, not the document:

1. Items are partitioned by their number of shingles (powers of two). An item's
   MinHash sketch is its ``n - ceil(PERCENT n) + 1`` smallest shingle hashes: a
   document with the needed share of the item must hold one of them, so the
   search loses nothing. Each partition has one hash bound, its largest sketched
   value, and one least document size.
2. A document probes with those of its shingles that lie under the largest bound
   of the partitions that its size admits. Its other shingles are never looked up.
3. Each (document, item) found is verified by the exact shingle containment.

DataFrame functions only: no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise

PERCENT = 75
WORDS = 5
#: A sketch table of at most so many rows (of about 40 bytes) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` bound as a lambda variable, so that the optimiser cannot copy its expression."""
    return F.transform(F.array(value), use)[0]


def shingles(w: Column) -> Column:
    """Hashes of the successive five-word shingles of a word array; fewer words are one shingle."""
    return once(w, _shingles)


def _shingles(w: Column) -> Column:
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS)))
    return F.when(n >= WORDS, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def item_sets(items: DataFrame) -> DataFrame:
    """``(item_id, shingles, n, need, band)`` of items that have an id and words; rows of one item_id stay apart by text."""
    s = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(
        F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    s = s.select("item_id", F.array_distinct(shingles(F.col("w"))).alias("shingles")).withColumn("n", F.size("shingles"))
    return s.withColumn("need", F.ceil(F.col("n") * PERCENT / 100)).withColumn("band", F.floor(F.log2("n")).cast("int"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, item_shingles, shared)`` for every document that holds ``PERCENT`` of an item's shingles.

    ``docs(doc_id, text)``, ``items(item_id, text)``. Null or empty texts and
    null ids match nothing. Rows that repeat an id give one row a pair with the largest
    share. An item of fewer than five words matches only a document of exactly
    those words. Other columns are not read. Empty tables give no rows.
    """
    sets = materialise(item_sets(items), "items")
    sketch = materialise(sets.select("item_id", "band", "need", F.explode(
        F.slice(F.array_sort("shingles"), F.lit(1), (F.col("n") - F.col("need") + 1).cast("int"))).alias("h")), "sketch")
    bands = sketch.groupBy("band").agg(F.min("need").alias("need"), F.max("h").alias("bound")).orderBy("band").collect()  # 31 rows at most
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        "doc_id is not null and text is not null")
    least = F.lit(-(1 << 63)).cast("long")

    def probes(all_of: Column) -> Column:
        bound = least
        if bands:
            bound = F.greatest(least, *[F.when(F.size(all_of) >= b["need"], F.lit(b["bound"]).cast("long")) for b in bands])
        return F.struct(F.size(all_of).alias("size"),
                        once(bound, lambda top: F.filter(all_of, lambda h: h <= top)).alias("hs"))

    # explode_outer: an inner explode would have the optimiser compute the shingles twice, for a test of emptiness.
    probe = read.select("doc_id", once(shingles(words(F.col("text"))), probes).alias("p")).select(
        "doc_id", F.col("p.size").alias("size"), F.explode_outer("p.hs").alias("h"))
    found = F.broadcast(sketch) if sketch.count() <= BROADCAST_ROWS else sketch
    pairs = probe.join(found.drop("band"), "h").filter("size >= need").select("doc_id", "item_id").distinct()
    pairs = materialise(pairs, "candidates")
    whole = read.join(pairs, "doc_id").select("doc_id", "item_id", shingles(words(F.col("text"))).alias("all"))
    whole = whole.join(sets.select("item_id", "shingles", "n", "need"), "item_id")
    shared = F.size(F.array_intersect("shingles", "all"))
    return (whole.select("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles"), shared.cast("long").alias("shared"), "need")
            .filter("shared >= need").groupBy("doc_id", "item_id")
            .agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("share"), "item_shingles", "shared")).alias("x"))
            .select("doc_id", "item_id", "x.item_shingles", "x.shared"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item (all columns as they were; rows without doc_id stay)."""
    gone = contaminated(docs, items).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
