"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.shared import drop, materialise


def _is_star(edges: DataFrame) -> bool:
    """Every node is either a centre or hangs on exactly one centre."""
    roles = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))).alias("r")).select("r.*")
    per = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return per.filter("leaf > 1 or (leaf >= 1 and centre = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps: each node hands its larger,
    then its smaller neighbours on to its smallest one. A step is two aggregated
    shuffles over the edges, and the number of steps grows with the logarithm of
    a component's size. Hub nodes are joined, never collected. Null ends, loops
    and repeated edges are ignored; no edges give no rows.
    """
    e = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    e = materialise(e, "edges")
    while not _is_star(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (e.join(low.withColumnRenamed("u", "k"), F.col("v") == F.col("k"))
                 .select("u", F.col("m").alias("v")).distinct())
        large = materialise(large, "edges")
        drop(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = materialise(small, "edges")
        drop(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())
