"""Chat formatting after collapsing cumulative snapshots of conversations.

Logs often hold a conversation several times, each copy longer by some turns.
A rolling hash of (position, role, text) names every turn prefix. A conversation
whose whole hash is a proper prefix of a longer one is removed by an anti-join, and of
equal conversations the smallest conv_id stays. What remains is rendered turn by turn.

The rolling hash is a prefix sum, so it needs no task that holds a whole
conversation: turns are range-partitioned by (conversation, turn), summed inside
each range, and a conversation that crosses ranges gets the sums of the ranges
before (at most one conversation crosses each range border).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise

#: A turn's rendering; a conversation's is its turns' renderings in a row.
TEMPLATE = "<|im_start|>%s\n%s<|im_end|>\n"
_SUMS = ["position", "high", "low"]


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, position, high, low)``: each turn's place (from 1) and rolling prefix hash."""
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    read = read.filter("conv_id is not null").withColumn("own", F.xxhash64("role", "text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("own")]
    rows = materialise(read.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "turns")

    def carried(df: DataFrame, columns: dict) -> DataFrame:
        """Running sums of ``columns`` over each conversation, across its ranges."""
        run = Window.partitionBy("range", "conv_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
        inside = df.select("*", *[F.sum(x).over(run).alias(f"_{k}") for k, x in columns.items()])
        per = df.groupBy("conv_id", "range").agg(*[F.sum(x).alias(f"+{k}") for k, x in columns.items()])
        # Conversations in several ranges: at most one for each range border.
        spread = per.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
        before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        more = per.join(F.broadcast(spread), "conv_id").select(
            "conv_id", "range", *[F.coalesce(F.sum(f"+{k}").over(before), F.lit(0)).alias(f"+{k}") for k in columns])
        out = inside.join(F.broadcast(more), ["conv_id", "range"], "left")
        return out.select(*df.columns, *[(F.col(f"_{k}") + F.coalesce(f"+{k}", F.lit(0))).alias(k) for k in columns])

    placed = carried(rows, {"position": F.lit(1)})
    h = F.xxhash64("own", "position")
    # Two sums of 32-bit halves: no overflow below 2**31 turns.
    placed = placed.withColumn("h1", F.shiftrightunsigned(h, 32)).withColumn("h2", h.bitwiseAND(F.lit((1 << 32) - 1)))
    return carried(placed, {"high": F.col("h1"), "low": F.col("h2")}).drop("range", "own", "h1", "h2")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of conversations that are no prefix of another and no copy of one with a smaller conv_id."""
    lengths = prefixes.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    marked = prefixes.select("conv_id", *_SUMS).join(lengths, "conv_id")
    whole = marked.filter("position = n_turns").groupBy(*_SUMS).agg(F.min("conv_id").alias("conv_id"))
    proper = marked.filter("position < n_turns").select(*_SUMS).distinct()
    return whole.join(proper, _SUMS, "left_anti").select("conv_id", F.col("position").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, position, role, rendered)`` for every turn of the maximal conversations.

    A conversation's turns are its rows in the order of ``turn`` (null first, ties in
    an order that their contents fix; repeated rows are turns of their own). Null
    roles and texts count as empty. Rows without conv_id belong to no conversation
    and are not rendered. Other columns are not read. An empty table gives no rows.
    """
    prefixes = materialise(turn_prefixes(conversations), "prefixes")
    keep = materialise(maximal_conversations(prefixes), "maximal")
    return prefixes.join(keep, "conv_id").select(
        "conv_id", "n_turns", "position", "role", F.format_string(TEMPLATE, "role", "text").alias("rendered"))
