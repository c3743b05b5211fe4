"""Merkle manifest of a table: built level by level, proved by a recursive climb.

Leaves stand in one global order (source, then doc_id). Each source is a tree of
runs of ``FANOUT`` nodes, its subroot is a leaf of the tree above, whose top is the
root. Every node therefore covers a range of the global order.

1. Levels are built by grouping nodes with their run, one level after another. A
   node row holds its children's digests side by side and the name of its parent
   with its own place there.
2. A Spark recursive query climbs those links from the bottom: each step joins a
   climber with its parent, appends the siblings to the proof, and folds the leaf's
   digest with them. The leaves of one bottom run climb in one row, each with its
   own folded digest, because they have all siblings above the run in common.
3. Upper nodes have many leaves below them. A node is stored once for each block
   of ``BLOCK`` leaves that it covers and climbers join by (block, node), so no join
   key has more than ``BLOCK`` climbers, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.shared import materialise
from assetpulse.operators.order import row_index

FANOUT = 16
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree over the sources are numbered from here.
_UPPER = 100
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers decimal)."""
    def written(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def lowered(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c.cast("string"), _CAPITALS, _SMALL)


@dataclass
class Manifest:
    """``runs``: the bottom runs with their leaves; ``nodes``: all levels above, parent-linked, by block; the root digest."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None


def _levels(count: int) -> int:
    """Levels above ``count`` nodes up to the one that is left."""
    n = 0
    while count > 1:
        count, n = -(-count // FANOUT), n + 1
    return n


def _children(hashes: Column) -> Column:
    """Digests (hex, in order) side by side as binary."""
    return F.unhex(F.array_join(hashes, ""))


def _digest(children: Column) -> Column:
    return F.sha2(F.lower(F.hex(children)), 256)


def _by_source(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (``idx`` is the global place) with their source's number, first place and size; and one row a source."""
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    # One row for each source in each block: what is joined by source alone stays small for any source.
    parts = leaves.groupBy(block.alias("block"), "source").agg(F.min("idx").alias("lo"), F.count("*").alias("c"))
    parts = materialise(parts, "parts")
    sources = parts.groupBy("source").agg(F.min("lo").alias("start"), F.sum("c").alias("n"))
    sources = materialise(row_index(sources, ["start"], "s"), "sources")
    named = parts.select("block", F.col("source").alias("in_source")).join(
        sources, F.col("in_source").eqNullSafe(F.col("source"))).drop("source")
    joined = leaves.withColumn("at_block", block).join(
        named, (F.col("at_block") == F.col("block")) & F.col("source").eqNullSafe(F.col("in_source")))
    return joined.drop("at_block", "block", "in_source"), sources


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves(doc_id, source, leaf, changed)``: ``leaf`` as a hex digest.

    Per source leaves ascend by doc_id (null first; rows of one doc_id by their
    digest, so repeated rows are leaves of their own); sources ascend bytewise, null first.
    ``changed`` is what the climb folds in place of ``leaf``. An empty table has no root.
    """
    numbered = materialise(row_index(materialise(leaves.select("doc_id", "source", "leaf", "changed"), "leaves"),
                                     ["source", "doc_id", "leaf"], "idx"), "numbered")
    named, sources = _by_source(numbered)
    many, most = sources.agg(F.count("*"), F.max("n")).first()
    place = F.col("idx") - F.col("start")
    members = F.sort_array(F.collect_list(F.struct("idx", "doc_id", "leaf", "changed")))  # at most FANOUT
    runs = named.groupBy("s", "start", "n", F.floor(place / FANOUT).cast("long").alias("pos")).agg(members.alias("members"))
    runs = runs.withColumn("children", _children(F.col("members.leaf"))).withColumn(
        "hash", F.when(F.col("n") == 1, F.col("members")[0]["leaf"]).otherwise(_digest(F.col("children"))))

    def linked(level: DataFrame, k: int) -> DataFrame:
        """Nodes of level ``k`` of the sources' trees with their range, parent and subroot."""
        width = FANOUT**k
        top = F.col("n") <= width
        above = F.lit(_UPPER + 1) if many > 1 else F.lit(None)
        return level.withColumns({
            "lo": F.col("start") + F.col("pos") * width, "hi": F.least(F.col("start") + F.col("n"), F.col("start") + (F.col("pos") + 1) * width),
            "level": F.lit(k), "number": F.col("start") + F.col("pos") * width,
            "place": F.when(top, F.col("s") % FANOUT).otherwise(F.col("pos") % FANOUT).cast("int"),
            "parent_level": F.when(top, above).otherwise(F.lit(k + 1)).cast("int"),
            "parent": F.when(top, F.floor(F.col("s") / FANOUT)).otherwise(
                F.col("start") + F.floor(F.col("pos") / FANOUT) * (FANOUT * width)).cast("long"),
            "subroot": F.when(top, F.col("hash"))})

    runs = materialise(linked(runs, 1), "runs")
    grown = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    below, levels = runs, []
    for k in range(2, max(1, _levels(most or 0)) + 1):
        level = below.filter("subroot is null").select("s", "start", "n", F.floor(F.col("pos") / FANOUT).cast("long").alias("parent_pos"), "pos", "hash")
        level = level.groupBy("s", "start", "n", "parent_pos").agg(grown.alias("held")).withColumnRenamed("parent_pos", "pos")
        level = level.withColumn("children", _children(F.col("held.hash"))).withColumn("hash", _digest(F.col("children"))).drop("held")
        below = materialise(linked(level, k), "nodes")
        levels.append(below)
    tops = [x.filter("subroot is not null").select(F.col("s").alias("pos"), "hash", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
            for x in [runs, *levels]]
    upper = tops[0]
    for x in tops[1:]:
        upper = upper.union(x)
    left = many
    for u in range(1, _levels(many) + 1):
        left = -(-left // FANOUT)
        upper = upper.groupBy(F.floor(F.col("pos") / FANOUT).cast("long").alias("parent_pos")).agg(
            grown.alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumnRenamed("parent_pos", "pos")
        upper = upper.withColumn("children", _children(F.col("held.hash"))).withColumn("hash", _digest(F.col("children"))).drop("held")
        upper = materialise(upper.withColumns({
            "level": F.lit(_UPPER + u), "number": F.col("pos"), "place": (F.col("pos") % FANOUT).cast("int"),
            "parent_level": (F.lit(_UPPER + u + 1) if left > 1 else F.lit(None)).cast("int"),
            "parent": F.floor(F.col("pos") / FANOUT).cast("long"), "subroot": F.lit(None).cast("string")}), "upper")
        levels.append(upper)
    root = upper.select("hash").first()  # one row is left
    columns = ["level", "number", "children", "place", "parent_level", "parent", "subroot"]
    nodes = None
    for x in levels:
        x = x.select(F.explode(F.sequence(F.floor(F.col("lo") / BLOCK).cast("long"), F.floor((F.col("hi") - 1) / BLOCK).cast("long"))).alias("block"), *columns)
        nodes = x if nodes is None else nodes.union(x)
    return Manifest(runs, materialise(nodes, "tree") if nodes is not None else None, root[0] if root else None)


#: A climber: its block and run, where it goes next, the digests folded so far (one a leaf), the siblings passed.
_ANCHOR = """
SELECT floor(lo / {block}) AS block, lo, parent_level AS level, parent AS number, place, subroot, CAST('' AS BINARY) AS proof,
       transform(members, (m, i) -> CASE WHEN n = 1 THEN unhex(m.changed) ELSE unhex(sha2(concat(
         lower(hex(substring(children, 1, 32 * i))), m.changed, lower(hex(substring(children, 32 * i + 33)))), 256)) END) AS folded
FROM {runs}"""

_CLIMB = """
WITH RECURSIVE climb(block, lo, level, number, place, subroot, proof, folded) AS (
  SELECT block, lo, level, number, place, subroot, proof, folded FROM {start}
  UNION ALL
  SELECT c.block, c.lo, n.parent_level, n.parent, n.place, coalesce(c.subroot, n.subroot),
         concat(c.proof, substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33)),
         transform(c.folded, f -> unhex(sha2(concat(lower(hex(substring(n.children, 1, 32 * c.place))), lower(hex(f)),
                                                    lower(hex(substring(n.children, 32 * c.place + 33)))), 256)))
  FROM climb c JOIN {nodes} n ON n.block = c.block AND n.level = c.level AND n.number = c.number
)
SELECT lo, subroot, proof, folded FROM climb WHERE level IS NULL"""


def climb(tree: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf of a manifest.

    ``proof_sha256`` is H of the siblings from the leaf's run to the root,
    ``folded_root`` the root recomputed from the leaf's ``changed`` digest and those
    siblings, ``verified`` whether it is the root.
    """
    spark = tree.runs.sparkSession
    start = spark.sql(_ANCHOR, runs=tree.runs, block=BLOCK)
    if tree.nodes is None:  # one run is the whole table
        top = start.select("lo", "subroot", "proof", "folded")
    else:
        limit = spark.conf.get(_ROW_LIMIT)
        spark.conf.set(_ROW_LIMIT, "-1")  # a climber for each run and level, however many
        try:
            top = materialise(spark.sql(_CLIMB, start=start, nodes=tree.nodes), "climbed")
        finally:
            spark.conf.set(_ROW_LIMIT, limit)
    rows = tree.runs.select("lo", "members", "children").join(top, "lo").select(
        "children", "subroot", "proof", "folded", F.posexplode("members").alias("i", "m"))
    own = F.expr("concat(substring(children, 1, 32 * i), substring(children, 32 * i + 33), proof)")
    folded = F.lower(F.hex(F.expr("folded[i]")))
    root = F.lit(tree.root).cast("string")
    return rows.select("m.doc_id", "m.leaf", "subroot", root.alias("root"), F.sha2(F.lower(F.hex(own)), 256).alias("proof_sha256"),
                       folded.alias("folded_root"), (folded == root).alias("verified"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with a tampering trial: text is lower-cased where 5 divides crc32 of the doc_id.

    Rows as in ``climb``. Nulls in any field are part of the digest (``-``); a row without
    doc_id is not tampered with. Rows that repeat are leaves of their own. Other columns are
    not read. An empty table gives no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf_digest([*fields[:-1], lowered(fields[-1])]))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         leaf_digest(fields).alias("leaf"), changed.alias("changed"))
    return climb(build(leaves.withColumn("changed", F.coalesce("changed", "leaf"))))
