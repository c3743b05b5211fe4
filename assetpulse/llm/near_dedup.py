"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles, hashed once to 64 bits;
its sketch is the ``SKETCH`` smallest hashes (the whole set where it is smaller).

1. Documents with equal sets collapse to one class before anything is paired, so
   a group of copies costs one class however large it is.
2. The retained values form inverted lists. A pair at the threshold shares at
   least ``OVERLAP`` of them (see below), so a class need only stand in the lists
   of its ``r - OVERLAP + 1`` rarest retained values: passages that many
   documents share drop out without losing a pair.
3. In a list nobody is paired with everybody. Members are compared with the
   list's leader, the member that retains most of what others retain; those that
   link are one component already and need no further comparison. Lists that
   still hold several components get other leaders for a second round. What then
   stands in a mixed list is searched exactly: inverted lists over the rarest
   quarter of each class's *full* set (a pair at the threshold must share one of
   those), where members outside a list's largest component meet the members of
   other components. Documents around one common passage have that passage among
   their more frequent shingles, so it makes no list here.
4. A candidate pair is estimated from the union sketch (the smallest ``SKETCH``
   values of both sketches together), and what may reach the threshold is
   verified by the exact Jaccard similarity of the full sets from whole texts.

Where both sets fit into their sketches the search is exact. Otherwise a pair at
the threshold shares fewer than ``OVERLAP`` = 30 of 64 union values with a
probability of about 4e-7 (a binomial tail; drawing without replacement is tighter,
and a higher similarity makes it vanish).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetpulse.llm import textscan
from assetpulse.llm.components import connected_components
from assetpulse.llm.shared import bounded_batches, give_back, materialise

SKETCH = 64
OVERLAP = 30
LEADERS = 2
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
_SIGN = np.uint64(1 << 63)


def _sketches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        n, digest, sketch = [], [], []
        for _, run in textscan.slices(part["text"]):
            for s in textscan.shingle_sets(run):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append((s[:SKETCH] ^ _SIGN).view(np.int64))
        yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": n, "digest": digest, "sketch": sketch})
        give_back()


def shingle_sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest, sketch)`` per row: set size, set digest, smallest hashes in order."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        _sketches, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _classes(sketches: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: its smallest doc_id, size and sketch."""
    return (sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("digest")
            .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")))


def _lists(classes: DataFrame, values: str, must: Column) -> DataFrame:
    """Inverted lists ``(value, rep, n, central)`` over each class's rarest ``values``.

    A pair that shares ``must`` values shares one of the rarest ``size - must + 1``
    of either. ``central`` is high for classes whose values others hold too.
    """
    postings = classes.select("rep", "n", F.size(values).alias("r"), F.explode(values).alias("value"))
    often = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    # Values that only one class holds are its rarest ones: they take up places
    # but link nothing, so only their number is needed.
    shared = (postings.join(often, "value").groupBy("rep", "n", "r")
              .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held")))  # one class's own values
    places = F.size("held") - must + 1
    central = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    prefix = F.slice("held", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    return shared.select("rep", "n", central.alias("central"), (F.col("r") - F.size("held") + 1).alias("before"),
                         F.posexplode(prefix).alias("at", "x")).select(
        F.col("x.value").alias("value"), "rep", "n", "central", (F.col("before") + F.col("at")).alias("place"))


def _full_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sets = [s.view(np.int64) for _, run in textscan.slices(part["text"]) for s in textscan.shingle_sets(run)]
        yield pd.DataFrame({"rep": part["doc_id"], "n": [len(x) for x in sets], "shingles": sets})
        give_back()


def _exact_lists(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Lists over the rarest quarter of the full sets of ``reps``."""
    sets = texts.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        "doc_id", "text").mapInPandas(_full_sets, "rep long, n long, shingles array<long>")
    return _lists(sets, "shingles", F.ceil(F.col("n") * PERCENT / 100))


def _mixed(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The lists that hold several components, with each member's component."""
    if comp is None:
        now = lists.withColumn("comp", F.col("rep"))
    else:
        now = lists.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "comp", F.coalesce("component", "rep")).drop("component")
    mixed = now.groupBy("value").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l != h")
    return materialise(now.join(mixed.select("value"), "value", "left_semi"), "mixed")


def _sized(pairs: DataFrame) -> DataFrame:
    return pairs.filter("100 * least(na, nb) >= {0} * greatest(na, nb)".format(PERCENT)).select(
        F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a != b").distinct()


def _leader_pairs(lists: DataFrame, salt: int | None) -> DataFrame:
    order = -F.col("central") if salt is None else F.xxhash64("rep", "value", F.lit(salt))
    lead = lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), "rep", "n", "comp")).alias("lead"))
    return _sized(lists.join(lead, "value").filter("comp != lead.comp").select(
        F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("lead.rep").alias("rb"), F.col("lead.n").alias("nb")))


def _remaining_pairs(lists: DataFrame) -> DataFrame:
    """Pairs across a list's components, found from its members outside the largest one.

    At a pair's first shared value, counted from the rarest, everything rarer is
    unshared on both sides; what follows must still hold the needed overlap.
    """
    per = lists.groupBy("value", "comp").agg(F.count("*").alias("c"))
    main = per.groupBy("value").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    side = lambda k: [F.col(c).alias(f"{c[0]}{k}") for c in ("rep", "n", "comp", "place")]
    few = lists.join(main, "value").filter("comp != main").select("value", *side("a"))
    every = lists.select(F.col("value").alias("v"), *side("b"))
    need = f"ceil({PERCENT} * (na + nb) / {100 + PERCENT}.0)"
    return _sized(few.join(every, F.expr(f"value = v and ca != cb and na - pa + 1 >= {need} and nb - pb + 1 >= {need}")))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose union sketch allows the threshold."""
    side = classes.select("rep", "sketch")
    x = (pairs.join(side.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
         .join(side.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b"))
    union = F.sort_array(F.array_union("sa", "sb"))
    x = x.withColumn("low", F.slice(union, 1, SKETCH)).withColumn("all", F.size(union))
    same = F.size(F.array_intersect(F.array_intersect("low", "sa"), F.col("sb")))
    exact = F.col("all") <= SKETCH
    return x.filter(F.when(exact, 100 * same >= PERCENT * F.col("all")).otherwise(same >= OVERLAP)).select("a", "b")


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        keep, last, left = [], None, np.empty(0, np.uint64)
        for ta, tb in zip(part["ta"], part["tb"], strict=True):
            if ta != last:
                last, left = ta, textscan.shingle_sets([ta.encode("utf-8", "surrogatepass")])[0]
            right = textscan.shingle_sets([tb.encode("utf-8", "surrogatepass")])[0]
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(left) + len(right) - both))
        yield part.loc[np.asarray(keep, bool), ["a", "b"]]
        give_back()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    x = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
         .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"))
    return x.select("a", "b", "ta", "tb").mapInPandas(_verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links (the document's
    own where it has none) and ``kept`` marks that document. Null, empty and
    word-less texts have no shingles and link with nothing. Rows that repeat a
    doc_id count as one document. A row without doc_id cannot be referred to: it
    links with nothing, its component is null and it is kept. Other columns are
    not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sketches = materialise(shingle_sketches(docs), "sketches")
    classes = materialise(_classes(sketches), "classes")
    must = F.least(F.lit(OVERLAP), F.ceil(F.col("n") * PERCENT / 100))
    lists = materialise(_lists(classes, "sketch", must), "lists")
    texts, links, comp = None, None, None
    for step in range(LEADERS + 1):
        lists = _mixed(lists, comp)
        if lists.isEmpty():
            break
        if texts is None:
            wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            members = lists.select(F.col("rep").alias("doc_id")).distinct()
            texts = materialise(wanted.join(members, "doc_id", "left_semi"), "texts")
        if step < LEADERS:
            pairs = _leader_pairs(lists, step or None)
        else:
            pairs = _remaining_pairs(_mixed(_exact_lists(texts, lists), comp))
        pairs = materialise(_estimated(pairs, classes), "pairs")
        if not pairs.isEmpty():
            found = _verified(pairs, texts)
            links = materialise(found if links is None else links.union(found), "links")
            comp = materialise(connected_components(links), "components")
        lists = lists.drop("comp")
    named = classes.select("digest", "rep")
    if comp is not None:
        named = named.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
            "digest", F.coalesce("component", "rep").alias("rep"))
    rows = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id (null last), all columns as they were.

    Rows are compared one by one, so of rows that repeat a doc_id, and of equal
    rows without one, one stays too. Rows without words are in no group and stay.
    """
    number = "row"
    while number in docs.columns:
        number += "_"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    id_of = F.col("doc_id").cast("long")
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(number), "component_id").join(rows.select(number, id_of.alias("doc_id")), number)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", number)).alias("first"))
    stay = first.select(F.col("first")[number].alias(number))
    return rows.join(stay, number, "left_semi").select(*docs.columns)
