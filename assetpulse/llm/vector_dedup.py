"""Embedding near-dedup by product quantisation.

Unit vectors lie in coarse inverted lists (the nearest of ``lists`` centroids);
within a list a vector is stored as the codes of its residual in ``SUBSPACES``
subspaces, with its exact quantisation error. A query compares its own residual
with the codes by table lookup (asymmetric distance) and reranks what remains by
the exact cosine. Both steps before the rerank are bounds, so nothing is lost:

- cosine >= c means a distance of at most r = sqrt(2 - 2c). A list can hold such a
  vector only if the query lies within r of each plane that halves the way
  between the list's centroid and another. The planes to the query's own centroid
  and to the list's ``PLANES`` nearest ones are tried; all lists left are probed.
  The bound holds from both ends of a pair, so a query probes its own list and
  those of higher number.
- the true distance is at least the looked-up distance less the stored error.

Only equal labels (and equal dimensions) meet. Equal vectors of one label are one
class with a multiplicity. Large lists are cut into blocks, and each pair of
blocks is one task's work that returns link counts and a forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetpulse.llm.components import connected_components
from assetpulse.llm.shared import materialise

COSINE = 0.98
#: Vectors that the centroids are fitted on (every vector is indexed); centroids of the coarse and the sub quantisers.
SAMPLE = 16_384
MAX_LISTS = 1024
PER_LIST = 256
SUBSPACES = 8
CODES = 64
BLOCK = 1024
#: Neighbouring centroids whose planes bound a list.
PLANES = 16


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and residual codebooks for vectors padded to one width."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = _kmeans(sample, lists)
        own = np.argmin((self.coarse**2).sum(1) - 2 * sample @ self.coarse.T, axis=1)
        rest = self._split(sample - self.coarse[own])
        self.books = [_kmeans(rest[:, m], CODES, seed=m) for m in range(SUBSPACES)]
        gap = ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2) if len(self.coarse) <= 128 else (
            (self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * self.coarse @ self.coarse.T)
        self.gap = np.sqrt(np.maximum(gap, 0))
        self.beside = np.argsort(self.gap, axis=1, kind="stable")[:, 1 : PLANES + 1]

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), SUBSPACES, -1)

    def index(self, x: np.ndarray, radius: float):
        """Per vector: its list, codes, quantisation error, and the lists to probe."""
        d = np.maximum((x * x).sum(1)[:, None] + (self.coarse**2).sum(1) - 2 * x @ self.coarse.T, 0)
        own = np.argmin(d, axis=1)
        rest = self._split(x - self.coarse[own])
        codes = np.empty((len(x), SUBSPACES), np.uint8)
        error = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = ((rest[:, m, None] - book[None]) ** 2).sum(2)
            codes[:, m] = np.argmin(part, axis=1)
            error += part.min(1)
        away = d - d[np.arange(len(x)), own][:, None]
        lists = np.arange(len(self.coarse))
        probe = (away <= 2 * radius * self.gap[own] + 1e-9) & (lists >= own[:, None])
        for other in self.beside.T:
            probe &= d - d[:, other] <= 2 * radius * self.gap[lists, other] + 1e-9
        return own, codes, np.sqrt(error), probe

    def lookup(self, x: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded vectors of one list."""
        rest = self._split(x - self.coarse[list_no])
        out = np.zeros((len(x), len(codes)))
        for m, book in enumerate(self.books):
            out += ((rest[:, m, None] - book[None]) ** 2).sum(2)[:, codes[:, m]]
        return np.sqrt(out)


def _units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        unit, digest, dim = [], [], []
        for v, label, key in zip(part["embedding"], part["label"], part["vec_id"], strict=True):
            x = None
            if v is not None and len(v) and not pd.isna(label) and not pd.isna(key):
                x = np.array([np.nan if e is None else e for e in v], np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max()
                    norm = np.linalg.norm(x / top) if np.isfinite(x).all() and top > 0 else 0.0
                x = x / top / norm if norm > 0 else None
            unit.append(None if x is None else x.tobytes())
            digest.append(None if x is None else hashlib.blake2b(unit[-1], digest_size=16).digest())
            dim.append(0 if x is None else len(x))
        yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "dim": dim, "digest": digest, "unit": unit})


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column):
        v = np.frombuffer(raw, np.float64)
        out[i, : len(v)] = v
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node of each node over the pairs (a, b)."""
    low = np.arange(n)
    while True:
        old = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == old).all():
            return low


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and their cosine in double precision is
    at least ``cosine`` (0 < cosine <= 1). Null, empty and zero vectors, vectors with null or
    non-finite components, and rows without label or vec_id link with nothing. Rows that
    repeat a vector count as further vectors. A row without vec_id has a null
    component and is kept. Other columns are not read; no rows give no rows.
    """
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("string").alias("label"))
    rows = materialise(read.mapInPandas(_units, "vec_id long, label string, dim int, digest binary, unit binary"), "vectors")
    classes = materialise(rows.filter("unit is not null").groupBy("label", "digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit"), F.min("dim").alias("dim")), "classes")
    count, width = classes.agg(F.count("*"), F.max("dim")).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    width = -(-width // SUBSPACES) * SUBSPACES
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sample = classes.select("unit").orderBy(F.xxhash64("digest"), "label").limit(SAMPLE).collect()  # SAMPLE vectors
    made = Quantiser(_matrix([r[0] for r in sample], width), max(1, min(MAX_LISTS, count // PER_LIST)))
    shared = vectors.sparkSession.sparkContext.broadcast(made)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for whole in parts:
            for at in range(0, len(whole), BLOCK):
                part = whole.iloc[at : at + BLOCK].copy()
                own, codes, error, probe = q.index(_matrix(part["unit"], width), radius)
                part["home"] = own
                part["list"], part["codes"], part["error"] = own, [c.tobytes() for c in codes], error
                part["probes"] = [np.flatnonzero(p).astype(np.int32) for p in probe]
                yield part[["rep", "copies", "label", "dim", "unit", "home", "list", "codes", "error", "probes"]]

    indexed = materialise(classes.select("rep", "copies", "label", "dim", "unit").mapInPandas(
        index, "rep long, copies long, label string, dim int, unit binary, home int, list int, codes binary, error double, probes array<int>"), "index")
    cell = ["label", "dim", "list"]
    entries = indexed.drop("probes").withColumn("entry", F.lit(True))
    queries = indexed.withColumn("list", F.explode("probes")).drop("probes").withColumn("entry", F.lit(False))
    blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    cells = materialise(blocks(entries, "eblocks").join(blocks(queries, "qblocks"), cell), "cells")
    salt = lambda name: F.pmod(F.xxhash64("rep"), F.col(name))
    to = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    entries = entries.join(cells, cell).withColumn("eb", salt("eblocks")).withColumn("qb", to("qblocks"))
    queries = queries.join(cells, cell).withColumn("qb", salt("qblocks")).withColumn("eb", to("eblocks"))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        e, q = part[part["entry"]], part[~part["entry"]]
        empty = pd.DataFrame({"node": [], "weight": [], "root": []}, dtype="int64")
        if not len(e) or not len(q):
            return empty
        ev, qv = _matrix(e["unit"], width), _matrix(q["unit"], width)
        codes = np.frombuffer(b"".join(e["codes"]), np.uint8).reshape(len(e), SUBSPACES)
        er, qr = e["rep"].to_numpy(np.int64), q["rep"].to_numpy(np.int64)
        near = shared.value.lookup(qv, int(part["list"].iloc[0]), codes) - e["error"].to_numpy()[None] <= radius + 1e-7
        inside = q["home"].to_numpy() == q["list"].to_numpy()  # each pair once: within a list the smaller id asks
        a, b = np.nonzero(near & (~inside[:, None] | (qr[:, None] < er[None])))
        hit = (qv[a] * ev[b]).sum(1) >= cosine
        a, b = a[hit], b[hit]
        if not len(a):
            return empty
        nodes, pos = np.unique(np.concatenate((qr[a], er[b])), return_inverse=True)
        pa, pb = pos[: len(a)], pos[len(a):]
        weight = np.bincount(pa, e["copies"].to_numpy(float)[b], len(nodes)) + np.bincount(pb, q["copies"].to_numpy(float)[a], len(nodes))
        return pd.DataFrame({"node": nodes, "weight": weight.astype(np.int64), "root": nodes[_forest(pa, pb, len(nodes))]})

    columns = ["label", "dim", "list", "eb", "qb", "entry", "rep", "copies", "unit", "home", "codes", "error"]
    met = materialise(entries.select(*columns).union(queries.select(*columns)).groupBy("label", "dim", "list", "eb", "qb").applyInPandas(
        meet, "node long, weight long, root long"), "links")
    weight = met.groupBy("node").agg(F.sum("weight").alias("weight"))
    comp = connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (classes.select("label", "digest", "rep", "copies").join(weight.withColumnRenamed("node", "rep"), "rep", "left")
             .join(comp.withColumnRenamed("node", "rep"), "rep", "left"))
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")
    out = out.select("vec_id", links.alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
