"""M5/M6: isolation forest as a distributed Spark job (Liu, Ting & Zhou, 2008).

Training
  1. Standardise the features (population mean / deviation, one aggregate).
  2. Draw the tree samples without touching more than a bounded number of
     rows per tree: a seeded Bernoulli pre-sample keeps about
     ``oversample * trees * psi`` rows, each kept row joins tree t when a
     hash of (row id, t) falls under its share, and a per-tree
     ``row_number`` by hash cuts every tree to exactly ``psi`` rows.
  3. ``groupBy(tree).applyInPandas``: one task grows one tree on psi rows
     (random feature, random split between the node's min and max, height
     limit ceil(log2 psi)). The node table has at most trees * (2 psi - 1)
     rows, a bound that does not grow with the data.
Scoring
  A vectorised function of the scaled features with the node table shipped to
  the tasks (bounded size, see above); each Arrow batch walks all trees with
  numpy indexing, and the readings' other columns never leave the JVM. The decision threshold is the contamination
  quantile of the training scores (exact, distributed), stored with the model.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import schema as SC
from ..operators import stats as S
from ..session import even_tasks
from . import features as FE

EULER = 0.5772156649015329
NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Grow one tree; rows (node, feature, threshold, left, right, size, depth)."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]  # (row idx, depth, parent, side)
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([nid, -1, 0.0, -1, -1, int(len(idx)), depth])
        if parent >= 0:
            nodes[parent][3 if side == 0 else 4] = nid
        if depth >= limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes[nid][1], nodes[nid][2] = f, thr
        mask = sub[:, f] < thr
        stack.append((idx[~mask], depth + 1, nid, 1))
        stack.append((idx[mask], depth + 1, nid, 0))
    return [tuple(n) for n in nodes]


def _fit_trees_fn(features: list[str], limit: int, seed: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=np.float64)
        x = np.nan_to_num(x, nan=0.0)
        rng = np.random.default_rng([seed, tree])
        rows = _grow(x, rng, limit)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int32", "depth": "int32"})
    return fit


#: Rows that walk the trees together: their work arrays stay in a core's cache.
ROWS_PER_WALK = 8192


@dataclass
class ForestArrays:
    """Node table as dense arrays [tree, node] for vectorised traversal; a leaf is its own child on both sides."""
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray       # [tree, 2 * node]: below the threshold, [tree, 2 * node + 1]: not below
    leaf_value: np.ndarray  # depth + c(size) at leaves
    depth: np.ndarray       # [tree]

    @staticmethod
    def from_nodes(nodes: pd.DataFrame) -> "ForestArrays":
        trees = int(nodes["tree"].max()) + 1
        width = int(nodes["node"].max()) + 1
        shape = (trees, width)
        feat = np.zeros(shape, np.intp)
        thr = np.zeros(shape)
        leaf = np.zeros(shape)
        child = np.tile(np.repeat(np.arange(width, dtype=np.intp), 2), (trees, 1))
        depth = np.zeros(trees, np.intp)
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        f = nodes["feature"].to_numpy()
        inner = f >= 0
        feat[t[inner], n[inner]] = f[inner]
        thr[t, n] = nodes["threshold"].to_numpy()
        child[t[inner], 2 * n[inner]] = nodes["left"].to_numpy()[inner]
        child[t[inner], 2 * n[inner] + 1] = nodes["right"].to_numpy()[inner]
        leaf[t, n] = nodes["depth"].to_numpy() + np.array([c_factor(s) for s in nodes["size"].to_numpy()])
        np.maximum.at(depth, t, nodes["depth"].to_numpy())
        return ForestArrays(feat, thr, child, leaf, depth)

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        n_trees = self.feature.shape[0]
        total = np.zeros(len(x))
        for a in range(0, len(x), ROWS_PER_WALK):
            part = np.ascontiguousarray(x[a : a + ROWS_PER_WALK])
            values, first = part.ravel(), np.arange(len(part)) * part.shape[1]
            into = total[a : a + ROWS_PER_WALK]
            for feature, threshold, child, leaf, depth in zip(self.feature, self.threshold, self.child, self.leaf_value, self.depth, strict=True):
                node = np.zeros(len(part), np.intp)
                for _ in range(depth):
                    right = values.take(first + feature.take(node)) >= threshold.take(node)
                    node = child.take(2 * node + right)
                into += leaf.take(node)
        return total / n_trees


@dataclass
class IsolationForestModel:
    features: list[str]
    scaler: FE.ScalerStats
    nodes: pd.DataFrame
    psi: int
    offset: float
    contamination: float

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Adds ``if_raw`` (the negated anomaly score); only the scaled features go through Python."""
        arrays, cpsi = ForestArrays.from_nodes(self.nodes), c_factor(self.psi)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            values = np.nan_to_num(x.to_numpy(dtype=np.float64), nan=0.0)
            return pd.Series(-np.power(2.0, -arrays.mean_path(values) / cpsi))  # higher is more normal, as score_samples

        scaled = FE.apply_scaler(df, self.scaler, suffix="__s")
        names = [f"{c}__s" for c in self.features]
        return scaled.withColumn("if_raw", score(F.struct(*names))).drop(*names)

    def transform(self, df: DataFrame) -> DataFrame:
        """M6: ``if_score`` (decision value, below 0 = anomaly), ``if_label``
        (-1 anomaly / 1 normal) and ``if_flag`` (1 anomaly)."""
        out = self.raw_scores(df).withColumn("if_score", F.col("if_raw") - F.lit(self.offset)).drop("if_raw")
        return (out.withColumn("if_label", F.when(F.col("if_score") < 0, -1).otherwise(1))
                   .withColumn("if_flag", F.when(F.col("if_score") < 0, 1).otherwise(0)))

    # K3: persistence -------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"features": self.features, "psi": self.psi, "offset": self.offset,
                "contamination": self.contamination,
                "scaler": {"kind": self.scaler.kind, "cols": self.scaler.cols, "a": self.scaler.a,
                           "b": self.scaler.b}}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite") \
            .text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded: trees * (2 psi - 1) rows
        sc = meta["scaler"]
        return IsolationForestModel(meta["features"], FE.ScalerStats(sc["kind"], sc["cols"], sc["a"], sc["b"]),
                                    nodes, meta["psi"], meta["offset"], meta["contamination"])


def _hash01(key, tree, seed: int):
    h = F.xxhash64(key, tree, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return h.cast("double") / F.lit(float(1 << 53))


def fit(df: DataFrame, features: list[str] | None = None, trees: int = C.IFOREST["trees"],
        contamination: float = C.IFOREST["contamination"], sample_size: int = C.IFOREST["sample_size"],
        seed: int = C.IFOREST["seed"], id_col: str = "reading_id", oversample: float = 1.5,
        total: int | None = None, _skip_offset: bool = False) -> IsolationForestModel:
    """M5: fit on ``df``; ``total`` may pass a known row count."""
    feats = FE.select_features(df, features or SC.ANOMALY_FEATURES)
    base = df.select(id_col, *feats)
    n = total if total is not None else base.count()
    psi = int(min(sample_size, n))
    scaler = FE.fit_standard(base, feats)
    scaled = FE.apply_scaler(base, scaler)
    # Pre-sample: bounded rows (about oversample * trees * psi), by a hash of the
    # id, so the model does not depend on how the table is laid out.
    frac = min(1.0, oversample * trees * psi / max(n, 1))
    pre = scaled.where(_hash01(F.col(id_col), F.lit(-1), seed) < F.lit(frac))
    m = max(1, int(min(n, oversample * trees * psi)))
    share = min(1.0, oversample * psi / m)
    tree_col = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                                  lambda t: _hash01(F.col(id_col), t, seed) < F.lit(share)))
    assigned = pre.select("*", tree_col.alias("tree"))
    from pyspark.sql import Window
    # Per tree at most ~oversample * psi rows: the window partitions are bounded.
    w = Window.partitionBy("tree").orderBy(_hash01(F.col(id_col), F.col("tree"), seed + 1), id_col)
    samples = assigned.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r")
    limit = int(math.ceil(math.log2(max(psi, 2))))
    nodes = (samples.groupBy("tree").applyInPandas(_fit_trees_fn(feats, limit, seed), NODE_SCHEMA)
             .toPandas())  # bounded: trees * (2 psi - 1) rows
    model = IsolationForestModel(feats, scaler, nodes, psi, 0.0, contamination)
    if _skip_offset:  # fit_transform sets it from the scores it keeps
        return model
    # The threshold needs the training scores once (bounded count + quantile):
    # keep them for the two passes instead of scoring twice.
    raw = model.raw_scores(df.select(id_col, *feats)).select("if_raw").persist()
    q = S.quantiles(raw, {"if_raw": [contamination]})
    model.offset = float(q.first()[0])
    raw.unpersist()
    return model


def fit_transform(df: DataFrame, **kwargs) -> tuple[IsolationForestModel, DataFrame]:
    """M5 + M6 on the training table itself: the rows are scored once; the
    threshold is the contamination quantile of those scores and the flags are
    derived from the same (persisted) scores."""
    rows = even_tasks(df.select("*")).persist()  # read for the count, the scaler, the samples and the scores
    model = fit(rows, **kwargs, _skip_offset=True)
    raw = model.raw_scores(rows).persist()
    q = S.quantiles(raw.select("if_raw"), {"if_raw": [model.contamination]})
    model.offset = float(q.first()[0])
    rows.unpersist()
    out = raw.withColumn("if_score", F.col("if_raw") - F.lit(model.offset)).drop("if_raw")
    out = (out.withColumn("if_label", F.when(F.col("if_score") < 0, -1).otherwise(1))
              .withColumn("if_flag", F.when(F.col("if_score") < 0, 1).otherwise(0)))
    return model, out
