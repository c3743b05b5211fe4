"""Quality classifier: hashed word n-gram logistic regression by follow-the-regularised-leader.

Features of a text are hashed n-grams over its words (one and two words, case
kept) and over its words' shapes (one to three words: length class, capitals,
digits, marks, last character class, and whether the word repeats the one before
or the one two before). A feature's value is ``log(1 + count)``, and a text's
values are scaled to unit length, so that a score is one sparse dot product.

Learning is online FTRL-proximal. ``TRAIN_ROWS`` bounds the labelled rows that a
model is fitted on (those with the smallest hash of their id); they are dealt
into learners of ``PER_LEARNER`` rows that run side by side, and their weights are averaged.
The model is ``2**BITS`` weights whatever the corpus: a bounded broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetpulse.llm import textscan

BITS = 18
TRAIN_ROWS = 18_000
PER_LEARNER = 3_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.005, 0.02
THRESHOLD = 0.7

_U = np.uint64


def _classes() -> np.ndarray:
    k = np.full(256, 3, np.int64)  # marks
    k[ord("a"):ord("z") + 1] = 0
    k[128:] = 0
    k[ord("A"):ord("Z") + 1] = 1
    k[ord("0"):ord("9") + 1] = 2
    return k


_CLASS = _classes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, feature, value)`` of all texts, ordered by document."""
    doc, start, end, h, joined = textscan.scan(texts, lower=False)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    kind = _CLASS[np.frombuffer(joined, np.uint8)]
    shape = np.minimum(end - start, 12) * 4 + kind[end - 1]
    for k in (1, 2, 3):
        run = np.concatenate(([0], np.cumsum(kind == k)))
        n = run[end] - run[start]
        shape = shape * 3 + np.where(n == 0, 0, np.where(n == end - start, 2, 1))
    for back in (1, 2):
        same = np.zeros(len(h), np.int64)
        same[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        shape = shape * 2 + same
    s = textscan.mix(shape.astype(_U) + _U(1 << 40))
    owner, found = [], []
    for codes, n in ((h, 1), (h, 2), (s, 1), (s, 2), (s, 3)):
        g = textscan.grams(codes, n)
        inside = doc[: len(g)] == doc[n - 1 :] if n > 1 else slice(None)
        owner.append(doc[: len(g)][inside])
        found.append((g >> _U(64 - BITS))[inside].astype(np.int64))
    key, count = np.unique((np.concatenate(owner) << BITS) | np.concatenate(found), return_counts=True)
    owner, value = key >> BITS, np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return owner, key & ((1 << BITS) - 1), value / norm[owner]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes over ``(features, values, label)`` rows."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (_sigmoid(w @ x) - y) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[i] = more
    w = weights(z, n)
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA) if n[-1] else 0.0
    return w


def training_rows(texts, labels) -> list[tuple[np.ndarray, np.ndarray, float]]:
    out = []
    for first, run in textscan.slices(texts):
        owner, f, v = features(run)
        cut = np.searchsorted(owner, np.arange(len(run) + 1))
        for k in range(len(run)):
            a, b = cut[k], cut[k + 1]
            out.append((np.append(f[a:b], 1 << BITS), np.append(v[a:b], 1.0), float(labels[first + k])))
    return out


@dataclass
class QualityModel:
    """Averaged weights; the last one is the bias."""

    weights: np.ndarray

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with ``name`` (replacing a column of that name): the probability of label 1.

        Null and empty texts get the bias' score. Other columns come along. An empty table gives no rows.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = shared.value.astype(np.float64)
            for part in parts:
                score = np.empty(len(part))
                for first, texts in textscan.slices(part["text"]):
                    owner, f, v = features(texts)
                    score[first : first + len(texts)] = np.bincount(owner, w[f] * v, len(texts)) + w[-1]
                part[name] = _sigmoid(score)
                yield part

        names = [c for c in docs.columns if c != name]
        base = docs.select(*names).withColumn("text", F.col("text").cast("string"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
        return base.mapInPandas(run, f"{schema}, `{name}` double")


def _learner(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["doc_id", "label"], kind="stable")
    w = ftrl(training_rows(part["text"], part["label"].to_numpy()))
    return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "rows": [len(part)], "weights": [w.astype("<f4").tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Model of ``labels(doc_id, label)`` on the texts of ``docs``.

    Null labels and ids teach nothing, null texts count as empty, repeated
    labels count each time. Without a labelled row the model scores 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))
    known = known.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)  # at most ``rows`` pairs of numbers
    learners = max(1, known.count() // PER_LEARNER)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = texts.join(F.broadcast(known), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(learners)).cast("int"))
    learnt = dealt.groupBy("shard").applyInPandas(_learner, "shard int, rows long, weights binary").collect()  # a row for each learner
    if not learnt:
        return QualityModel(np.zeros((1 << BITS) + 1))
    share = np.array([r["rows"] for r in learnt], float)
    return QualityModel(np.average([np.frombuffer(r["weights"], "<f4") for r in learnt], axis=0, weights=share))


def remainder(column: str, of: int):
    """``crc32(id as text) mod of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def fit_labelled(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of ``labels.quality`` from the rows that are not held out."""
    return fit(docs, labels.filter(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label")))
