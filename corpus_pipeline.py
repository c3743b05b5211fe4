"""Corpus preparation: quality filter, near-dedup, benchmark decontamination, packing.

Every stage works on all documents that the stage before it kept. The first three
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetpulse.llm import decontamination, near_dedup, packing, quality
from assetpulse.llm.queries import END_ID
from assetpulse.llm.shared import materialise, table
from assetpulse.llm.tokens import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above."""
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs, "__quality")
    return scored.filter(scored["__quality"] >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (that with the smallest doc_id) of each near-duplicate group, repeated rows included."""
    return near_dedup.deduplicated(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their place in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), END_ID))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", keep_uncontaminated),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: the classifier is trained and the tokenizer is a library. The stages' operators are tested with brute force, the stages for taking effect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
