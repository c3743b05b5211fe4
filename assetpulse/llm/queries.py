"""The queries of this subpackage, each its operator over a whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetpulse.llm import (chat, decontamination, language_model, merkle, near_dedup, packing, quality, ranked_search, sentence_pieces, sharding,
                            token_files, vector_dedup, warc)
from assetpulse.llm.oracle_sql import SQL
from assetpulse.llm.shared import table
from assetpulse.llm.tokens import vocabulary

END_ID = 2
SHARDS = 40


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a model of the labelled rows outside the held-out quarter; a null text scores as the empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", (quality.remainder("doc_id", 4) == 2).alias("held_out"), "score",
                                    (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 1024 tokens, as ``packing.pieces`` and ``packing.pack`` define them."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), END_ID))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all maximal conversations, rendered, as ``chat.render`` defines them."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back, as ``warc.write_archives`` and ``warc.read_archives`` define them."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum as read back from the token files; nulls and order as ``token_files.write_token_files`` defines them."""
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``bytes``: sizes near equal, so equal texts may lie in different shards."""
    dealt = sharding.shard_by_bytes(sharding.document_records(table(spark, sf_dir, "documents")), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors, as ``vector_dedup.linked_vectors`` defines them."""
    return vector_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, as ``near_dedup.near_duplicates`` defines them."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair that holds the needed share of the item, as ``decontamination.contaminated`` defines it."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, as ``language_model.score`` defines them."""
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and the recomputed root of every document, as ``merkle.audit`` defines them."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document, as ``sentence_pieces.round_trip`` defines them."""
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item, as ``ranked_search.search`` defines them."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_chat_formatting, op4_warc, op5_token_files, op6_sharding,
                                   op7_vector_dedup, op8_minhash_near_dedup, op9_decontamination, op10_lm_scoring, op11_merkle_manifest,
                                   op12_sentencepiece, op13_ranked_search)}

__all__ = ["QUERIES", "SQL"]
