"""The pipeline's stages against each other and the registered SQL."""

import __spark_entry__ as entry
import corpus_pipeline
from assetpulse.llm.shared import materialise

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        left = materialise(left, name)
        assert 0 < left.count() < docs.count(), name
        assert left.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_every_operator_has_one_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op") and k[2].isdigit())
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries()
