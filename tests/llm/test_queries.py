"""The registered queries of the subpackage against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from talkgauge.llm import queries
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.registry()))
def test_query(spark, name):
    assert compare(spark, duck(FOLDER), name, FOLDER) is None


def test_sql_belongs_to_queries():
    assert set(queries.oracle_queries()) <= set(queries.registry())


def test_pipeline_stages(spark, tmp_path, odd_docs):
    """Each stage keeps what its operator's decision says, with the columns of documents, on awkward rows too."""
    folder = tmp_path / "sf"
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "score")
    docs.write.parquet(str(folder / "documents.parquet"))
    benchmark = spark.createDataFrame([("b1", docs.where("doc_id = 30").first().text)], "item_id string, text string")
    benchmark.write.parquet(str(folder / "benchmark.parquet"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, toxic int")
    labels.write.parquet(str(folder / "labels.parquet"))
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        path = str(tmp_path / f"out{k}")
        stage(spark, before, str(folder)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.count() <= before.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
            assert kept.exceptAll(before).count() == 0
        if name == "near duplicates":
            assert kept.where("doc_id in (5, 210, 211, 212)").count() <= 1
        if name == "decontamination":
            assert kept.where("doc_id = 30").count() == 0
    assert kept.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert kept.count() > 0


def test_pipeline_on_no_documents(spark, tmp_path, no_docs):
    kept = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, FOLDER)
        assert kept.count() == 0
