"""A training corpus from documents: filter, identify, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents.  All but the last return the columns of documents.  Models learn from the base
tables in ``sf_dir``; what a stage decides holds for all documents the stage before it kept.

Nulls, empty texts and repeated rows follow the rules of the operators: a text without letters has no
language and goes, so later stages see texts with letters only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm import decontaminate, language, near, pieces, toxicity
from talkgauge.llm.frames import fresh, held_out, prepare, stored, table

#: No stage but the fourth can be written in SQL, so neither can the whole.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows in one column, beside their text, so that results clash with none of theirs."""
    (row,) = fresh(["text"], "_row")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("text")), row


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 5))
    rows, row = _packed(docs)
    return toxicity.score_toxicity(rows, model, with_text=False).where("predicted = 0").select(f"{row}.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out("doc_id", 5))
    rows, row = _packed(docs)
    return language.predict_language(rows, model, with_text=False).where("accepted").select(f"{row}.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", not_toxic),
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(prepare(spark), docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def registry() -> dict:
    return {"pipeline": run}


def oracle_queries() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
