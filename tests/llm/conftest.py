"""Small tables with nulls, empty and long texts, repeated rows and columns whose names results also use."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()),
    T.StructField("N_TOKENS", T.StringType()),
    T.StructField("_text", T.StringType()),
    T.StructField("spans", T.StringType()),
])

SYLLABLES = {"en": ["the", "ing", "on", "re", "th", "and"], "de": ["der", "sch", "ung", "ä", "ich", "ein"]}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < 0.1 else w + ("." if rng.random() < 0.1 else "") for w in words)


def odd_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang) with every awkward case."""
    rng = random.Random(3)
    rows: list[tuple[int | None, str | None, str | None]] = [(k, prose(rng, ("en", "de")[k % 2], rng.randint(5, 120)), ("en", "de")[k % 2]) for k in range(120)]
    long = prose(rng, "en", 40_000)
    base = prose(rng, "de", 200).split()
    rows += [(200, None, "en"), (201, "", None), (202, "!!! 123 ...", "en"), (203, long, "en"), (204, "x" * 30_000, "en"), (205, "\n \t", "de")]
    rows += [(210, rows[5][1], "de"), (211, rows[5][1], "de"), (212, rows[5][1], "de"), (212, rows[5][1], "de"), (None, rows[5][1], "de"), (None, None, None)]
    rows += [(220 + k, " ".join(base[:k] + ["neu"] + base[k + 1 :]), "de") for k in range(40)]
    rows += [(300, "’▁é  中文字 🙂 ab́ ÄÖ 'S can't <|endoftext|> ΑΣ ½ \x00", "de")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    rows = [(i, t, lang, "src", None, "mine", "mine", "mine", "mine") for i, t, lang in odd_texts()]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < -5")


def crc_rest(doc_id: int | None, parts: int) -> int:
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts
