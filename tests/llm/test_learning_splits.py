"""What is learnt does not depend on how ids look or how rare a label or language is."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from talkgauge.llm import language, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "pe", "do", "gu")]


@pytest.mark.parametrize("kind", ["odd", "even", "text"])
def test_toxicity_learns_from_ids_of_any_kind(spark, kind):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(360):
        own = {"odd": 2 * k + 1, "even": 2 * k, "text": f"doc {k}"}[kind]
        toxic = k % 3 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zzgrob", "xxhurk"])
        docs.append((own, " ".join(words), int(toxic)))
        labels.append((own, int(toxic)))
    id_type = "string" if kind == "text" else "bigint"
    frame = spark.createDataFrame(docs, f"doc_id {id_type}, text string, truth int")
    rows = spark.createDataFrame(labels, f"doc_id {id_type}, toxic int")
    model = toxicity.fit_toxicity(frame, rows, F.lit(True))
    scored = toxicity.score_toxicity(frame, model).collect()
    bad, good = ([r.score for r in scored if r.truth == t] for t in (1, 0))
    assert len({round(r.score, 6) for r in scored}) > 20
    above = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert above >= 0.9


def test_halves_hold_every_label():
    rows = {(str(k), f"t{k}", int(k % 50 == 0)) for k in range(0, 200, 2)}
    train, check = toxicity.halved(rows)
    assert sorted([*train, *check]) == sorted(rows) and abs(len(train) - len(check)) <= 2
    assert {r[2] for r in train} == {r[2] for r in check} == {0, 1}
    assert {r[2] for r in toxicity.halved({("7", "a", 1), ("9", "b", 0)})[0]} == {0, 1}


def test_languages_of_one_row_are_all_learnt(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(30)), "main") for k in range(60)]
    for n in range(20):
        letters = [chr(0x4E00 + 40 * n + j) for j in range(30)]
        rows.append((1000 + n, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(20)), f"rare{n}"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_language(frame, F.lit(True))
    assert set(model.languages) == {r[2] for r in rows}
    found = {r.doc_id: r.lang_pred for r in language.predict_language(frame, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.9 * len(rows)
