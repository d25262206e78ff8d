"""Language identification, toxicity and partial matching: held-out accuracy, bounds and brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkgauge.llm import language, ppm, toxicity
from talkgauge.llm.frames import held_out
from talkgauge.llm.text import column_bytes
from tests.llm.conftest import crc_rest, odd_texts, prose
from tests.llm.test_near import LOWER


def test_language_on_held_out_texts(spark, odd_docs, no_docs):
    got = language.identify(odd_docs)
    rows = got.select("doc_id", "held_out", "lang_pred", "score", "accepted", "lang", "text").collect()
    assert len(rows) == len(odd_texts()) and "spans" in got.columns
    for r in rows:
        assert r.held_out == (crc_rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        lettered = any(c.isalpha() for c in r.text or "")
        assert lettered == (r.lang_pred != "und") and (lettered or not r.accepted)
    checked = [r for r in rows if r.held_out and r.lang and len(r.text or "") > 40 and r.text[:2] != "xx"]
    assert checked and sum(r.lang == r.lang_pred for r in checked) >= 0.95 * len(checked)
    assert language.identify(no_docs).count() == 0
    unlearnt = language.predict_language(odd_docs, None).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlearnt] == [("und", 0.0)]


def test_language_does_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, lang, n) for lang in ("en", "de") for n in (1, 3, 40, 300)] + ["", "a"]
    model = language.train(texts[:8], ["en"] * 4 + ["de"] * 4, texts[:8], ["en"] * 4 + ["de"] * 4)
    whole = model.probabilities(*column_bytes(pa.array(texts)))
    monkeypatch.setattr(language, "_PIECE", 50)
    assert np.allclose(model.probabilities(*column_bytes(pa.array(texts))), whole)
    assert np.allclose(whole.sum(axis=1), 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_rejection_between_two_languages(seed):
    rng = random.Random(seed)
    rows = [(prose(rng, lang, rng.randint(5, 150)), lang) for _ in range(150) for lang in ("en", "de")]
    texts, labels = zip(*rows)
    model = language.train(texts[:150], labels[:150], texts[150:], labels[150:])
    asked = [prose(rng, lang, 60) for _ in range(40) for lang in ("en", "de")]
    mixed = [a + " " + b for a, b in zip(asked[::2], asked[1::2])]
    shuffled = ["".join(rng.sample(t, len(t))) for t in asked]
    strange = [" ".join("".join(rng.choice(["qu", "zo", "vle", "kwa", "ñi"]) for _ in range(3)) for _ in range(60)) for _ in range(40)]
    shares = [model.judged(*column_bytes(pa.array(t)))[1].mean() for t in (asked, mixed, shuffled, strange)]
    assert shares == [1, 1, 0, 0]


def test_no_language_is_left_out(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k}") for k in range(4)] + [(9, "more", "l0")], "doc_id bigint, text string, lang string")
    every = F.lit(True)
    assert language.fit_language(docs, every, most_languages=4) is not None
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit_language(docs, every, most_languages=3)


def bad_texts(n: int, seed: int) -> list[tuple[str, int]]:
    rng, out = random.Random(seed), []
    for k in range(n):
        w = prose(rng, ("en", "de")[k % 2], rng.randint(20, 150)).split()
        if k % 3 == 0:
            for _ in range(max(1, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(["rotten", "vile", "rottenly"]))
        out.append((" ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_on_held_out_texts(spark, no_docs):
    rows = bad_texts(500, 1)
    docs = spark.createDataFrame([(k, t, "keep") for k, (t, _) in enumerate(rows)] + [(900, None, None), (901, "", None), (None, "?", None)], "doc_id bigint, text string, PREDICTED string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).select("doc_id", "score", "predicted").collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, rows[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 500 and crc_rest(r.doc_id, 5) == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(not r.predicted for r in got if r.doc_id in (900, 901, None))
    none = labels.where("doc_id < 0")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_windows_cover_every_word():
    texts = ["", "a", " ".join(f"w{k}" for k in range(33)), " ".join(f"v{k}" for k in range(500)), "x " * 5000]
    words = toxicity.read_words(pa.array(texts))
    assert np.diff(words.window_at).tolist() == [1, 1, 2, 31, 1]
    for a, b, n in zip(words.window_at[:-1], words.window_at[1:], (0, 1, 33, 500, 1)):
        assert len(set(words.windows[a:b].ravel().tolist()) - {-1}) == n


def test_gradients_of_the_network():
    """A step of descent on one batch lowers its loss, for both directions and the embeddings."""
    words = toxicity.read_words(pa.array([t for t, _ in bad_texts(40, 2)]))
    label = np.array([y for _, y in bad_texts(40, 2)], np.float32)
    network = toxicity.Network.new(np.random.default_rng(0))
    chosen = words.window_at[:-1]

    def loss() -> float:
        logit = network.logits(words)[chosen].astype(float)
        return float(np.logaddexp(0, np.where(label > 0, -logit, logit)).mean())

    adam = toxicity.Adam(toxicity._known(words, 1), 0.003)
    losses = [loss()]
    for _ in range(60):
        network.step(words, chosen, label, adam)
        losses.append(loss())
    assert losses[5] < losses[0] and losses[-1] < 0.5 * losses[0]


@pytest.fixture(scope="module")
def scored(spark, odd_docs):
    return ppm.score_texts(odd_docs).collect()


def test_word_model_by_brute_force(scored):
    counts, kept = Counter(), []
    for doc_id, text, _ in odd_texts():
        tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]
        kept.append((doc_id, tokens))
        if crc_rest(doc_id, 10):
            counts.update(tokens)
    n = sum(counts.values())
    scale = n + 0.1 * (len(counts) + 1)
    want = Counter((i, crc_rest(i, 10) == 0, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / scale) for w in t), 4)) for i, t in kept)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored) == want


def test_rare_words_by_join_agree_with_broadcast(spark, odd_docs, scored, monkeypatch):
    monkeypatch.setattr(ppm, "COMMON", 3)
    again = ppm.score_texts(odd_docs).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4))
    assert sorted(map(key, again)) == sorted(map(key, scored))


def small_model(texts: list[str]) -> ppm.ByteModel:
    codes, _ = ppm.byte_runs(*column_bytes(pa.array(texts)))
    kept = [(length, *np.unique(codes.astype(np.int64) & ppm._mask(length), return_counts=True)) for length in range(1, ppm.ORDER + 2)]
    least = [(np.full((n >= 2).sum(), length), c[n >= 2], n[n >= 2]) for length, c, n in kept]
    return ppm.ByteModel.of(*(np.concatenate([x[k] for x in least]).astype(np.int64) for k in range(3)), len(texts))


def test_probabilities_behind_every_context_sum_to_one():
    rng = random.Random(6)
    model = small_model([prose(rng, "en", 60) for _ in range(40)])
    contexts = [b"\xff" * 6, b"the th", b"zzzzzz", b"\xff\xff the", b" andre", b"ing on", b"q the "]
    for context in contexts:
        codes = np.array([int.from_bytes(context[-ppm.ORDER :] + bytes([s]), "big") for s in range(256)], dtype=np.uint64)
        assert abs((10 ** model.log_probability(codes)).sum() - 1) < 1e-9


def test_scores_add_up_and_learn():
    rng = random.Random(7)
    model = small_model([prose(rng, "en", 80) for _ in range(60)])
    texts = [prose(rng, "en", 50), prose(rng, "de", 50), "", "A"]
    data, at = column_bytes(pa.array(texts))
    codes, ends = ppm.byte_runs(data, at)
    single = model.log_probability(codes)
    got = ppm.Scorer(model).score(data, at)
    assert np.allclose(got, [single[a:b].sum() for a, b in zip(ends[:-1], ends[1:])])
    assert got[0] / len(texts[0]) > got[1] / len(texts[1].encode()) and got[2] < 0


def test_scores_of_nothing(spark, no_docs):
    assert ppm.score_texts(no_docs).count() == 0
    unlearnt = spark.createDataFrame([(k, "ab") for k in range(200)], "doc_id bigint, text string").where(held_out("doc_id", 10))
    rows = ppm.score_texts(unlearnt).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score - 3 * math.log10(1 / 256)) < 1e-9 for r in rows)
