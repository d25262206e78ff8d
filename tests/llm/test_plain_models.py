"""Models and the pipeline against plain loops: dictionaries, one number at a time, one window after another."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from talkgauge.llm import language, ppm, toxicity
from talkgauge.llm.frames import held_out
from talkgauge.llm.text import column_bytes
from tests.llm.conftest import crc_rest, prose
from tests.llm.test_decontaminate import brute
from tests.llm.test_models import bad_texts
from tests.llm.test_near import LOWER, all_pairs, words
from tests.llm.test_tokenizers import PIECES, sha

END = b"\xff"


def framed(text: str | None) -> bytes:
    return END * ppm.ORDER + (text or "").translate(LOWER).encode() + END


def counted(texts: list[str | None]) -> Counter:
    """How often each run of 1 to ORDER + 1 bytes ends at a byte or at the end of a text."""
    runs = Counter()
    for text in texts:
        data = framed(text)
        for end in range(ppm.ORDER + 1, len(data) + 1):
            runs.update(data[end - n : end] for n in range(1, ppm.ORDER + 2))
    return runs


class PlainCoder:
    """Partial matching with escape method D and exclusion, over dictionaries."""

    def __init__(self, kept: dict[bytes, int], texts: int):
        self.offers = defaultdict(dict)
        for run, n in kept.items():
            self.offers[run[:-1]][run[-1]] = n
        self.seen = {run: n for run, n in kept.items() if len(run) <= ppm.ORDER and run[-1:] != END}
        self.seen |= {END * k: texts for k in range(1, ppm.ORDER + 1)}
        self.seen[b""] = sum(n for run, n in kept.items() if len(run) == 1)

    def log_probability(self, history: bytes, sign: int) -> float:
        out, before = 0.0, None
        for k in range(ppm.ORDER, -1, -1):
            context = history[ppm.ORDER - k :]
            if context not in self.seen and before is None:
                continue
            offered = self.offers.get(context, {})
            live = offered if before is None else {s: n for s, n in offered.items() if s not in before}
            dropped = max(0, self.seen[context] - sum(offered.values()))
            total = 2 * (sum(live.values()) + dropped)
            if sign in live:
                return out + math.log10((2 * live[sign] - 1) / total)
            if total:
                out += math.log10((len(live) + 2 * dropped) / total)
            before = offered
        return out - math.log10(256 - len(self.offers.get(b"", {})))

    def score(self, text: str | None) -> float:
        data = framed(text)
        return sum(self.log_probability(data[k - ppm.ORDER : k], data[k]) for k in range(ppm.ORDER, len(data)))


@pytest.mark.parametrize("least", [1, 3])
def test_byte_model_equals_counted_runs_and_a_plain_coder(spark, monkeypatch, least):
    rng = random.Random(21)
    rows = [(k, prose(rng, ("en", "de")[k % 2], rng.randint(1, 60))) for k in range(50)]
    rows += [(60, None), (61, ""), (62, "Q"), (63, rows[4][1]), (63, rows[4][1]), (None, "ÿÿ \x00 中"), (64, "zz" * 300)]
    learnt = [t for i, t in rows if crc_rest(i, 10)]
    runs = counted(learnt)
    positions = sum(n for run, n in runs.items() if len(run) == 1)
    monkeypatch.setattr(ppm, "SHARE", (least - 0.5) / positions)
    kept = {run: n for run, n in runs.items() if n >= least}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = ppm.fit(frame.where(~held_out("doc_id", 10)).selectExpr("coalesce(text, '') AS text"))[0].bytes
    keys = np.array([len(run) << ppm._LONG | int.from_bytes(run, "big") for run in kept], dtype=np.int64)
    place = model.runs.get(keys)
    assert (place >= 0).all() and len(set(place.tolist())) == len(kept) == len(model.log_count) - 1
    assert np.allclose(10 ** model.log_count[place], [2 * n - 1 for n in kept.values()])
    coder = PlainCoder(kept, len(learnt))
    got = Counter((r.doc_id, round(r.score, 5)) for r in ppm.score_texts(frame).collect())
    assert got == Counter((i, round(coder.score(t), 5)) for i, t in rows)


@pytest.mark.parametrize("least,common", [(1, 40), (1, 0), (3, 40), (1, 1 << 20)])
def test_a_trie_dealt_by_contexts_equals_a_plain_coder(spark, monkeypatch, least, common):
    rng = random.Random(22)
    rows = [(k, prose(rng, ("en", "de")[k % 2], rng.randint(1, 60))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "Q"), (63, rows[4][1]), (63, rows[4][1]), (None, "ÿÿ \x00 中"), (64, "zz" * 300)]
    rows += [(k, t) for k in range(70, 200) if not crc_rest(k, 10) for t in (f"unlearnt {k} aaaaaaaa", "andring\x01", "")]
    learnt = [t for i, t in rows if crc_rest(i, 10)]
    runs = counted(learnt)
    monkeypatch.setattr(ppm, "SHARE", (least - 0.5) / sum(n for run, n in runs.items() if len(run) == 1))
    for name, value in {"TRIE_RUNS": 0, "COMMON_RUNS": common, "_CHUNK": 100}.items():
        monkeypatch.setattr(ppm, name, value)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    coder = PlainCoder({run: n for run, n in runs.items() if n >= least}, len(learnt))
    got = Counter((r.doc_id, round(r.score, 5)) for r in ppm.score_texts(frame).collect())
    assert got == Counter((i, round(coder.score(t), 5)) for i, t in rows)


def test_rare_runs_stay_when_the_corpus_grows(spark):
    """Runs seen once among five million bytes; as a share of all bytes they are next to nothing."""
    many = [k for k in range(1000) if crc_rest(k, 10)][:100]
    few = [(k, f"rare words {k % 7}") for k in range(1000, 1030)]
    frame = spark.createDataFrame([(k, "ab" * 25_000) for k in many] + few, "doc_id bigint, text string").repartition(4)
    runs = Counter({run: n * len(many) for run, n in counted(["ab" * 25_000]).items()})
    learnt = [t for k, t in few if crc_rest(k, 10)]
    runs.update(counted(learnt))
    coder = PlainCoder(runs, len(many) + len(learnt))
    got = {r.doc_id: r.score for r in ppm.score_texts(frame).where("doc_id >= 1000").collect()}
    assert len(got) == 30 and all(abs(got[k] - coder.score(t)) < 1e-6 for k, t in few)


def test_rarer_words_and_runs_travel_by_part_not_one_by_one(spark, monkeypatch):
    for name in "TRIE_RUNS", "COMMON_RUNS", "COMMON":
        monkeypatch.setattr(ppm, name, 0)
    rng = random.Random(23)
    texts = [prose(rng, "en", 40) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    models, _ = ppm.fit(frame.selectExpr("text", "true AS learnt"))
    sent = ppm._scored(frame.withColumn("key", F.xxhash64("doc_id", "text")), models)
    assert sent.count() <= len(texts) + 2 * 3  # each text, and one part of words and one of runs from each task


@pytest.mark.parametrize("held,part", [(64, 1 << 18), (1 << 20, 50), (64, 50)])
def test_sums_in_pieces_and_many_parts_equal_a_plain_coder(spark, monkeypatch, held, part):
    settings = {"TRIE_RUNS": 0, "COMMON_RUNS": 40, "COMMON": 3, "_HELD": held, "_PART": part, "_SENT": 30, "_BATCH": 400, "_SCORED": 300}
    for name, value in settings.items():
        monkeypatch.setattr(ppm, name, value)
    rng = random.Random(24)
    rows = [(k, prose(rng, ("en", "de")[k % 2], rng.randint(1, 60))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "Q"), (63, rows[4][1]), (63, rows[4][1]), (None, "ÿÿ \x00 中"), (64, "zz" * 300), (65, "a b " * 200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    learnt = [t for i, t in rows if crc_rest(i, 10)]
    coder = PlainCoder(counted(learnt), len(learnt))
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None], coder.score(t)) for i, t in rows]
    counts = Counter(w for i, t, _ in tokens if crc_rest(i, 10) for w in t)
    scale = counts.total() + 0.1 * (len(counts) + 1)
    want = Counter((i, len(t), sum(w in counts for w in t), round(sum(math.log10((counts[w] + 0.1) / scale) for w in t), 4), round(score, 4)) for i, t, score in tokens)
    got = ppm.score_texts(frame).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {counts.total()}


def network(seed: int) -> toxicity.Network:
    """Random weights, large enough for every part of the network to matter."""
    rng = np.random.default_rng(seed)
    out = toxicity.Network.new(rng)
    out.words[:] = rng.normal(0, 0.7, out.words.shape)
    out.chars[:] = rng.normal(0, 0.7, out.chars.shape)
    for side in "fb":
        out.dense[f"b{side}"][:] = rng.normal(0, 0.3, out.dense[f"b{side}"].shape)
    return out


def plain_inputs(net: toxicity.Network, word: str) -> np.ndarray:
    read = toxicity.read_words(pa.array([word]))
    chars = [net.chars[b].astype(float) for b in read.runs]
    return np.concatenate((net.words[read.bucket[0]].astype(float), sum(chars) / len(chars)))


def plain_window(dense: dict[str, np.ndarray], inputs: list[np.ndarray]) -> float:
    """The logit of one window, word after word."""
    h = toxicity._HIDDEN
    states = {}
    for side in "fb":
        state, kept = np.zeros(h), []
        for x in inputs if side == "f" else inputs[::-1]:
            g, u = x @ dense[f"x{side}"] + dense[f"b{side}"], state @ dense[f"h{side}"]
            z, r = 1 / (1 + np.exp(-(g[:h] + u[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + u[h : 2 * h])))
            state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
            kept.append(state)
        states[side] = kept if side == "f" else kept[::-1]
    both = [np.concatenate(pair) for pair in zip(states["f"], states["b"])]
    weight = [math.exp(float(np.tanh(s @ dense["a"]) @ dense["v"])) for s in both]
    mean = sum(w * s for w, s in zip(weight, both)) / sum(weight)
    return float(mean @ dense["w"] + dense["o"][0])


def plain_windows(text: str) -> list[list[str]]:
    """Windows over the words of a text, a word repeated in a row once."""
    found = words(text)
    found = [w for k, w in enumerate(found) if not k or w != found[k - 1]]
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(found):
        starts.append(starts[-1] + toxicity.STEP)
    return [found[a : a + toxicity.WINDOW] for a in starts]


def test_windows_by_a_plain_network():
    rng = random.Random(4)
    net = network(1)
    texts = [prose(rng, "en", n) for n in (1, 2, 31, 32, 33, 48, 49, 200)] + ["Rot rot ROT blau", prose(rng, "de", 900), "Straße, ÄÖ! naïve"]
    dense = {k: v.astype(float) for k, v in net.dense.items()}
    read = toxicity.read_words(pa.array(texts))
    want = [plain_window(dense, [plain_inputs(net, w) for w in part]) for t in texts for part in plain_windows(t)]
    got = net.logits(read)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)
    assert np.diff(read.window_at).tolist() == [len(plain_windows(t)) for t in texts] and np.std(want) > 0.05


def test_gradients_by_finite_differences():
    rng = random.Random(5)
    net = network(2)
    texts = ["drei kleine Worte", prose(rng, "en", 20), prose(rng, "de", 32)]
    target = np.array([1, 0, 1], np.float32)
    read = toxicity.read_words(pa.array(texts))
    found: dict = {}

    class Recorder:
        def dense(self, weights, grads):
            found.update({k: v.astype(float) for k, v in grads.items()})

        def rows(self, name, table, ids, grads):
            found[name] = np.zeros(table.shape)
            np.add.at(found[name], ids, grads.astype(float))

    net.step(read, read.window_at[:-1], target, Recorder())

    def loss(dense) -> float:
        logits = np.array([plain_window(dense, [plain_inputs(net, w) for w in plain_windows(t)[0]]) for t in texts])
        return float(np.logaddexp(0, np.where(target > 0, -logits, logits)).mean())

    dense = {k: v.astype(float) for k, v in net.dense.items()}
    for name, weights in dense.items():
        for _ in range(6):
            at = tuple(rng.randrange(n) for n in weights.shape)
            own, both = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = own + step
                both.append(loss(dense))
            weights[at] = own
            assert found[name][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-2, abs=2e-5), name
    for name, table in (("words", net.words), ("chars", net.chars)):
        for row in rng.sample(np.flatnonzero(np.abs(found[name]).sum(axis=1)).tolist(), 5):
            column = rng.randrange(table.shape[1])
            own, both = table[row, column], []
            for step in (1e-3, -1e-3):
                table[row, column] = own + np.float32(step)
                both.append((loss(dense), float(table[row, column])))
            table[row, column] = own
            slope = (both[0][0] - both[1][0]) / (both[0][1] - both[1][1])
            assert found[name][row, column] == pytest.approx(slope, rel=1e-2, abs=2e-5), name


def plain_language(model: language.LanguageModel, text: str) -> tuple[list[float], bool]:
    """Probabilities and acceptance of one text, run of bytes after run of bytes."""
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
    total, n = [0.0] * model.table.shape[1], 0
    for size in language.SIZES:
        for a in range(len(raw) - size + 1):
            (bucket,) = language.subwords(np.frombuffer(raw[a : a + size], dtype=np.uint8), size)
            total = [x + float(y) for x, y in zip(total, model.table[bucket])]
            n += 1
    mean = [x / max(1, n) for x in total]
    logits = [x + float(b) for x, b in zip(mean, model.bias)]
    power = [math.exp(x - max(logits)) for x in logits]
    floor = model.floors[sum(len(raw) >= edge for edge in language._CLASSES)]
    return [p / sum(power) for p in power], mean[-1] >= floor


def test_language_by_plain_means():
    rng = random.Random(8)
    rows = [(prose(rng, lang, rng.randint(3, 120)), lang) for _ in range(60) for lang in ("en", "de")]
    texts, labels = zip(*rows)
    model = language.train(texts[:60], labels[:60], texts[60:], labels[60:])
    asked = ["a", "Ab", "ß", "ABC def", "123 !?", prose(rng, "en", 7), prose(rng, "de", 400), "".join(rng.sample(texts[0], len(texts[0]))), "中文字 и"]
    share, kept = model.judged(*column_bytes(pa.array(asked)))
    want = [plain_language(model, t) for t in asked]
    assert np.allclose(share, [p for p, _ in want]) and kept.tolist() == [k for _, k in want]


def test_pipeline_by_brute_force(spark, tmp_path):
    """All rows of run() against plain loops over the stages, with the models that the stages fit."""
    rng = random.Random(31)
    rows = [(k, t, ("en", "de")[k % 2]) for k, (t, _) in enumerate(bad_texts(300, 3))]
    labels = [(k, y) for k, (_, y) in enumerate(bad_texts(300, 3))]
    base = prose(rng, "de", 120).split()
    rows += [(400 + k, " ".join(base[: 3 * k] + ["neu"] + base[3 * k + 1 :]), "de") for k in range(12)]
    rows += [(420, rows[4][1], "en"), (421, rows[4][1].upper(), None), (421, rows[4][1], "en"), (None, rows[7][1], "de"), (430, None, "en"), (431, "", None), (432, "1234 !!", "de")]
    rows += [(433, "".join(rng.sample(rows[1][1], len(rows[1][1]))), "de"), (434, " ".join(prose(rng, "en", 3000).split()), "en")]
    items = [("b1", prose(rng, "en", 30)), ("b2", prose(rng, "de", 13)), ("b3", None), (None, "?")]
    rows += [(440 + k, prose(rng, "en", n) + " " + items[k % 2][1], "en") for k, n in enumerate((5, 60, 400, 2000))]
    folder = str(tmp_path / "sf")
    docs = spark.createDataFrame([(*r, "src", None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(2).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(folder + "/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()

    stored = spark.read.parquet(folder + "/documents.parquet")
    judge = toxicity.fit_toxicity(stored, spark.read.parquet(folder + "/labels.parquet"), ~held_out("doc_id", 5))
    guess = language.fit_language(stored.select("doc_id", "text", "lang"), ~held_out("doc_id", 5))
    dense = {k: v.astype(float) for k, v in judge.dense.items()}
    inputs: dict[str, np.ndarray] = {}

    def toxic(text: str | None) -> bool:
        if not words(text):
            return False
        for w in words(text):
            if w not in inputs:
                inputs[w] = plain_inputs(judge, w)
        highest = max(plain_window(dense, [inputs[w] for w in part]) for part in plain_windows(text))
        return judge.curve[0] * highest + judge.curve[1] >= 0

    kept = [r for r in rows if not toxic(r[1])]
    assert 0 < len(rows) - len(kept) < 200
    kept = [r for r in kept if re.search(r"[^\W\d_]", r[1] or "") and plain_language(guess, r[1])[1]]
    assert {r[0] for r in kept}.isdisjoint({430, 431, 432, 433})
    root, links = all_pairs([r[1] for r in kept])
    groups = defaultdict(list)
    for r, own, n in zip(kept, root, links):
        groups[own if n else (own, "alone")].append(r)
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = words(text)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(name or "")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for own in groups.values():
        first = min((r[0] for r in own if r[0] is not None), default=None)
        texts = {r[1] for r in own if r[0] == first}
        clean = {t for t in texts if not brute(t, windows)[4]}
        assert not clean or clean == texts  # whichever of a repeated id stays, the verdict is the same
        if clean:
            want.append((first, texts))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in want)
    assert 0 < sum(r.doc_id is not None and 440 <= r.doc_id for r in got) < 4
    allowed = dict(want)
    for r in got:
        ids = library.encode(r.text)
        assert r.text in allowed[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
