"""Language identification: averaged hashed subword embeddings and a linear softmax.

Runs of 2 to 4 bytes of the text, A-Z lower-cased and ASCII other than letters read as a space, are
hashed to ``BUCKETS`` embeddings; a text is their mean.  The softmax over languages is trained together
with them by stochastic gradient descent in numpy on the driver.  The sample for it is bounded: at most
``windows`` rows per language, one window of ``window_chars`` characters each, cut further to pieces of
several lengths.  A second sample of the same size, not used for training, sets the temperature of the
softmax and the floors of rejection.

A softmax says which language fits best and not whether any does: between two it never falls below a half,
and for a text of two languages it is near that.  Texts are therefore rejected by familiarity, the mean logarithm
of how common a text's runs are in the mean of all languages.  Its floor, for each class of lengths, lies
between two sets of scores of the second sample.  To be kept are whole windows, pieces of them and texts
of two languages; to be rejected are the same with shuffled bytes, and each language as seen by the others
alone.  The floor is in the middle of the ``reject`` quantile of the former and the 1 - ``reject`` quantile
of the latter, or, where these cross, that quantile of the former.

Prediction covers every whole text and uses the text only.  Since the classifier is linear, embeddings
and softmax weights are multiplied once; that table, of fixed size, is all that is broadcast.

Defined results: a null text or one without a letter is ``und``, score 0, rejected; repeated rows are
answered one by one; rows without language or id never train; if no row can train, every text is
``und``; a result column replaces one of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.frames import fresh, held_out, without
from talkgauge.llm.text import batches, column_bytes

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
_DIM = 16
_LENGTHS = (6, 12, 24, 60, 150, 400)  # bytes of the pieces that set floors, beside whole windows
_CLASSES = np.array([9, 18, 40, 100, 250, 800])  # bytes from which the next floor holds
_BATCH = 2 << 20
_PIECE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the run of ``size`` bytes that begins at each byte of folded text, but for the last ones."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = np.zeros(n, dtype=np.uint32)
    for k in range(size):
        code |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code ^= np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)
    code *= np.uint32(0x85EBCA6B)
    return code >> np.uint32(16)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, over the temperature; last, familiarity
    bias: np.ndarray
    floors: np.ndarray  # of familiarity, by class of lengths

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of texts given as bytes and n + 1 offsets; a text of one byte has the prior only."""
        return self.judged(data, at)[0]

    def judged(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of texts, and whether they are familiar enough to be accepted."""
        means = self.means(data, at)
        familiar = means[:, -1] >= self.floors[np.searchsorted(_CLASSES, np.diff(at), side="right")]
        return _softmax(means[:, :-1] + self.bias), familiar

    def means(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean rows of the table over the runs of each text."""
        folded = np.frombuffer(data.tobytes().translate(_FOLD.tobytes()), dtype=np.uint8)
        sums = np.zeros((len(at) - 1, self.table.shape[1]))
        counts = np.zeros(len(at) - 1)
        for size in SIZES:
            lows, highs = at[:-1], np.maximum(at[1:] - size + 1, at[:-1])
            counts += highs - lows
            for a in range(0, len(data), _PIECE):  # bounded memory for any length of text
                ids = subwords(folded[a : a + _PIECE + size - 1], size)
                if not len(ids):
                    continue
                i, j = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, a + len(ids))
                total = np.zeros((len(ids) + 1, self.table.shape[1]))
                np.cumsum(self.table[ids], axis=0, out=total[1:])
                low, high = np.clip(lows[i:j] - a, 0, len(ids)), np.clip(highs[i:j] - a, 0, len(ids))
                sums[i:j] += total[high] - total[low]
        return sums / np.maximum(counts, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _pieces(texts: list[str], rng: np.random.Generator) -> list[bytes]:
    """Each window whole and cut to several lengths, as bytes."""
    out = []
    for text in texts:
        raw = text.encode()
        out.append(raw)
        for length in (24, 60, 150, 400):
            if len(raw) > length:
                start = int(rng.integers(0, len(raw) - length + 1))
                out.append(raw[start : start + length])
    return out


def _features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    folded = np.frombuffer(raw.translate(_FOLD.tobytes()), dtype=np.uint8)
    ids, counts = np.unique(np.concatenate([subwords(folded, s) for s in SIZES]), return_counts=True)
    return ids.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list[str], check_texts: list[str], check_labels: list[str], reject: float = 0.001, epochs: int = 4, seed: int = 7) -> LanguageModel:
    """Fit on windows of known language; the second windows calibrate."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    examples = []
    for language in languages:
        number = languages.index(language)
        examples += [(*_features(p), number) for p in _pieces([t for t, x in zip(texts, labels) if x == language], rng)]
    embed = rng.normal(0, 0.1, (BUCKETS, _DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (_DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, share, target = examples[k]
            rate = 2.0 * (1 - done / steps)
            done += 1
            mean = share @ embed[ids]
            gradient = mean @ weight + bias
            gradient = np.exp(gradient - gradient.max())
            gradient /= gradient.sum()
            gradient[target] -= 1
            back = weight @ gradient
            weight -= rate * 0.1 * np.outer(mean, gradient)
            bias -= rate * 0.1 * gradient
            embed[ids] -= rate * share[:, None] * back
    common = _commonness(languages, texts, labels)
    familiarity = np.log(common.mean(axis=0))
    model = LanguageModel(languages, np.column_stack((embed @ weight, familiarity)), bias, np.full(len(_CLASSES) + 1, -np.inf))
    known = [(t, languages.index(x)) for t, x in zip(check_texts, check_labels) if x in languages]
    if known:
        cut = [(p, number) for t, number in known for p in _pieces([t], rng)]
        _calibrate(model, [p for p, _ in cut], np.array([n for _, n in cut]))
        _set_floors(model, common, known, reject, rng)
    return model


def _commonness(languages: list[str], texts: list[str], labels: list[str]) -> np.ndarray:
    """Share of each bucket among the runs of each language, half a run added."""
    out = np.full((len(languages), BUCKETS), 0.5)
    for text, label in zip(texts, labels):
        folded = np.frombuffer(text.encode().translate(_FOLD.tobytes()), dtype=np.uint8)
        for size in SIZES:
            out[languages.index(label)] += np.bincount(subwords(folded, size), minlength=BUCKETS)
    return out / out.sum(axis=1, keepdims=True)


def _set_floors(model: LanguageModel, common: np.ndarray, known: list[tuple[str, int]], reject: float, rng: np.random.Generator) -> None:
    """Choose the floors of familiarity between texts to be kept and texts to be rejected."""
    mixed = []
    for text, number in known:
        other, language = known[int(rng.integers(len(known)))]
        if language != number:
            mixed.append(text[: len(text) // 2] + " " + other[len(other) // 2 :])
    kept = [(p, number) for text, number in [*known, *((t, -1) for t in mixed)] for p in _cut(text.encode(), rng)]
    raw = [p for p, _ in kept]
    shuffled = [rng.permutation(np.frombuffer(p, dtype=np.uint8)).tobytes() for p in raw]
    scores = [_familiarity(model, raw), _familiarity(model, shuffled)]
    sizes = [np.array([len(p) for p in raw])] * 2
    if len(model.languages) > 1:
        every = common.sum(axis=0)
        for number in range(len(model.languages)):
            own = [p for p, n in kept if n == number]
            if own:
                rest = np.log((every - common[number]) / (len(common) - 1))[:, None]
                others = LanguageModel(model.languages, rest, model.bias, model.floors)
                scores.append(_familiarity(others, own))
                sizes.append(np.array([len(p) for p in own]))
    kinds = [np.searchsorted(_CLASSES, n, side="right") for n in sizes]
    strange, strange_kind = np.concatenate(scores[1:]), np.concatenate(kinds[1:])
    for k in range(len(model.floors)):
        good, bad = scores[0][kinds[0] == k], strange[strange_kind == k]
        if len(good):
            least, most = np.quantile(good, reject), np.quantile(bad, 1 - reject)
            model.floors[k] = (least + most) / 2 if most < least else least
    held = np.where(np.isfinite(model.floors))[0]
    for k in np.where(~np.isfinite(model.floors))[0]:  # no text of this length to learn from
        model.floors[k] = model.floors[held].min()


def _cut(raw: bytes, rng: np.random.Generator) -> list[bytes]:
    """A text whole and, from random places, in the lengths that set floors."""
    out = [raw] if len(raw) > 1 else []
    for length in _LENGTHS:
        if len(raw) > length:
            start = int(rng.integers(0, len(raw) - length + 1))
            out.append(raw[start : start + length])
    return out


def _familiarity(model: LanguageModel, raw: list[bytes]) -> np.ndarray:
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return model.means(np.frombuffer(b"".join(raw), dtype=np.uint8), at)[:, -1]


def _calibrate(model: LanguageModel, raw: list[bytes], target: np.ndarray) -> None:
    """Choose the temperature of least log loss."""
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    logits = np.log(np.maximum(model.probabilities(data, at), 1e-30))
    rows, temperatures = np.arange(len(target)), np.geomspace(0.25, 4, 33)
    loss = [-np.log(np.maximum(_softmax(logits / t)[rows, target], 1e-30)).mean() for t in temperatures]
    best = float(temperatures[int(np.argmin(loss))])
    model.table[:, :-1] /= best
    model.bias = model.bias / best


def sample_windows(docs: DataFrame, languages: list[str], counts: dict[str, int], windows: int, window_chars: int, part: Column) -> list:
    """At most ``windows`` rows per language, chosen by a hash of the id, with one window of each text."""
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, windows / counts[k]))])
    dice = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    places = F.greatest(F.length("text") - window_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), places) + 1
    chosen = docs.where(part & (dice < share[F.col("lang")])).select("lang", F.substring("text", start, F.lit(window_chars)).alias("window"))
    return chosen.limit(2 * windows * len(languages)).collect()


LEAST_WINDOWS = 40


def fit_language(docs: DataFrame, learn: Column, windows: int = 400, window_chars: int = 1500, most_languages: int = 500, reject: float = 0.001) -> LanguageModel | None:
    """Fit on the rows of (doc_id, text, lang) where ``learn`` holds; None if there are none.

    All values of ``lang`` are learnt; more than ``most_languages`` raise an error.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(common) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn: pass a higher most_languages")
    if not common:
        return None
    counts = {r["lang"]: r["count"] for r in common}
    parts = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))
    rows, checks = (sample_windows(known, list(counts), {k: max(1, n // 2) for k, n in counts.items()}, windows, window_chars, parts == k) for k in (0, 1))
    # a language whose few rows all lie in the second half is learnt from every other one of them, the first included
    learnt, rest = {r["lang"] for r in rows}, []
    for lang in sorted({r["lang"] for r in checks} - learnt):
        own = sorted(r["window"] for r in checks if r["lang"] == lang)
        rows += [{"lang": lang, "window": w} for w in own[::2]]
        rest += [{"lang": lang, "window": w} for w in own[1::2]]
    checks = [r for r in checks if r["lang"] in learnt] + rest
    # a few windows of a language are repeated, so that it is seen often enough to be told apart
    held: dict[str, list] = {}
    for r in rows:
        held.setdefault(r["lang"], []).append(r)
    rows = [r for own in held.values() for r in own * max(1, -(-LEAST_WINDOWS // len(own)))]
    if not rows:
        return None
    return train([r["window"] for r in rows], [r["lang"] for r in rows], [r["window"] for r in checks], [r["lang"] for r in checks], reject)


def predict_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", with_text: bool = True) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its calibrated probability) and ``accepted``."""
    results = ["lang_pred", "score", "accepted"]
    value, letters = fresh([*docs.columns, *results], "_text", "_letters")
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    source = without(docs.withColumn(value, F.col(f"`{text}`")).withColumn(letters, lettered), results if with_text else [*results, text])
    kept = [f for f in source.schema.fields if f.name not in (value, letters)]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrivals):
        model = shared.value
        for rows in batches(arrivals, value, _BATCH):
            known = rows[letters].to_numpy()
            names, scores, accepted = np.full(len(known), UNKNOWN, dtype=object), np.zeros(len(known)), np.zeros(len(known), bool)
            if model is not None and len(known):
                share, familiar = model.judged(*column_bytes(rows[value]))
                names = np.where(known, np.array(model.languages, dtype=object)[share.argmax(axis=1)], UNKNOWN)
                scores = np.where(known, share.max(axis=1), 0.0)
                accepted = known & familiar
            out = rows.drop_columns([value, letters])
            for name, column in zip(results, (pa.array(names, pa.string()), pa.array(scores), pa.array(accepted))):
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches()

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Every document with ``held_out``, ``lang_pred``, ``score`` and ``accepted``.

    Documents whose crc32 of the id leaves 0 modulo 5 are held out of learning.
    """
    learn = docs.select("doc_id", "text", "lang")
    model = fit_language(learn, ~held_out("doc_id", 5))
    return predict_language(docs.withColumn("held_out", held_out("doc_id", 5)), model)
