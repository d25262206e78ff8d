"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own hashed embedding beside the mean embedding of its runs of 3 to 5 bytes.  The
network reads windows of ``WINDOW`` words that overlap by half, a word repeated in a row once; a document is scored by its highest
window, through a logistic curve fitted on rows that were not trained on.

Learning uses a bounded sample: at most about ``toxic_docs`` and ``clean_docs`` labelled rows, one slice of
``slice_chars`` characters of each, half of them for training, half for the curve.  Labels belong to
documents, so training first gives windows their document's label and then, epoch by epoch, keeps
the highest window of toxic documents and the highest and one random window of the others.

Prediction covers every window of every whole text and uses the text only; the network is of fixed size.

Defined results: a null, empty or wordless text has the score of a window without words and at most 0.49;
repeated rows are answered one by one; a document with several labels counts as toxic if one says so;
labels other than 0 and 1 are not used; if one label is missing every score is the share of label 1 that
was seen; a result column replaces one of its name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.frames import fresh, held_out, without
from talkgauge.llm.text import LOWER, batches, column_bytes, gather, word_hashes, word_spans

WINDOW, STEP = 32, 16
_BUCKETS = 1 << 15
_WORD, _CHARS, _HIDDEN, _ATTEND = 8, 12, 10, 8
_BATCH = 2 << 20
_LANES = 1024


@dataclass
class Words:
    """Windows over texts: distinct words, their bucket and runs of bytes, and the words of each window."""

    bucket: np.ndarray
    runs: np.ndarray
    runs_at: np.ndarray
    windows: np.ndarray  # windows x WINDOW, -1 behind the end of a text
    window_at: np.ndarray  # offsets of the texts among the windows


def read_words(column: pa.Array) -> Words:
    data, at = column_bytes(column)
    starts, ends, offsets = word_spans(data, at)
    hashes = word_hashes(data, starts, ends)
    distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    bucket = (distinct >> np.uint64(40)).astype(np.int64) & (_BUCKETS - 1)
    letters, letters_at = gather(data, starts[first], ends[first])
    runs, runs_at = _byte_runs(LOWER[letters], letters_at)
    fresh_word = np.ones(len(word), dtype=bool)
    fresh_word[1:] = word[1:] != word[:-1]
    fresh_word[offsets[:-1][offsets[:-1] < len(word)]] = True
    offsets = np.concatenate(([0], np.cumsum(fresh_word)))[offsets]
    word = word[fresh_word]
    sizes = np.diff(offsets)
    # a text has one window, and one more for each step until its last word is covered
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP))
    window_at = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(sizes)), n)
    begin = offsets[text] + (np.arange(window_at[-1]) - window_at[text]) * STEP
    grid = begin[:, None] + np.arange(WINDOW)
    inside = grid < offsets[text + 1][:, None]
    padded = np.append(word, 0)
    windows = np.where(inside, padded[np.minimum(grid, len(word))], -1).astype(np.int32)
    return Words(bucket, runs, runs_at, windows, window_at)


def _byte_runs(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 3 to 5 bytes of each word, which has a sign before and behind it."""
    sizes = np.diff(at) + 2
    edge = np.concatenate(([0], np.cumsum(sizes)))
    framed = np.full(edge[-1] + 5, 1, dtype=np.uint64)
    inside = np.ones(edge[-1], dtype=bool)
    inside[edge[:-1]] = inside[edge[1:] - 1] = False
    framed[: edge[-1]][inside] = letters
    which, buckets = [], []
    for size in (3, 4, 5):
        code = np.zeros(edge[-1], dtype=np.uint64)
        for k in range(size):
            code = code * np.uint64(257) + framed[k : k + edge[-1]]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        count = np.maximum(sizes - size + 1, 0)
        places = np.repeat(edge[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
        which.append(np.repeat(np.arange(len(sizes)), count))
        buckets.append(code[places].astype(np.int64))
    order = np.argsort(np.concatenate(which), kind="stable")
    flat = np.concatenate(buckets)[order]
    return flat, np.concatenate(([0], np.cumsum(sum(np.maximum(sizes - s + 1, 0) for s in (3, 4, 5)))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    words: np.ndarray
    chars: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        def draw(*shape, scale=0.3):
            return rng.normal(0, scale, shape).astype(np.float32)

        size, h = _WORD + _CHARS, _HIDDEN
        dense = {}
        for side in "fb":
            dense |= {f"x{side}": draw(size, 3 * h), f"h{side}": draw(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        dense |= {"a": draw(2 * h, _ATTEND), "v": draw(_ATTEND), "w": draw(2 * h), "o": np.zeros(1, np.float32)}
        return cls(draw(_BUCKETS, _WORD, scale=0.01), draw(_BUCKETS, _CHARS, scale=0.01), dense)

    def inputs(self, words: Words) -> np.ndarray:
        """The input of each distinct word."""
        out = np.empty((len(words.bucket), _WORD + _CHARS), dtype=np.float32)
        out[:, :_WORD] = self.words[words.bucket]
        for a in range(0, len(words.bucket), 1 << 15):
            b = min(a + (1 << 15), len(words.bucket))
            low, high = words.runs_at[a], words.runs_at[b]
            total = np.add.reduceat(self.chars[words.runs[low:high]], words.runs_at[a:b] - low, axis=0)
            out[a:b, _WORD:] = total / np.diff(words.runs_at[a : b + 1])[:, None]
        return out

    def logits(self, words: Words) -> np.ndarray:
        """The logit of every window."""
        inputs = self.inputs(words)
        gates = {s: np.concatenate((inputs @ self.dense[f"x{s}"] + self.dense[f"b{s}"], np.zeros((1, 3 * _HIDDEN), np.float32))) for s in "fb"}
        out = np.empty(len(words.windows), dtype=np.float32)
        for a in range(0, len(out), _LANES):
            part = words.windows[a : a + _LANES]
            states = np.concatenate([self._walk(s, gates[s], part) for s in "fb"], axis=2)
            out[a : a + _LANES] = self._pool(states, part.T >= 0)[0]
        return out

    def _walk(self, side: str, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Hidden states, WINDOW x windows x hidden, by the gate inputs of distinct words."""
        h, back = _HIDDEN, self.dense[f"h{side}"]
        state = np.zeros((len(windows), h), np.float32)
        out = np.empty((WINDOW, len(windows), h), np.float32)
        steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
        whole = bool((windows >= 0).all())
        for t in steps:
            ids = windows[:, t]
            g, u = gates[ids], state @ back
            zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            n = np.tanh(g[:, 2 * h :] + zr[:, h:] * u[:, 2 * h :])
            new = n + zr[:, :h] * (state - n)
            state = new if whole else np.where((ids >= 0)[:, None], new, state)
            out[t] = state
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        d = self.dense
        shown = np.tanh(states @ d["a"])
        score = np.where(mask, shown @ d["v"], np.float32(-30))
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        mean = (share[:, :, None] * states).sum(axis=0)
        return mean @ d["w"] + d["o"][0], mean, share, shown

    def step(self, words: Words, chosen: np.ndarray, target: np.ndarray, adam: Adam) -> None:
        """One step of gradient descent on the chosen windows."""
        part, h, d = words.windows[chosen], _HIDDEN, self.dense
        used, local = np.unique(part, return_inverse=True)
        local = local.reshape(part.shape)
        gone = int(used[0] == -1)
        own = used[gone:]
        runs, runs_at = gather(words.runs, words.runs_at[own], words.runs_at[own + 1])
        count = np.diff(runs_at)
        inputs = np.zeros((len(used), _WORD + _CHARS), np.float32)
        inputs[gone:, :_WORD] = self.words[words.bucket[own]]
        inputs[gone:, _WORD:] = np.add.reduceat(self.chars[runs], runs_at[:-1], axis=0) / count[:, None]
        mask = (part >= 0).T
        x = inputs[local.T]
        saved, states = {}, []
        for s in "fb":
            state, out, kept = np.zeros((len(part), h), np.float32), np.empty((WINDOW, len(part), h), np.float32), [None] * WINDOW
            g_all = x @ d[f"x{s}"] + d[f"b{s}"]
            for t in range(WINDOW) if s == "f" else range(WINDOW - 1, -1, -1):
                u = state @ d[f"h{s}"]
                zr = _sigmoid(g_all[t, :, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(g_all[t, :, 2 * h :] + r * u[:, 2 * h :])
                kept[t] = (state, z, r, n, u[:, 2 * h :])
                state = np.where(mask[t][:, None], n + z * (state - n), state)
                out[t] = state
            saved[s] = kept
            states.append(out)
        both = np.concatenate(states, axis=2)
        logit, mean, share, shown = self._pool(both, mask)
        grads = {k: np.zeros_like(v) for k, v in d.items()}
        dl = ((_sigmoid(logit) - target) / len(part)).astype(np.float32)
        grads["w"], grads["o"][0] = mean.T @ dl, dl.sum()
        dmean = dl[:, None] * d["w"]
        dboth = share[:, :, None] * dmean
        dshare = (both * dmean).sum(axis=2)
        dscore = share * (dshare - (share * dshare).sum(axis=0)) * mask
        grads["v"] = np.einsum("tb,tba->a", dscore, shown)
        dshown = dscore[:, :, None] * d["v"] * (1 - shown**2)
        grads["a"] = np.einsum("tbh,tba->ha", both, dshown)
        dboth = dboth + dshown @ d["a"].T
        dx = np.zeros_like(x)
        for i, s in enumerate("fb"):
            carry = np.zeros((len(part), h), np.float32)
            dg_all = np.zeros((WINDOW, len(part), 3 * h), np.float32)
            for t in range(WINDOW - 1, -1, -1) if s == "f" else range(WINDOW):
                before, z, r, n, un = saved[s][t]
                live = mask[t][:, None]
                dh = dboth[t, :, i * h : (i + 1) * h] + carry
                da = np.where(live, dh, 0)
                dn = da * (1 - z) * (1 - n**2)
                dz = da * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate((dz, dr, dn * r), axis=1)
                dg_all[t] = np.concatenate((dz, dr, dn), axis=1)
                grads[f"h{s}"] += before.T @ du
                carry = np.where(live, da * z + du @ d[f"h{s}"].T, dh)
            grads[f"x{s}"] = np.einsum("tbd,tbg->dg", x, dg_all)
            grads[f"b{s}"] = dg_all.sum(axis=(0, 1))
            dx += dg_all @ d[f"x{s}"].T
        dinput = np.zeros_like(inputs)
        np.add.at(dinput, local.T.ravel(), dx.reshape(-1, dx.shape[2]))
        dinput = dinput[gone:]
        adam.dense(d, grads)
        adam.rows("words", self.words, words.bucket[own], dinput[:, :_WORD])
        adam.rows("chars", self.chars, runs, np.repeat(dinput[:, _WORD:] / count[:, None], count, axis=0))


class Adam:
    """Adam for the dense weights; for embedding rows, gradients scaled by their history.

    Rows that ``known`` marks as seen in too few texts stay 0, so that no text is learnt by its rare words.
    """

    def __init__(self, known: dict[str, np.ndarray], rate: float = 0.01):
        self.known, self.rate, self.t, self.first, self.second, self.sums = known, rate, 0, {}, {}, {}

    def dense(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g**2
            weights[k] -= self.rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)

    def rows(self, name: str, table: np.ndarray, ids: np.ndarray, grads: np.ndarray) -> None:
        if name not in self.sums:
            self.sums[name] = np.full(len(table), 1e-8, np.float32)
        used, back = np.unique(ids, return_inverse=True)
        total = np.zeros((len(used), table.shape[1]), np.float32)
        np.add.at(total, back, grads)
        used, total = used[self.known[name][used]], total[self.known[name][used]]
        self.sums[name][used] += (total**2).mean(axis=1)
        table[used] -= 0.05 * total / np.sqrt(self.sums[name][used])[:, None]


def _highest(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Position of the highest window of each text, the first of equals."""
    out = np.empty(len(at) - 1, dtype=np.int64)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        out[k] = a + int(np.argmax(logits[a:b]))
    return out


def _known(words: Words, least: int = 3) -> dict[str, np.ndarray]:
    """Which buckets of words and of byte runs occur in at least so many texts."""
    window, column = np.nonzero(words.windows >= 0)
    text = np.searchsorted(words.window_at, window, side="right") - 1
    pairs = np.unique(text.astype(np.int64) << 32 | words.windows[window, column])
    text, word = pairs >> 32, pairs & 0xFFFFFFFF
    runs, at = gather(words.runs, words.runs_at[word], words.runs_at[word + 1])
    out = {}
    for name, owner, bucket in (("words", text, words.bucket[word]), ("chars", np.repeat(text, np.diff(at)), runs)):
        found = np.unique(owner << 32 | bucket) & 0xFFFFFFFF
        out[name] = np.bincount(found, minlength=_BUCKETS) >= least
    return out


def train(texts: list[str], labels: list[int], check_texts: list[str], check_labels: list[int], epochs: int = 6, batch: int = 96, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    words, network = read_words(pa.array(texts, pa.string())), Network.new(rng)
    adam = Adam(_known(words))
    network.words[~adam.known["words"]] = 0
    network.chars[~adam.known["chars"]] = 0
    toxic = np.array(labels, dtype=bool)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.window_at))
    for epoch in range(epochs):
        if epoch == 0:
            own = np.flatnonzero(toxic[text_of])
            clean = np.flatnonzero(~toxic[text_of])
            chosen = rng.permutation(np.concatenate((own, rng.permutation(clean)[: 2 * len(own)])))
        else:
            top = _highest(network.logits(words), words.window_at)
            other = words.window_at[:-1] + rng.integers(0, np.diff(words.window_at))
            # toxic documents are rarer or not; both sides weigh about the same
            clean = np.concatenate((top[~toxic], other[~toxic]))
            times = max(1, round(len(clean) / max(1, toxic.sum())))
            chosen = rng.permutation(np.concatenate((np.repeat(top[toxic], min(times, 4)), clean)))
        adam.rate = 0.01 * (1 - epoch / (epochs + 1))
        for a in range(0, len(chosen), batch):
            part = chosen[a : a + batch]
            network.step(words, part, toxic[text_of[part]].astype(np.float32), adam)
    if len(set(check_labels)) == 2:
        held = read_words(pa.array(check_texts, pa.string()))
        logits = network.logits(held)
        network.curve = _fit_curve(logits[_highest(logits, held.window_at)].astype(float), np.array(check_labels, float))
    return network


def _fit_curve(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least log loss, slightly regularised, by Newton's method."""
    a, b = 1.0, 0.0
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = _sigmoid(np.clip(a * logit + b, -30, 30))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((p - target) * logit).sum() + 0.1 * (a - 1), (p - target).sum()])
        hessian = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(hessian, gradient)
        move *= min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        a, b = a - float(move[0]), b - float(move[1])
    return (a, b) if a > 0.05 else (1.0, 0.0)


def halved(rows: set[tuple[str, str, int]]) -> tuple[list, list]:
    """Rows (id as text, text, label) to train on and to fit the curve by: of each label, every other one by a hash.

    Each label's first row is one to train on, so both learn whatever the ids are and however few rows there are.
    """
    found = [], []
    for label in sorted({r[2] for r in rows}):
        own = sorted((r for r in rows if r[2] == label), key=lambda r: (zlib.crc32(r[0].encode()), r))
        for k in (0, 1):
            found[k].extend(own[k::2])
    return tuple(sorted(part) for part in found)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, toxic_docs: int = 1500, clean_docs: int = 3000, slice_chars: int = 1500) -> Network | float:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic) where ``learn`` on the labels' doc_id holds.

    Returns the share of label 1 if there are not both labels.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return float(sum(counts))  # no label at all or one: 0 or 1
    dice = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_docs / counts[1])).otherwise(min(1.0, clean_docs / counts[0]))
    # both labels of one document pass or fail by the larger share, so that they meet below
    chosen = known.where(dice < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(2 * (toxic_docs + clean_docs))
    places = F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("slice")), places) + 1
    cut = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), F.coalesce(start, F.lit(1)), F.lit(slice_chars)).alias("slice"))
    rows = cut.join(F.broadcast(chosen), "doc_id").limit(4 * (toxic_docs + clean_docs)).collect()  # chosen is bounded above
    train_rows, check_rows = halved({(str(r.doc_id), r.slice, r.toxic) for r in rows})
    if len({r[2] for r in train_rows}) < 2:
        return counts.get(1, 0) / sum(counts.values())
    return train([r[1] for r in train_rows], [r[2] for r in train_rows], [r[1] for r in check_rows], [r[2] for r in check_rows])


def score_toxicity(docs: DataFrame, model: Network | float, text: str = "text", with_text: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    results = ["score", "predicted"]
    (value,) = fresh([*docs.columns, *results], "_text")
    source = without(docs.withColumn(value, F.col(f"`{text}`")), results if with_text else [*results, text])
    schema = T.StructType([f for f in source.schema.fields if f.name != value] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrivals):
        model = shared.value
        for rows in batches(arrivals, value, _BATCH):
            if isinstance(model, float):
                scores = np.full(rows.num_rows, model)
            else:
                words = read_words(rows[value])
                best = np.maximum.reduceat(model.logits(words), words.window_at[:-1]).astype(float)
                a, b = model.curve
                scores = _sigmoid(np.clip(a * best + b, -30, 30))
                wordless = words.windows[words.window_at[:-1], 0] < 0
                scores[wordless] = np.minimum(scores[wordless], 0.49)
            yield from rows.drop_columns([value]).append_column("score", pa.array(scores)).combine_chunks().to_batches()

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with ``score`` and ``predicted``; ids whose crc32 leaves 0 modulo 5 are held out of learning."""
    return score_toxicity(docs, fit_toxicity(docs.select("doc_id", "text"), labels, ~held_out("doc_id", 5)))
