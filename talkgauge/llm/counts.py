"""Count tokens by finite-state transducers compiled from a tokenizer file.

Two transducers read a text.  The *scanner* reads characters and marks where words begin: its few
states track letters, other signs and the apostrophes of contractions.  It runs over chunks of a whole
batch at once: for every chunk the map from each state to the state behind it is computed, the maps are
composed by a parallel prefix scan, and a second pass marks the words from the states then known.

The *word transducer* reads the bytes of a word.  Each transition carries the number of tokens by which
the encoding of the longer prefix exceeds that of the shorter one; the last byte of a word is a symbol
of its own and leads back to the start.  A state is what the rest of a word can depend on: the place in
the automaton of all tokens and, for each place where an unfinished token may have begun, the last token
before it and the tokens counted there.  States and transitions are compiled when a text first needs
them and dropped together when there are more than ``MOST_STATES``.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text
count one token each; repeated rows are answered one by one; a result column replaces one of its name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm import bpe
from talkgauge.llm.frames import fresh, without
from talkgauge.llm.text import batches, gather, word_hashes

MOST_STATES = 150_000
_BATCH = 6 << 20
_CHUNK = 256

# Classes of characters, then states of the scanner.
SPACE, LETTER, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E = range(10)
FRESH, WORD, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
_HERE, _BEFORE = 1, 2  # a word begins at this character, at the one before


def scanner_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each (state, class) for the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|number|other signs."""
    step, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, SHORT, R, V, L, E)
    for state in range(7):
        pending = _BEFORE if state >= QUOTED_R else 0  # a letter behind an apostrophe begins a word after all
        for kind in range(10):
            if kind in letters:
                step[state, kind], mark[state, kind] = WORD, 0 if state == WORD else (pending or _HERE)
            elif kind == NUMBER:
                step[state, kind], mark[state, kind] = FRESH, _HERE | pending
            elif kind == OTHER or kind == QUOTE:
                step[state, kind] = SIGNS if kind == OTHER or state in (SIGNS, QUOTED) else QUOTED
                mark[state, kind] = 0 if state in (SIGNS, QUOTED) else _HERE | pending
            else:
                step[state, kind], mark[state, kind] = FRESH, pending
    for kind, state in ((SHORT, FRESH), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        step[QUOTED, kind], mark[QUOTED, kind] = state, 0
    for state, kind in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        step[state, kind], mark[state, kind] = FRESH, 0
    return step.ravel(), mark.ravel()


def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
        elif kind == "Z":
            out[point] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for kind, signs in ((QUOTE, "'"), (SHORT, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        out[[ord(c) for c in signs]] = kind
    return out


def scan(classes: np.ndarray, step: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where words begin, by chunk maps, their prefix scan and a second pass; the text ends with a space."""
    n = len(classes)
    chunks = max(1, -(-n // _CHUNK))
    grid = np.zeros(chunks * _CHUNK, dtype=np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, _CHUNK).T)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], chunks, axis=1)
    for row in grid:
        maps = step[maps * np.uint8(10) + row]
    maps = np.ascontiguousarray(maps.T)
    reach = 1
    while reach < chunks:  # maps[k] becomes the map over chunks 0 to k
        later = maps.copy()
        later[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
        maps, reach = later, 2 * reach
    state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, FRESH]))
    marks = np.empty_like(grid)
    for k, row in enumerate(grid):
        at = state * np.uint8(10) + row
        marks[k] = mark[at]
        state = step[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    begins = (marks & _HERE) > 0
    begins[:-1] |= (marks[1:] & _BEFORE) > 0
    return begins


class WordTransducer:
    """Token counts of words; see the module's text for its states."""

    def __init__(self, merges: bpe.Merges):
        self.merges = merges
        self.rank, self.left, self.right = merges.rank.tolist(), merges.left.tolist(), merges.right.tolist()
        self.length, self.shorter, self.out, self.fail = merges.length.tolist(), merges.shorter.tolist(), merges.out.tolist(), merges.fail.tolist()
        filled = merges.step_map.keys >= 0
        self.child = dict(zip(merges.step_map.keys[filled].tolist(), merges.step_map.values[filled].tolist()))
        self.depth = self._depths()
        self.fits: dict[int, bool] = {}
        self.forget()

    def _depths(self) -> list[int]:
        depth = [0] * len(self.fail)
        for key in sorted(self.child, key=self.child.get):  # children are numbered after their parents
            depth[self.child[key]] = depth[key >> bpe._SHIFT] + 1
        return depth

    def forget(self) -> None:
        self.states: list[tuple] = [(0, ((0, -1, 0),))]
        self.numbers = {self.states[0]: 0}
        self.keys = np.full(1 << 16, -1, dtype=np.int64)
        self.next = np.zeros(1 << 16, dtype=np.int32)
        self.emitted = np.zeros(1 << 16, dtype=np.int32)
        self.filled = 0

    def _follows(self, a: int, b: int) -> bool:
        key = a << bpe._SHIFT | b
        if key not in self.fits:
            if len(self.fits) > 1 << 19:
                self.fits.clear()
            limit, rank, left, right, pairs = 1 << 40, self.rank, self.left, self.right, self.merges._pairs
            good = None
            while good is None:
                if pairs.get(a << bpe._SHIFT | b, limit) < limit:
                    good = False
                elif rank[a] < 0 and rank[b] < 0:
                    good = True
                elif rank[a] > rank[b]:
                    limit, a = rank[a], right[a]
                else:
                    limit, b = rank[b] + 1, left[b]
            self.fits[key] = good
        return self.fits[key]

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and emitted tokens of one transition."""
        node, open_ = self.states[state]
        before = {d: (token, n) for d, token, n in open_}
        shift, child, fail = bpe._SHIFT, self.child, self.fail
        while (after := child.get(node << shift | symbol)) is None and node:
            node = fail[node]
        after = after or 0
        token = self.out[after]
        while True:
            last, count = before[self.length[token] - 1]
            if last < 0 or self._follows(last, token):
                break
            token = self.shorter[token]
        emitted = count + 1
        if symbol >= 256:
            return 0, emitted
        chain, node = [(0, token, 0)], after
        while node:
            d = self.depth[node]
            last, count = before[d - 1]
            chain.append((d, last, count - emitted))
            node = fail[node]
        key = (after, tuple(chain))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, or of the empty places where they belong."""
        bits = len(self.keys).bit_length() - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            left = left[(found != keys[left]) & (found != -1)]
        return slot

    def _learn(self, keys: np.ndarray) -> None:
        while 2 * (self.filled + len(keys)) >= len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.next[full], self.emitted[full]
            size = 4 * len(self.keys)
            self.keys, self.next, self.emitted = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
            self._insert(*old)
        compiled = np.array([self.compile(k >> 9, k & 511) for k in keys.tolist()], dtype=np.int32)
        self._insert(keys, compiled[:, 0], compiled[:, 1])
        self.filled += len(keys)

    def _insert(self, keys: np.ndarray, after: np.ndarray, emitted: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left])
            self.keys[slot] = keys[left]  # of several for one slot the last one stays
            won = self.keys[slot] == keys[left]
            self.next[slot[won]], self.emitted[slot[won]] = after[left[won]], emitted[left[won]]
            left = left[~won]

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each word, given as bytes in a row and n + 1 offsets."""
        if len(self.states) > MOST_STATES:
            self.forget()
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        starts, falling = at[:-1][order], -sizes[order]
        symbols = data.astype(np.int64)
        symbols[at[1:] - 1] += 256
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for i in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(falling, -i))
            keys = state[:n] << 9 | symbols[starts[:n] + i]
            slot = self._slots(keys)
            missing = self.keys[slot] != keys
            if missing.any():
                self._learn(np.unique(keys[missing]))
                slot = self._slots(keys)
            total[:n] += self.emitted[slot]
            state[:n] = self.next[slot]
        out = np.empty_like(total)
        out[order] = total
        return out


@dataclass
class WordTokenizer:
    """What counting needs of a tokenizer file: its merges and special tokens."""

    merges: bpe.Merges
    specials: list[str]
    key: str  # digest of the file

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        """Read a file with merges of byte signs and word ends, lower case and dropped white space."""
        with open(path, "rb") as file:
            content = file.read()
        spec = json.loads(content)
        vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        specials = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        tokens = {}
        for token, number in vocabulary.items():
            if token not in specials:
                last = token.endswith(end)
                symbols = [byte_of[c] for c in (token[: -len(end)] if last else token)]
                if last:
                    symbols[-1] += 256
                tokens[number] = tuple(symbols)
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in spec["model"]["merges"]]
        return cls(bpe.Merges(tokens, merges), specials, hashlib.sha256(content).hexdigest())


class Counter:
    """Counts the tokens of texts; one per Python worker."""

    def __init__(self, tokenizer: WordTokenizer):
        self.words = WordTransducer(tokenizer.merges)
        self.step, self.mark = scanner_tables()
        self.classes = character_classes()
        longest_first = sorted(filter(None, tokenizer.specials), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.sign = os.path.commonprefix(longest_first)  # no special string without it

    def count(self, texts: list[str | None]) -> np.ndarray:
        extra = np.zeros(len(texts), dtype=np.int64)
        parts = []
        for k, text in enumerate(texts):
            text = text or ""
            if self.special and self.sign in text:
                extra[k] = len(self.special.findall(text))
                text = "\n".join(_lowered(p) for p in self.special.split(text))
            else:
                text = _lowered(text)
            parts.append(text + "\n")
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
        if not len(points):
            return extra
        classes = self.classes[points]
        begins = scan(classes, self.step, self.mark)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at_byte = np.concatenate(([0], np.cumsum(widths)))
        stops = np.flatnonzero(begins | (classes == SPACE))
        inside = begins[stops]
        starts, ends = at_byte[stops[:-1]][inside[:-1]], at_byte[stops[1:]][inside[:-1]]
        data = np.frombuffer("".join(parts).encode(), dtype=np.uint8)
        _, first, word = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        tokens = self.words.count(*gather(data, starts[first], ends[first]))
        totals = np.concatenate(([0], np.cumsum(tokens[word])))
        edges = np.searchsorted(starts, at_byte[np.concatenate(([0], np.cumsum([len(p) for p in parts])))])
        return extra + totals[edges[1:]] - totals[edges[:-1]]


def _lowered(text: str) -> str:
    """Composed and lower-cased sign by sign, as the tokenizer's own normalisation does."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", with_text: bool = True) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    results = ["n_bytes", "n_tokens", "over_limit"]
    (value,) = fresh([*docs.columns, *results], "_text")
    source = without(docs.withColumn(value, F.col(f"`{text}`")), results if with_text else [*results, text])
    source = source.withColumn("n_bytes", F.coalesce(F.octet_length(value), F.lit(0)).cast("long"))
    schema = T.StructType([f for f in source.schema.fields if f.name != value] + [T.StructField("n_tokens", T.LongType())])
    tokenizer = WordTokenizer.load(tokenizer_path)
    shared, key = docs.sparkSession.sparkContext.broadcast(tokenizer), tokenizer.key

    def run(arrivals):
        from talkgauge.llm import counts

        if key not in counts._COUNTERS:  # a worker keeps what it has compiled for its next task
            counts._COUNTERS.clear()
            counts._COUNTERS[key] = counts.Counter(shared.value)
        counter = counts._COUNTERS[key]
        for rows in batches(arrivals, value, _BATCH):
            tokens = pa.array(counter.count(rows[value].to_pylist()), pa.int64())
            yield from rows.drop_columns([value]).append_column("n_tokens", tokens).combine_chunks().to_batches()

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
