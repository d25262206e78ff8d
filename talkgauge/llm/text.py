"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, letters and all bytes outside ASCII.
WORD_BYTES = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD_BYTES[_low : _high + 1] = False
WORD_BYTES[65:91] = True  # A-Z are lower-cased first

#: Bytes of words between white space.
SPACED_BYTES = np.ones(256, dtype=bool)
SPACED_BYTES[[0x20, *range(0x09, 0x0E)]] = False

_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16
_LOWER_TABLE = LOWER.tobytes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), 1)


def _grow(n: int) -> None:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        _POWER = _powers(_BASE, n)
        _INVERSE = _powers(pow(_BASE, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, wordy: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of the texts among the words."""
    inside = np.frombuffer(data.tobytes().translate(wordy.tobytes()), dtype=bool)
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kept = inside[cuts[:-1]]
    starts, ends = cuts[:-1][kept], cuts[1:][kept]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit polynomial hashes of the words, lower-cased if ``fold``, computed a few kilobytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP)))
        low, high = int(starts[i]), int(ends[j - 1])
        _grow(high - low + 1)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        part = data[low:high]
        if fold:
            part = np.frombuffer(part.tobytes().translate(_LOWER_TABLE), dtype=np.uint8)
        values = part.astype(np.uint64)
        values += np.uint64(1)
        values *= _POWER[: high - low]
        np.cumsum(values, out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * _INVERSE[s]
        i = j
    return mix(out)


def texts_words(column: pa.Array, wordy: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, and the offsets of the texts among them."""
    data, at = column_bytes(column)
    starts, ends, offsets = word_spans(data, at, wordy)
    return word_hashes(data, starts, ends), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their offsets; a shorter text is one run, an empty one none."""
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(runs)))
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size)]
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    full = np.zeros(len(words), np.uint64)
    for k in range(size):
        full += padded[k : k + len(words)] * factors[k]
    position = np.repeat(offsets[:-1] - at[:-1], runs) + np.arange(at[-1])
    out = full[position]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[offsets[i] : offsets[i + 1]]
        out[at[i]] = (own * np.array(factors[: len(own)])).sum()
    return mix(out), at


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices data[start:end] one after the other, and their n + 1 offsets."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


def batches(arrivals, column: str, most: int):
    """Join Arrow batches until their texts reach ``most`` bytes; yields tables of whole rows."""
    held, size = [], 0
    for batch in arrivals:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
