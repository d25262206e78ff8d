"""Find passages of benchmark items in documents by suffix arrays over the documents.

Each task turns its documents into suffix arrays of words, about a million suffixes each, sorted by
their first 16 words.  Every window of every item is searched in every array; matches are verified on
the full word hashes.  The longest verbatim match at a place is with a neighbour of the document's suffix among
the sorted suffixes of the items, so occurrences are never paired with all items that share a window; items are
looked up once for each window of a document, however often it occurs there.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window.
Words are 64-bit hashes of maximal runs of digits, letters and non-ASCII bytes, A-Z lower-cased.

The index of an item set is broadcast in parts of at most ``PART_WORDS`` words each; a larger item set
is searched ``PASS_PARTS`` parts after the other in one pass, and further passes over stored rows; the spans found
so far travel with each row.

Defined results: null and empty texts have no words, no hits and no items, and are not contaminated;
repeated rows are answered one by one; items of equal id count once, a null id reads as the empty
string; an item without words is never found; a result column replaces one of its name; of equally long matches the
earliest in the document counts, and there the first item by id; a match of more than half of ``PART_WORDS`` words
may be reported shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.frames import fresh, stored, without
from talkgauge.llm.text import batches, texts_words

WINDOW = 13
PART_WORDS = 1 << 21
PASS_PARTS = 4
_PAIRS = 1 << 20  # windows of documents and items that share them, looked at together
_SHARD = (1 << 20) - 2
_BATCH = 4 << 20
_HEAD = np.uint64(20)  # the upper 44 bits of a word's hash order the suffixes


@dataclass
class Windows:
    """Distinct windows of distinct item texts and where they stand in them."""

    words: np.ndarray  # all distinct item texts in a row, each followed by the hash 1
    window: np.ndarray  # position of one occurrence of each distinct window
    size: np.ndarray  # its words
    suffix: np.ndarray  # positions of all windows, grouped by window, in order of the suffixes that begin there
    suffix_at: np.ndarray
    item: np.ndarray  # the distinct item texts of each window
    item_at: np.ndarray
    text_of: np.ndarray  # the item text of each word
    names: list[list[str]]  # the ids of each item text

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]]) -> Windows:
        texts: dict[bytes, list[str]] = {}
        for name, words in sorted(items, key=lambda i: i[0]):
            if len(words):
                texts.setdefault(words.tobytes(), []).append(name)
        rows = [np.frombuffer(t, dtype=np.uint64) for t in texts]
        end = np.ones(1, dtype=np.uint64)
        words = np.concatenate([np.concatenate((r, end)) for r in rows]) if rows else np.zeros(0, np.uint64)
        text_of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
        starts, sizes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for r in rows:
            n = max(1, len(r) - WINDOW + 1)
            starts.append(np.arange(at, at + n))
            sizes.append(np.full(n, min(len(r), WINDOW)))
            at += len(r) + 1
        start, size = np.concatenate(starts), np.concatenate(sizes)
        padded = np.concatenate((words, np.zeros(WINDOW, np.uint64)))
        grid = padded[start[:, None] + np.arange(WINDOW)]
        grid[np.arange(WINDOW) >= size[:, None]] = 0
        _, first, group = np.unique(grid, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((suffix_ranks(words)[start], group))
        suffix_at = np.searchsorted(group[order], np.arange(len(first) + 1))
        held = np.unique(group * len(rows) + text_of[start]) if len(rows) else np.zeros(0, np.int64)
        item_at = np.searchsorted(held, np.arange(len(first) + 1) * len(rows))
        item = held % max(1, len(rows))
        return cls(words, start[first], size[first], start[order], suffix_at, item, item_at, text_of, [sorted(set(n)) for n in texts.values()])


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """The place of each suffix among all suffixes, by doubling to their whole length."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.ravel().astype(np.int64)
    depth = 1
    while depth < n and rank.max(initial=0) < n - 1:
        later = np.zeros(n, dtype=np.int64)
        later[: n - depth] = rank[depth:] + 1
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        rank = rank.ravel().astype(np.int64)
        depth *= 2
    return rank


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of all suffixes by their first 16 keys, by doubling; keys take at most 44 bits."""
    n = len(keys)
    index = np.arange(n, dtype=np.uint64)
    packed = np.sort(keys << _HEAD | index)
    rank = np.empty(n, dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    depth = 1
    while True:
        order = (packed & low).astype(np.int64)
        head = packed >> _HEAD
        ranks = np.concatenate(([0], np.cumsum(head[1:] != head[:-1]))).astype(np.uint64)
        if depth == 16 or ranks[-1] == n - 1:
            return order
        rank[order] = ranks
        later = np.zeros(n, dtype=np.uint64)
        later[: n - depth] = rank[depth:] + np.uint64(1)
        packed = np.sort(rank << np.uint64(40) | later << _HEAD | index)
        depth *= 2


def find(order: np.ndarray, keys: np.ndarray, wanted: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window wanted[start : start + size] the range of suffixes that begin with it."""
    first = keys[order]
    low, high = np.searchsorted(first, wanted[start]), np.searchsorted(first, wanted[start], side="right")
    n = len(keys)
    for d in range(1, WINDOW):
        live = np.flatnonzero((low < high) & (size > d))
        if not len(live):
            break
        goal = wanted[start[live] + d]
        bounds = []
        for strict in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                at = order[np.minimum(middle, n - 1)] + d
                key = np.where(at < n, keys[np.minimum(at, n - 1)], 0)
                right = open_ & ((key <= goal) if strict else (key < goal))
                a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
            bounds.append(a)
        low[live], high[live] = bounds
    return low, high


def occurrences(words: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and positions of all their occurrences among the words of many texts."""
    found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wanted = windows.words >> _HEAD
    for a in range(0, max(1, len(words) - WINDOW + 1), _SHARD - WINDOW):
        shard = words[a : a + _SHARD]
        if not len(shard) or not len(windows.window):
            break
        keys = shard >> _HEAD
        order = suffix_array(keys)
        low, high = find(order, keys, wanted, windows.window, windows.size)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        same = at + windows.size[which] <= len(shard)
        which, at = which[same], at[same]
        same = np.ones(len(at), dtype=bool)
        for d in range(WINDOW):
            inside = d < windows.size[which]
            same &= ~inside | (shard[np.minimum(at + d, len(shard) - 1)] == windows.words[np.minimum(windows.window[which] + d, len(windows.words) - 1)])
        found.append(which[same])
        places.append(at[same] + a)
    return np.concatenate(found), np.concatenate(places)


def _followed(words: np.ndarray, place: np.ndarray, windows: Windows, suffix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that agree from each place and suffix on, beyond the window, and whether the text's next word is smaller or ends it."""
    length = size.copy()
    below = np.zeros(len(place), dtype=bool)
    live = np.arange(len(place))
    while len(live):
        a, b = words[np.minimum(place[live] + length[live], len(words) - 1)], windows.words[np.minimum(suffix[live] + length[live], len(windows.words) - 1)]
        below[live] = a < b
        live = live[a == b]
        length[live] += 1
    return length, below


def _longest(words: np.ndarray, place: np.ndarray, which: np.ndarray, windows: Windows) -> np.ndarray:
    """Words of the longest match that begins at each place with a window.

    All suffixes that begin with the window are in order, so the best one stands beside the place where the
    document's own suffix would stand among them.
    """
    low, high = windows.suffix_at[which].copy(), windows.suffix_at[which + 1].copy()
    best = windows.size[which].copy()
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) >> 1
        length, below = _followed(words, place[live], windows, windows.suffix[middle], windows.size[which[live]])
        best[live] = np.maximum(best[live], length)
        high[live] = np.where(below, middle, high[live])
        low[live] = np.where(below, low[live], middle + 1)
    return best


def _shares(at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a list of windows into runs whose entries in a grouped list are at most ``_PAIRS``, or one window's."""
    total = np.concatenate(([0], np.cumsum(at[which + 1] - at[which])))
    i = 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, side="right")) - 1)
        yield i, j
        i = j


def _entries(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window all its entries in a grouped list: the window's number in ``which``, and the entry's position."""
    count = at[which + 1] - at[which]
    return np.repeat(np.arange(len(which)), count), np.repeat(at[which] - np.cumsum(count) + count, count) + np.arange(count.sum())


def _search(rows: pa.Table, text: str, state: str, windows: Windows) -> list[dict]:
    """The new state of each row."""
    hashes, at = texts_words(rows[text])
    n, total = len(at) - 1, len(hashes)
    ends = at[1:] + np.arange(n)  # each text is followed by the hash 0
    words = np.zeros(total + n, dtype=np.uint64)
    inside = np.ones(total + n, dtype=bool)
    inside[ends] = False
    words[inside] = hashes
    begins = at[:-1] + np.arange(n)
    which, place = occurrences(words, windows)
    flow = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(flow, place, 1)
    np.add.at(flow, place + windows.size[which], -1)
    hit = np.cumsum(flow)[:-1] > 0
    doc = np.searchsorted(begins, place, side="right") - 1
    best: dict[int, tuple] = {}
    items: dict[int, list[int]] = {}
    if len(which):
        n_windows, n_texts = len(windows.window), len(windows.names)
        once = np.unique(doc * n_windows + which)
        once_doc, once_window = once // n_windows, once % n_windows
        own = np.zeros(0, np.int64)
        for i, j in _shares(windows.item_at, once_window):
            pair, entry = _entries(windows.item_at, once_window[i:j])
            own = np.union1d(own, once_doc[i:j][pair] * n_texts + windows.item[entry])
        for d, t in zip((own // n_texts).tolist(), (own % n_texts).tolist()):
            items.setdefault(d, []).append(t)
        length = _longest(words, place, which, windows)
        order = np.lexsort((place, -length, doc))
        heads = order[np.unique(doc[order], return_index=True)[1]]
        for i, j in _shares(windows.suffix_at, which[heads]):
            part = heads[i:j]
            pair, entry = _entries(windows.suffix_at, which[part])
            as_long = _followed(words, place[part][pair], windows, windows.suffix[entry], windows.size[which[part]][pair])[0] == length[part][pair]
            first = np.full(len(part), n_texts)
            np.minimum.at(first, pair[as_long], windows.text_of[windows.suffix[entry[as_long]]])
            for k, t in zip(part.tolist(), first.tolist()):
                d = int(doc[k])
                best[d] = (int(length[k]), windows.names[t][0], int(place[k] - begins[d]))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    span_doc = np.searchsorted(begins, edges[::2], side="right") - 1
    spans: dict[int, list[int]] = {}
    for d, a, b in zip(span_doc.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
        spans.setdefault(d, []).extend((a - int(begins[d]), b - int(begins[d])))
    out = []
    for d, old in enumerate(rows[state].to_pylist()):
        old = old or {"spans": [], "items": [], "longest": 0, "longest_item": None, "longest_at": None}
        row = {"n_words": int(at[d + 1] - at[d]), **{k: old[k] for k in ("spans", "items", "longest", "longest_item", "longest_at")}}
        if d in spans:
            row["spans"] = _united(old["spans"], spans[d])
            row["items"] = sorted(set(old["items"]).union(*(windows.names[t] for t in items[d])))
            if (-best[d][0], best[d][2], best[d][1]) < (-old["longest"], old["longest_at"] or 0, old["longest_item"] or ""):
                row["longest"], row["longest_item"], row["longest_at"] = best[d]
        out.append(row)
    return out


def _united(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of spans [from, to, from, to, ...]."""
    if not a:
        return b
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out.extend((start, end))
    return out


_STATE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_at", T.LongType()),
])
_ARROW_STATE = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
    ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64()),
])


def _item_parts(benchmark: DataFrame, item: str, text: str) -> Iterator[Windows]:
    """Indexes over the items, each of about ``PART_WORDS`` words at most.

    An item of more words than that is cut into slices that overlap by one word less than a window.
    """

    def slices(arrivals):
        for rows in batches(arrivals, "text", _BATCH):
            words, at = texts_words(rows["text"])
            names, cuts, lists = [], [], []
            for name, a, b in zip(rows["item"].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for k, low in enumerate(range(a, max(a + 1, b - WINDOW + 1), PART_WORDS // 2)):
                    names.append(name)
                    cuts.append(k)
                    lists.append(words[low : min(b, low + PART_WORDS // 2 + WINDOW - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.int32()), pa.array(lists, pa.binary())], ["item", "cut", "words"])

    source = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))
    cut = stored(source.mapInArrow(slices, "item string, cut int, words binary"), "items")
    total = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = -(-total // (4 * PART_WORDS)) or 1  # half full on average, 8 bytes a word
    number = F.pmod(F.xxhash64("item", "cut"), F.lit(parts))
    for k in range(parts):
        rows = cut.where(number == k).select("item", "words").collect()
        yield Windows.of([(r.item, np.frombuffer(r.words, dtype=np.uint64)) for r in rows])


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", with_text: bool = True
) -> DataFrame:
    """Add per document the words hit by windows of the items, the items found and the longest match.

    New columns: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the ids, sorted and joined by
    commas), ``contaminated`` (hit words are 5 % of the words or more), ``longest`` (words of the
    longest verbatim match), ``longest_item``, ``longest_at`` (its first word) and ``spans`` (from, to,
    ... of the words hit).
    """
    results = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_at", "spans"]
    state, value = fresh([*docs.columns, *results], "_state", "_text")
    source = without(docs.withColumn(value, F.col(f"`{text}`")), results if with_text else [*results, text])
    found = source.withColumn(state, F.lit(None).cast(_STATE))
    session = docs.sparkSession.sparkContext
    for number, part in enumerate(_item_parts(benchmark, item, item_text)):
        if number and number % PASS_PARTS == 0:
            found = stored(found, "searched")
        shared = session.broadcast(part)

        def run(arrivals, shared=shared):
            for rows in batches(arrivals, value, _BATCH):
                new = pa.array(_search(rows, value, state, shared.value), _ARROW_STATE)
                yield from rows.set_column(rows.column_names.index(state), state, new).combine_chunks().to_batches()

        found = found.mapInArrow(run, found.schema)
    s = F.col(f"`{state}`")
    hits = F.aggregate(F.sequence(F.lit(0), F.size(s["spans"]) - 1, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get(s["spans"], i + 1) - F.get(s["spans"], i))
    n_hit = F.when(F.size(s["spans"]) > 0, hits).otherwise(F.lit(0).cast("long"))
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in (state, value)],
        s["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(s["items"])), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= s["n_words"])).alias("contaminated"),
        s["longest"].alias("longest"),
        s["longest_item"].alias("longest_item"),
        s["longest_at"].alias("longest_at"),
        s["spans"].alias("spans"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    (key,) = fresh(docs.columns, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key), F.col(f"`{text}`").alias("text"))
    found = find_benchmark(packed, benchmark, "text", item, item_text, with_text=False)
    return found.where(~F.col("contaminated")).select(f"{key}.*")
