"""Benchmark passages against a search of every window at every place."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from talkgauge.llm import decontaminate as d
from tests.llm.conftest import odd_texts, prose
from tests.llm.test_near import words


def tables() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(12)
    items = [(f"i{k}", prose(rng, "en", rng.randint(14, 40))) for k in range(12)]
    items += [("short", "Völlig eigene kurze Frage"), ("short2", "völlig EIGENE"), (None, prose(rng, "de", 20)), ("empty", "?!"), ("nothing", None), ("i3b", items[3][1]), ("i3", items[3][1])]
    docs = [(i, t) for i, t, _ in odd_texts()]
    for k in range(30):
        source = words(items[k % 13][1])
        cut = source[: rng.randint(1, len(source))]
        docs.append((500 + k, prose(rng, "en", rng.randint(0, 80)) + " " + " ".join(cut).upper() + ", " + prose(rng, "de", rng.randint(0, 400))))
    return docs, items


def brute(text: str | None, windows: dict[tuple, set[str]]) -> tuple:
    w = words(text)
    hit, items = set(), set()
    for size in {len(x) for x in windows}:
        for p in range(len(w) - size + 1):
            found = windows.get(tuple(w[p : p + size]))
            if found:
                hit.update(range(p, p + size))
                items |= found
    sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("part_words", [d.PART_WORDS, 60])
def test_hits_items_and_verdict(spark, monkeypatch, part_words):
    monkeypatch.setattr(d, "PART_WORDS", part_words)  # the small value searches the items in several parts and slices
    docs, items = tables()
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = words(text)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(name or "")
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, N_HIT string").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = d.find_benchmark(frame, bench)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *brute(t, windows)) for i, t in docs)
    assert any(r.longest > 13 for r in got) and all((r.longest > 0) == (r.n_items > 0) for r in got)
    kept = d.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not brute(t, windows)[4] for _, t in docs)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.find_benchmark(odd_docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert d.find_benchmark(no_docs, none).count() == 0


def test_suffixes_are_in_order():
    keys = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint64)
    order = d.suffix_array(keys)
    lists = [tuple(keys[k : k + 16].tolist()) for k in order]
    assert lists == sorted(lists) and sorted(order.tolist()) == list(range(3000))


def test_matches_across_shards(monkeypatch):
    monkeypatch.setattr(d, "_SHARD", 40)
    rng = np.random.default_rng(9)
    item = rng.integers(2, 1 << 60, 30).astype(np.uint64) << np.uint64(2)
    stream = np.concatenate([rng.integers(2, 1 << 60, 25).astype(np.uint64), item, item[:13], item[5:20]])
    windows = d.Windows.of([("a", item)])
    which, place = d.occurrences(stream, windows)
    got = {(int(p), int(windows.window[w])) for w, p in zip(which, place)}
    want = {(p, k) for p in range(len(stream) - 12) for k in range(18) if (stream[p : p + 13] == item[k : k + 13]).all()}
    assert got == want


def searched(texts: list[str], windows: d.Windows) -> list[dict]:
    import pyarrow as pa

    rows = pa.table({"text": pa.array(texts, pa.string()), "state": pa.array([None] * len(texts), d._ARROW_STATE)})
    return d._search(rows, "text", "state", windows)


def hashed(text: str) -> np.ndarray:
    import pyarrow as pa

    return d.texts_words(pa.array([text]))[0]


@pytest.mark.parametrize("pairs", [d._PAIRS, 7])
def test_longest_matches_by_trying_every_pair(monkeypatch, pairs):
    """Items that share passages, documents that repeat them: length, first place and first item."""
    monkeypatch.setattr(d, "_PAIRS", pairs)
    rng = random.Random(21)
    shared = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(13, 30))] for _ in range(4)]
    lists = {f"i{k}": [w for _ in range(rng.randint(1, 3)) for w in rng.choice(shared)] + [f"own{k}"] * (k % 3) for k in range(15)}
    lists |= {"twin": lists["i4"], "short": ["w1", "kurz"]}
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            source = rng.choice([*lists.values(), *shared])
            a = rng.randrange(len(source))
            parts += source[a : rng.randint(a, len(source))] + ["kurz"] * rng.randrange(2)
        docs.append(parts)
    windows = d.Windows.of([(name, hashed(" ".join(w))) for name, w in reversed(lists.items())])
    got = searched([" ".join(w) for w in docs], windows)
    several = 0
    for words_, row in zip(docs, got):
        best = (0, None, None)
        for p in range(len(words_)):
            for name, item in sorted(lists.items()):
                size = min(13, len(item))
                for s in range(max(1, len(item) - 12)):
                    n = 0
                    while p + n < len(words_) and s + n < len(item) and words_[p + n] == item[s + n]:
                        n += 1
                    if n >= size and n > best[0]:
                        best = (n, name, p)
        assert (row["longest"], row["longest_item"], row["longest_at"]) == best
        several += len(row["items"]) > 1
    assert several > 10


def test_a_phrase_of_all_items_repeated_often():
    """2,000 items share a phrase that one document repeats 5,000 times: never 80 million pairs at once."""
    import tracemalloc

    phrase = " ".join(f"geteilt{k}" for k in range(20))
    windows = d.Windows.of([(f"i{k:04}", hashed(f"{phrase} {' '.join(f'e{k}x{j}' for j in range(10))}")) for k in range(2000)])
    text = f"{phrase}. " * 5000 + f"{phrase} e77x0 e77x1 e77x2"
    tracemalloc.start()
    (row,) = searched([text], windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["spans"] == [0, 5001 * 20 + 3] and len(row["items"]) == 2000
    assert (row["longest"], row["longest_item"], row["longest_at"]) == (23, "i0077", 5000 * 20)
    assert peak < 300 << 20
