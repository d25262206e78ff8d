"""Near duplicates against all pairs, and components against a union of sets."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from talkgauge.llm import near
from tests.llm.conftest import odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def all_pairs(texts: list[str | None]) -> tuple[list[int], list[int]]:
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(sets))), [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root, links


@pytest.mark.parametrize("block,size,filter_bits", [(256, near._BLOCK_BYTES, near._FILTER_BITS), (7, 5000, (64, 128))])
def test_links_and_classes(spark, odd_docs, monkeypatch, block, size, filter_bits):
    monkeypatch.setattr(near, "_BLOCK", block)  # small blocks: the group of near copies is verified in parts
    monkeypatch.setattr(near, "_BLOCK_BYTES", size)
    monkeypatch.setattr(near, "_TASK_BYTES", 4 * size)
    monkeypatch.setattr(near, "_FILTER_BITS", filter_bits)  # a full filter lets all pass
    rows = odd_texts()
    root, links = all_pairs([t for _, t, _ in rows])
    members: dict[int, list] = {}
    for (doc_id, _, _), r in zip(rows, root):
        members.setdefault(r, []).append(doc_id)
    first = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    want = sorted(((i, first[r], n) for (i, _, _), r, n in zip(rows, root, links)), key=str)
    got = near.near_duplicates(odd_docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_keep_one_of_each_class(spark, odd_docs, no_docs):
    rows = odd_texts()
    root, links = all_pairs([t for _, t, _ in rows])
    kept = near.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = kept.collect()
    alone = sum(1 for n in links if not n)
    assert len(got) == alone + len({r for r, n in zip(root, links) if n})
    assert near.keep_one(no_docs).count() == 0 and near.near_duplicates(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands, rows = near.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 160
    with pytest.raises(ValueError):
        near.choose_bands(0.1, 0.99999999, 4)


def test_pairs_with_several_leaders_count_once():
    runs = np.arange(10, dtype=np.uint64).tobytes()
    group = pd.DataFrame({"node": [5, 6, 7], "block": [0, 0, 0], "runs": [runs] * 3, "copies": [1, 2, 1], "leaders": [[5, 9], [5, 9], [9]]})
    found = near._verify(group, 9, 0, 0, 800, 1000)
    assert found["texts"].tolist() == [1, 1, 2] and found["docs"].tolist() == [1, 1, 3] and found["root"].tolist() == [5, 5, 5]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == root


def test_work_is_cut_by_bytes(spark, monkeypatch):
    """60 near copies with sets of 40 kB: no piece of work holds more than two blocks of about 200 kB."""
    monkeypatch.setattr(near, "_BLOCK_BYTES", 200_000)
    monkeypatch.setattr(near, "_TASK_BYTES", 400_000)
    base = [f"w{k}" for k in range(5000)]
    docs = [(n, " ".join(base[:n] + ["neu"] + base[n + 1 :])) for n in range(0, 240, 4)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    works, real = [], near.stored
    monkeypatch.setattr(near, "stored", lambda f, label: works.append(w) or w if (w := real(f, label)) is not None and label == "near-work" else w)
    got = near.near_duplicates(frame).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 59)}
    pieces = [r.size for r in works[0].groupBy("leader", "low", "high").agg({"bytes": "sum"}).toDF("leader", "low", "high", "size").collect()]
    assert max(pieces) < 60 * 40_000 / 2 and len(pieces) > 50
