"""Encoding and counting against the libraries, which the operators do not use."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from talkgauge.llm import counts, pieces
from tests.llm.conftest import odd_texts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = " \n\t▁'''strvlemdSTRaeinothr,.éñßΣİ中я🙂0123AZ\"́\x85\x1c\xa0½²"


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def noise(n: int, most: int) -> list[str]:
    rng = random.Random(8)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(PIECES)


def test_pieces_agree_with_the_library(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(odd_docs, PIECES, with_ids=True)
    assert [c for c in got.columns if c.lower() == "n_tokens"] == ["n_tokens"] and "_text" in got.columns and "spans" in got.columns
    rows = got.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()
    want = Counter()
    for doc_id, text, _ in odd_texts():
        ids = library.encode(text or "")
        want[doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(sha(",".join(map(str, r.ids))) == r.ids_sha256 for r in rows)


def test_pieces_of_noise_and_runs_of_spaces(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = noise(1500, 50) + [a + " " * n + b for n in range(1, 70) for a, b in (("", ""), ("x", "b"), ("x", "中"))]
    import pyarrow as pa

    ids, ids_at, parts, at = pieces.encode_texts(model, pa.array([" " + t.replace("▁", " ") if t else "" for t in texts]))
    got = [[i for k in parts[a:b].tolist() for i in ids[ids_at[k] : ids_at[k + 1]].tolist()] for a, b in zip(at, at[1:])]
    assert got == library.encode(texts)
    assert [pieces.decode_ids(model, x) for x in got] == library.decode(got)


def test_counts_agree_with_the_library(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    rows = counts.count_tokens(odd_docs, WORDS, limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = Counter()
    for doc_id, text, _ in odd_texts():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, rows)) == want
    assert counts.count_tokens(no_docs, WORDS).count() == 0 and pieces.encode_pieces(no_docs, PIECES).count() == 0


def test_counts_of_noise_with_a_small_transducer(monkeypatch):
    monkeypatch.setattr(counts, "MOST_STATES", 200)  # compiled states are dropped again and again
    library, counter = Tokenizer.from_file(WORDS), counts.Counter(counts.WordTokenizer.load(WORDS))
    texts = noise(1200, 40) + ["'s't're've'll'd 'r 'l'l 'v1", "<|endoftext|>" * 3, "a<|startoftext|>'S"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [n for a in range(0, len(texts), 200) for n in counter.count(texts[a : a + 200]).tolist()]
    assert got == want


def test_scan_does_not_depend_on_chunks(monkeypatch):
    import numpy as np

    step, mark = counts.scanner_tables()
    classes = np.append(np.random.default_rng(2).integers(0, 10, 5000).astype(np.uint8), 0).astype(np.uint8)
    whole = counts.scan(classes, step, mark)
    monkeypatch.setattr(counts, "_CHUNK", 3)
    assert (counts.scan(classes, step, mark) == whole).all()


def test_special_strings_of_any_form():
    """Added tokens without a common beginning, one of them the beginning of another."""
    library, own = Tokenizer.from_file(WORDS), counts.WordTokenizer.load(WORDS)
    more = ["[A]", "[A]B", "§§"]
    library.add_special_tokens(more)
    counter = counts.Counter(counts.WordTokenizer(own.merges, [*own.specials, *more], own.key))
    texts = ["a[A]b [A]B c", "[A][A]B[A]", "§§§ §", "x<|endoftext|>[A]", "[a] plain [A", "", "Ä[A]B Ö §§"]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    bare = counts.Counter(counts.WordTokenizer(own.merges, [], own.key))
    assert bare.count(["ab", ""]).tolist() == [len(library.encode("ab", add_special_tokens=False).ids), 0]
