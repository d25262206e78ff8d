"""Manifest, hard negatives and chat formatting against plain versions on awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkgauge.llm import chats, manifest, negatives, ranks

# --- places ---------------------------------------------------------------------


def test_places_in_groups_over_several_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(30)]), "same") for _ in range(900)]
    frame = spark.createDataFrame(rows, "g string, o int, x string").repartition(5)
    found = ranks.placed(frame, ["g"], ["o"], "test").collect()
    for group in {r[0] for r in rows}:
        own = sorted((r.place, r.o) for r in found if r.g == group)
        assert [p for p, _ in own] == list(range(sum(r[0] == group for r in rows)))
        order = [(o is not None, o or 0) for _, o in own]
        assert order == sorted(order)
        assert {r.size for r in found if r.g == group} == {len(own)}
    assert ranks.placed(frame.where("false"), ["g"], ["o"], "test").count() == 0


# --- manifest -------------------------------------------------------------------

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, TREE string, place int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves):
    """The root, and for each leaf the siblings (left, right) of each step."""
    nodes, below, way = list(leaves), [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for x in below[a + k]:
                    way[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest(*run))
            held.append([x for own in below[a : a + 8] for x in own])
        nodes, below = up, held
    return nodes[0], way


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, top = plain_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, top):
        for (row, own), way in zip(groups[g], trees[g][1]):
            node, text = own, row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf(*row[:4], None if text is None else text.translate(LOWER))
            for left, right in [*way, *above]:
                node = digest(left, node, right)
            proof = digest(*[left + right for left, right in [*way, *above]])
            out.append((row[0], own, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def run_manifest(spark, rows):
    frame = spark.createDataFrame([(*r, "mine", "mine", 1) for r in rows], DOCS)
    found = manifest.document_manifest(frame).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, found.collect()), key=repr)


def odd_rows():
    rng = random.Random(4)
    # 65 rows need three levels, 9 a run of one, others end earlier; one group is null, one empty, one not ASCII
    sizes = {"en": 65, "de": 9, "": 8, None: 3, "ä": 1, "z": 2}
    rows = [(1000 * k + n, rng.choice(["s", "", None]), g, rng.choice([None, 5]), rng.choice(["Some Text", "no capitals", "", None, "ÄÖ Z"])) for k, (g, size) in enumerate(sizes.items()) for n in range(size)]
    return rows + [(None, None, None, None, None), (None, "s", "en", 1, "X"), (7, "s", "de", 1, "twice"), (7, "s", "de", 1, "twice"), (7, "s", "de", 2, "again"), (8, "s", "de", 1, "Long " * 30_000)]


def test_manifest_equals_a_plain_one(spark):
    rows = odd_rows()
    got, want = run_manifest(spark, rows), plain_manifest(rows)
    assert got == want
    changed = [r for r in want if not r[-1]]
    assert 0 < len(changed) < len(want)


@pytest.mark.parametrize("rows", [[(1, "s", "en", 1, "A")], [(k, "s", "en", 1, "A") for k in range(9)], [(1, "s", "en", 1, "A"), (2, "s", None, 1, None)], []])
def test_manifest_of_small_tables(spark, rows):
    assert run_manifest(spark, rows) == plain_manifest(rows) if rows else run_manifest(spark, rows) == []


def test_slots_without_the_own_one_are_the_siblings(spark):
    leaves = spark.createDataFrame([("t", k, f"<{k}>", 11) for k in range(11)], "tree string, place bigint, digest string, size bigint")
    levels, tops = manifest.levels(leaves, "test")
    assert [level.count() for level in levels] == [2, 1]
    low = {r.place: r for r in levels[0].collect()}
    assert low[1].s2 == "<10>" and low[1].s3 is None and low[0].digest == digest(*[f"<{k}>" for k in range(8)])
    assert tops.first().digest == digest(low[0].digest, low[1].digest)


# --- hard negatives ----------------------------------------------------------------

ROWS = "vec_id bigint, embedding array<float>, label int, score string, part int, anchor_id string"


def plain_negatives(rows):
    one = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        whole = [int(np.floor(256.0 * float(np.float32(x)))) for x in vector]
        one[vec_id] = min(one.get(vec_id, (label, whole)), (label, whole))
    out = []
    for q, (label, vector) in one.items():
        if q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, own) for i, (own, v) in one.items() if i != q)
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(i, s) for s, i, own in scored if own != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(q, positive, k + 1, i, -p, -s) for k, (i, s) in enumerate(fits)]
    return sorted(out)


def vectors(rng, n, width=6, labels=4):
    return [(int(k), [float(x) for x in rng.normal(size=width).astype(np.float32)], int(rng.integers(labels))) for k in range(n)]


def run_negatives(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], ROWS).repartition(3)
    found = negatives.mine_negatives(negatives.labelled(frame), F.col("vec_id") % 100 == 0, **how)
    return sorted(map(tuple, found.collect()))


def test_negatives_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 460)
    rows += [(600, rows[3][1], 1), (601, rows[3][1], 1), (602, rows[3][1], 2), (603, rows[3][1], 2)]  # ties
    rows += [rows[200], rows[200], (200, rows[5][1], 3), (None, rows[1][1], 1), (605, None, 1), (700, rows[1][1], None)]
    rows += [(606, [float("nan")] * 6, 1), (607, [1.0, None], 1), (608, [], 1), (800, [], 2), (609, [2.0], 1), (610, [1.0] * 9, 0), (611, [float("inf")], 0)]
    want = plain_negatives(rows)
    assert len(want) > 100
    assert run_negatives(spark, rows) == want
    assert run_negatives(spark, rows, block_rows=16, part_rows=40) == want


def test_negatives_with_a_hot_vector_and_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 300, 4)
    rows += [(1000 + k, rows[8][1], 1) for k in range(200)]
    monkeypatch.setattr(negatives, "ROUND_BYTES", 4 * 8 * 2)  # two anchors a round
    assert run_negatives(spark, rows, block_rows=32, part_rows=64) == plain_negatives(rows)


def test_negatives_of_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(size=5) * 3e6], int(rng.integers(3))) for k in range(120)]
    want = plain_negatives(rows)
    assert max(abs(r[-1]) for r in want) > 2**53
    assert run_negatives(spark, rows) == want


def test_negatives_of_nothing(spark):
    assert run_negatives(spark, []) == []
    assert run_negatives(spark, [(1, [1.0], 1)]) == []
    assert run_negatives(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == []


def test_the_curve_goes_from_neighbour_to_neighbour():
    for width, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * width, indexing="ij"), axis=-1).reshape(-1, width)
        place = negatives.hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(side**width))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold_and_leave_blocks_out(spark):
    rng = np.random.default_rng(7)
    block = rng.integers(-300, 300, size=(50, 8)).astype(float)
    queries = rng.integers(-300, 300, size=(20, 8)).astype(float)
    least, most = negatives.bounds(queries, block.min(axis=0)[None], block.max(axis=0)[None])
    scores = negatives.products(queries, block)
    assert (scores >= least).all() and (scores <= most).all()
    # clusters far apart: most parts cannot reach the thresholds and are not read
    centres = rng.normal(size=(16, 8)) * 20
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 16] + rng.normal(size=8) / 50], int(k % 16 // 2)) for k in range(1600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    blocks = negatives.Blocks(negatives.labelled(frame), F.col("vec_id") % 100 == 0, 20, 100)
    asked = negatives.Round(next(iter(blocks.anchors(next(iter(blocks.rounds()))))), blocks.width)
    n = len(asked.ids)
    asked.look_for(np.arange(n), np.zeros(n, np.int64), np.full(n, negatives.NONE + 1), np.full(n, np.iinfo(np.int64).max), 5)
    negatives._searched(blocks, asked, 5).collect()
    seen = asked.wanted(blocks.low, blocks.high, blocks.least_label, blocks.greatest_label, asked.least)
    assert len(blocks.parts) >= 10 and seen.mean() < 0.3
    assert run_negatives(spark, rows) == plain_negatives(rows)


# --- chats ------------------------------------------------------------------------

CONTROL = "\\### Assistant: </turn> ok"
MESSAGES = "tree_id string, message_id bigint, parent_id bigint, score double, role string, text string, tree string, at string"


def plain_paths(messages, branches):
    """The best root-to-leaf paths of each tree, as lists of ids, best first."""
    out = {}
    for tree in {m[0] for m in messages}:
        own = {}
        for _, i, parent, score, *_ in (m for m in messages if m[0] == tree and m[1] is not None):
            row = ((parent is not None, parent or 0), score is not None, score or 0.0, parent)
            own[i] = min(own.get(i, row), row)
        parents = {i: (row[3] if row[3] in own else None) for i, row in own.items()}
        leaves = set(own) - {p for p in parents.values() if p is not None}
        paths = []
        for i in leaves:
            path, at = [], i
            while at is not None and at not in path:
                path.append(at)
                at = parents[at]
            if at is None:
                scores = [own[k][2] for k in path]
                paths.append((-sum(scores) / len(scores), -len(path), i, path[::-1]))
        out[tree] = [p[3] for p in sorted(paths)[:branches]]
    return out


def run_paths(spark, messages, branches):
    frame = spark.createDataFrame([(*m, "mine", "mine") for m in messages], MESSAGES)
    found = {}
    for r in chats.chosen_paths(frame, branches).collect():
        found.setdefault((r.tree, r.branch), {})[r["at"]] = r.id
    return {key: [path[k] for k in range(len(path))] for key, path in found.items()}, frame


def tree_of(rng, name, n, wide):
    rows = [(name, 0, None, 1.0, "user", "root")]
    for k in range(1, n):
        rows.append((name, k, rng.randrange(max(0, k - wide), k), rng.choice([0.0, 0.25, 0.5, 1.0]), rng.choice(["user", "assistant"]), f"text {k}"))
    return rows


def odd_trees():
    rng = random.Random(8)
    rows = tree_of(rng, "bushy", 60, 60) + tree_of(rng, "deep", 70, 2) + [(None, k, k - 1 if k else None, None, "user", "x") for k in range(5)]
    rows += [("cycle", 1, 3, 1.0, "user", "a"), ("cycle", 2, 1, 1.0, "user", "b"), ("cycle", 3, 2, 1.0, "user", "c"), ("cycle", 4, 3, 1.0, "user", "d"), ("cycle", 9, None, 0.5, "user", "alone")]
    rows += [("orphan", 5, 77, 1.0, None, None), ("orphan", 6, 5, 0.5, "tool", ""), ("orphan", None, 5, 9.0, "user", "no id")]
    rows += [("twice", 1, None, 0.5, "user", "a"), ("twice", 1, None, 0.5, "user", "a"), ("twice", 2, 1, 0.5, "assistant", "b"), ("twice", 2, 1, 0.75, "assistant", "c"), ("twice", 3, 1, 0.5, "assistant", "tie")]
    return rows + [("", 1, None, 1.0, "assistant", CONTROL)]


@pytest.mark.parametrize("branches", [1, 3])
def test_best_branches_equal_plain_walks(spark, branches):
    messages = odd_trees()
    got, _ = run_paths(spark, messages, branches)
    want = plain_paths(messages, branches)
    key = lambda tree: "-" if tree is None else f"={tree}"
    assert got == {(key(t), b + 1): path for t, paths in want.items() for b, path in enumerate(paths)}


def unfold(parts):
    """Turns and learnt texts of each conversation from its stored parts."""
    out = {}
    for r in sorted(parts, key=lambda r: (r.tree, r.branch, r.part)):
        turns, learnt = out.setdefault((r.tree, r.branch), ([], []))
        turns += list(chats.read_part(r.formatted))
        learnt += [chats.unescaped(r.formatted[s.start : s.start + s.chars]) for s in r.loss_spans]
    return out


def test_formatted_branches_read_back(spark):
    messages = odd_trees()
    _, frame = run_paths(spark, messages, 2)
    parts = chats.format_trees(frame, 2, part_turns=4)
    rows = parts.collect()
    found = unfold(rows)
    said = {}
    for tree, i, _, _, role, text in messages:
        row = ((role is not None, role or ""), (text is not None, text or ""))
        said[tree, i] = min(said.get((tree, i), row), row)
    for tree, paths in plain_paths(messages, 2).items():
        for branch, path in enumerate(paths):
            turns, learnt = found["-" if tree is None else f"={tree}", branch + 1]
            assert turns == [(said[tree, i][0][1], said[tree, i][1][1]) for i in path]
            assert learnt == [text for role, text in turns if role == "assistant"]
    assert max(r.parts for r in rows) > 1 and all(r.part < r.parts for r in rows)
    digests = {(r.tree, r.branch): r for r in chats.conversation_digests(parts).collect()}
    assert digests.keys() == found.keys()
    for key, (turns, learnt) in found.items():
        row = digests[key]
        assert row.turns_sha256 == digest(*[f"{role}\n{text}\n" for role, text in turns]) and row.n_turns == len(turns)
        assert row.loss_sha256 == digest(*learnt) and row.loss_chars == len("".join(learnt))
        assert row.formatted_chars == sum(len(r.formatted) for r in rows if (r.tree, r.branch) == key)


def test_linear_conversations_of_any_shape(spark):
    rng = random.Random(9)
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + CONTROL * (k % 3)) for k in range(130)]
    rows += [(2, None, None, None), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (None, 1, "user", "nobody's"), (3, 9, "system", "x" * 200_000), (4, -1, "assistant", "🙂é\\"), (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    frame = spark.createDataFrame([(*r, "mine") for r in shuffled], "conv_id bigint, turn bigint, role string, text string, message_id string").repartition(5)
    links, texts = chats.linear_messages(frame)
    parts = chats.format_paths(texts, chats.chosen_paths(links)).collect()
    found = unfold(parts)
    null_first = lambda v: (v is not None, v if v is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (null_first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns, learnt = found["-" if conv is None else f"={conv}", 1]
        assert turns == [(r[2] or "", r[3] or "") for r in own]
        assert learnt == [r[3] or "" for r in own if r[2] == "assistant"]
    assert len(found) == len({r[0] for r in rows})
    none = chats.linear_messages(frame.where("false"))
    assert chats.conversation_digests(chats.format_paths(none[1], chats.chosen_paths(none[0]))).count() == 0


PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "<", "/turn>", ":", "\n", ":\n", "### Assistant:", "a", "é", "role ", " "]), max_size=12).map("".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=20, max_size=20))
def test_escapes_are_reversible_and_hide_all_marks(spark, turns):
    frame = spark.createDataFrame([(k, role, text) for k, (role, text) in enumerate(turns)], "k int, role string, text string")
    rows = frame.select("k", chats.escaped(F.col("text")).alias("e"), F.concat(chats.head_of(F.col("role")), chats.escaped(F.col("text")), F.lit(chats.END)).alias("turn")).orderBy("k").collect()
    for (_, text), row in zip(turns, rows):
        assert chats.unescaped(row.e) == text
        assert "</turn>" not in row.e and "###" not in row.e
    assert list(chats.read_part("".join(r.turn for r in rows))) == turns
