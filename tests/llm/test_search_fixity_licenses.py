"""Top-k search, replica audit and license notices against brute force on small tables."""

from __future__ import annotations

import textwrap

import numpy as np
import pytest

from talkgauge.llm import fixity, licenses, topk
from talkgauge.llm.queries import op9_top_inner_products


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, 1 + (k % 7), 8)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[50][1]) for k in range(30)]  # one common vector: ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2050, [0.0] * 8), (3000, [9.0, 9.0]), (None, [1.0] * 8)]
    return rows + [rows[100], (150, rows[151][1])]


@pytest.mark.parametrize("cell,block,bucket", [(16384, 2048, 512), (50, 4, 16)])
def test_top_k_by_brute_force(spark, monkeypatch, cell, block, bucket):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors()], "vec_id bigint, embedding array<double>, label int")
    rows = topk.quantised(frame)
    whole = [(r.vec_id, r.vector) for r in rows.collect()]
    assert len(whole) == 400 + 30 + 3 + 2  # an empty vector takes part
    got = topk.exact_top_k(rows, rows.where("vec_id % 50 = 0"), 5).collect()
    queries: dict[int, list] = {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for q, v in queries.items():
        best: dict[int, int] = {}
        for i, x in whole:
            if i != q:
                score = sum(a * b for a, b in zip(v, x))
                best[i] = max(best.get(i, score), score)
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_rows(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.exact_top_k(topk.quantised(none), topk.quantised(none)).count() == 0
    two = topk.quantised(spark.createDataFrame([(0, [0.5]), (7, [0.25])], "vec_id bigint, embedding array<float>"))
    assert [tuple(r) for r in topk.exact_top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 7, 128 * 64)]


def test_repeated_rows_and_ids_crowd_out_nothing(spark):
    rows = [(k, [float(k), 1.0]) for k in range(60)] + [(70, [90.0, 1.0])] * 10 + [(71, [80.0 + k, 1.0]) for k in range(10)]
    frame = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.exact_top_k(frame, frame.where("vec_id in (1, 59, 71)")).orderBy("query_id", "rank").collect()
    found = {q: [r.vec_id for r in got if r.query_id == q] for q in (1, 59, 71)}
    assert found == {1: [70, 71, 59, 58, 57], 59: [70, 71, 58, 57, 56], 71: [70, 59, 58, 57, 56]}


def test_every_row_is_a_query_and_a_candidate_of_its_own(spark, tmp_path):
    rng = np.random.default_rng(14)
    rows = [(k, rng.normal(0, 1, 4).tolist()) for k in range(160)]
    rows += [rows[k] for k in range(3, 160, 7)] + [rows[50], rows[100], rows[100], (100, rows[7][1]), (160, rows[7][1]), (161, None), (None, rows[7][1])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v and i is not None]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for m, (i, x) in enumerate(whole) if m != n)[:5]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert len(want) == 5 * 9  # 50, 100 and 150 stand several times
    assert sorted(map(tuple, op9_top_inner_products(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("bucket", [4, 16, 512])
def test_one_cell_with_many_rows_of_an_id(monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(12)
    for spread in (3, 100):
        base = rng.normal(0, 100, 4)
        grid = np.round(base + rng.normal(0, spread, (400, 4)))
        ids = rng.integers(0, 30, 400)
        queries, asked = np.round(base + rng.normal(0, spread, (12, 4))), np.arange(12)
        q, found, score = topk.bucket_search(ids, grid, asked, queries, 5)
        for n in range(12):
            scores = {i: int((grid[ids == i] @ queries[n]).max()) for i in set(ids.tolist()) - {n}}
            want = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:5]
            assert list(zip(found[q == n].tolist(), score[q == n].tolist())) == want


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-(2**31), 2**31, 16).tolist()) for k in range(200)] + [(500 + k, [2**31 - 1] * 15 + [k]) for k in range(6)]
    rows += [(600, [2**62, 2**62]), (601, [-(2**62), -(2**62)]), (602, []), (603, [-(2**63)]), (604, [])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.exact_top_k(frame, frame.where("vec_id % 50 = 0 or vec_id > 499"), 4)
    want = []
    for q, v in rows:
        if q % 50 == 0 or q > 499:
            scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, x)))), i) for i, x in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.quantised(spark.createDataFrame([(1, [1e17, -1e300])], "vec_id long, embedding array<double>")).first().vector == [2**63 - 1, -(2**63)]


def test_queries_are_sent_only_where_they_may_find_something(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 16)
    rng = np.random.default_rng(7)
    rows = [(k, np.round(rng.normal(0, 1, 4) * 1.3 ** (k % 30) * 10).astype(int).tolist()) for k in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    sent, real = [], topk._sent
    monkeypatch.setattr(topk, "_sent", lambda *a: sent.append((real(*a).count(), a[-2:])) or real(*a))
    got = topk.exact_top_k(frame, frame.where("vec_id % 50 = 0"), 5)
    grid = np.array([v for _, v in rows])
    want = []
    for q in range(0, 1200, 50):
        scores = sorted((-int(s), i) for i, s in enumerate(grid @ grid[q]) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    everything = 24 * sent[-1][1][1]  # each query to each cell
    assert sum(n for n, _ in sent) < 0.5 * everything


def test_coordinates_never_lose_a_vector():
    rng = np.random.default_rng(8)
    base = rng.normal(0, 100, 16)
    near = np.round(base + rng.normal(0, 3, (3000, 16)))  # cosines near 1: coordinate pruning at work
    ids = np.arange(3000)
    q, found, score = topk.bucket_search(ids, near, np.array([-1]), np.round(base)[None, :], 5)
    scores = near @ np.round(base)
    order = np.lexsort((ids, -scores))[:5]
    assert found.tolist() == ids[order].tolist() and score.tolist() == scores[order].tolist()


def replica(n: int) -> list[tuple]:
    return [(f"a{k % 3}", (k // 3) * 5000, f"record {k}") for k in range(n)]


def test_audit_finds_every_difference(spark):
    rows = replica(900)
    other = [(a, o, p + "!" if o == 15000 else p) for a, o, p in rows if not (a == "a1" and o == 55000)]
    other += [("a2", 77, "more"), ("new", 0, None)] + [rows[9]]
    frames = [fixity.leaves(spark.createDataFrame(r, "archive string, offset bigint, payload string")) for r in (rows, other)]
    got = {(r.archive, r.offset, r.status) for r in fixity.audit(*frames).collect()}
    assert got == {("a0", 15000, "corrupt"), ("a1", 15000, "corrupt"), ("a2", 15000, "corrupt"), ("a1", 55000, "missing"), ("a2", 77, "extra"), ("new", 0, "extra")}
    assert fixity.audit(frames[0], frames[0]).count() == 0
    none = frames[0].where("offset < 0")
    assert fixity.audit(none, none).count() == 0 and fixity.audit(frames[0], none).count() == 900


def test_trees_end_in_one_root(spark):
    frame = fixity.leaves(spark.createDataFrame(replica(2400), "archive string, offset bigint, payload string"))
    levels = {r.level: r["count"] for r in fixity.tree(frame).groupBy("level").count().collect()}
    assert levels[0] == 2400 and levels[max(levels)] == 3 and max(levels) >= 2


def test_page_records(spark):
    pages = [(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 40)) for k in range(300)] + [(5, "http://x/5", "<p>5</p>" * 5)] * 200 + [(None, None, None), (None, "u", "")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    from pyspark.sql import functions as F

    got = fixity.page_archives(frame, F.coalesce(F.col("page_id") == 5, F.lit(False)), F.coalesce(F.col("page_id") == 6, F.lit(False))).collect()
    assert len(got) == 302 and sum(r.copies for r in got) == len(pages)
    at = 0
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == at and (r.other_hash is None) == (r.page_id == 6) and (r.hash != r.other_hash) == (r.page_id in (5, 6))
        at += r.length


NOTICE = licenses.TEMPLATES["MIT-permission"]


def test_notices_and_their_differences(spark):
    changed = NOTICE.replace("free of charge, ", "").replace("any person", "every person")
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore.",
        2: "x\n" + changed + "\ny",
        3: "The license of this poem is long and has a warranty.",
        4: "All rights reserved.\nLicensed under the Apache License, Version 2.0.",
        5: None,
        6: "",
        7: "a " * 50_000 + "Licensed under CC BY-NC 4.0. " + "b " * 50_000,
        8: "ALL RIGHTS RESERVED",
        9: "Released under the MIT License.\n" * 300,
    }
    frame = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(8, texts[8], "x")], "doc_id bigint, text string, start string")
    found: dict[int, list] = {}
    for r in licenses.scan_licenses(frame).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {k: sorted({r.template for r in v}) for k, v in found.items()} == {1: ["MIT"], 2: ["MIT-permission"], 4: ["Apache-2.0", "reserved"], 7: ["CC-BY-NC-4.0"], 8: ["reserved"], 9: ["MIT"]}
    assert texts[1][found[1][0].start : found[1][0].end] == "Released under the MIT License"
    assert found[2][0].missing == ["free", "of", "charge", "any"] and found[2][0].added == ["every"] and found[2][0].matched < 1
    assert len(found[8]) == 2 and len(found[9]) == 300


def test_ranking_prefers_the_own_template():
    scanner = licenses.Scanner()
    assert all(scanner.ranked(wording)[0][1] == name for name, wording in licenses.TEMPLATES.items())


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_notices_wrapped_over_lines(name, sign):
    wording = licenses.TEMPLATES[name]
    lines = [sign + line for line in textwrap.wrap(wording, 16 if len(wording) < 120 else 70, break_on_hyphens=False, break_long_words=False)]
    for text in ("\n".join(lines), f"\n{sign}\n\n".join(lines), "\r\n".join(lines)):
        around = f"import os\n\n{text}\n\n\ndef main():\n    return 1\n"
        (hit,) = licenses.Scanner().scan(around)
        assert hit["template"] == name and hit["matched"] == 1 and not hit["missing"] and not hit["added"]
        assert around[hit["start"] : hit["end"]].split() == text[len(sign) :].rstrip('./"').split()


def brute_force(text: str) -> set[tuple[int, int, str]]:
    """The same rules without cue words and blocks: all places in the whole text, ranked by the bytes saved of their own words."""
    scanner = licenses.Scanner()
    spans = licenses.word_spans(text)
    words = licenses._words(text)
    taken, found = bytearray(len(words)), set()
    while True:
        hits = []
        for t in scanner.templates:
            best = [p for p in licenses._places(t.words, words) if not any(taken[p[0] : p[1]])]
            hits += [(-scanner.reductions(" ".join(words[a:b]), [t])[t.name][0], -n / len(t.words), a, t.name, b) for a, b, n in licenses._apart(best, taken)]
        if not hits:
            return found
        for _, _, a, name, b in sorted(hits):
            if not any(taken[a:b]):
                taken[a:b] = bytes([1]) * (b - a)
                found.add((int(spans[a, 0]), int(spans[b - 1, 1]), name))


@pytest.mark.parametrize("seed", range(6))
def test_whole_scans_by_brute_force(seed):
    """Exact, reworded and crowded notices amid prose that holds their rarest words."""
    rng = np.random.default_rng(seed)
    names = sorted(licenses.TEMPLATES)
    prose = [t for name in names for t in licenses._words(licenses.TEMPLATES[name])] + ["tree", "river", "house", "night"] * 40
    text, planted = [], []
    for _ in range(14):
        text += rng.choice(prose, int(rng.integers(0, 60))).tolist()
        name = names[int(rng.integers(len(names)))]
        words = licenses.TEMPLATES[name].split()
        for k in rng.choice(len(words), int(len(words) * rng.choice([0, 0.05, 0.12])), replace=False).tolist():
            words[k] = "changed"
        planted.append(name)
        text += words
    whole = " ".join(text)
    got = {(f["start"], f["end"], f["template"]) for f in licenses.Scanner().scan(whole)}
    assert got == brute_force(whole) and len(got) >= len(planted) - 1


def test_every_place_holds_a_cue_word():
    for t in licenses.Scanner().templates:
        assert sum(t.words.count(w) for w in t.cues) > len(t.words) - t.need


def test_each_block_is_compressed_with_every_template_of_its_size(monkeypatch):
    seen = []
    real = licenses.Scanner.reductions
    monkeypatch.setattr(licenses.Scanner, "reductions", lambda self, block, templates: seen.append((block, [t.name for t in templates])) or real(self, block, templates))
    scanner = licenses.Scanner()
    assert [f["template"] for f in scanner.scan("x " * 500 + licenses.TEMPLATES["CC-BY-SA-4.0"] + " y" * 500)] == ["CC-BY-SA-4.0"]
    sizes = {tuple(t.name for t in group): scanner.reach[size] for size, group in scanner.sizes.items()}
    blocks = [(block, tuple(names)) for block, names in seen if tuple(names) in sizes]
    rest = {block for block, names in seen if tuple(names) not in sizes}
    wording = " ".join(licenses._words(licenses.TEMPLATES["CC-BY-SA-4.0"]))
    assert {names for _, names in blocks} >= {names for names in sizes if set(names) & {"CC-BY-SA-4.0", "MIT", "Apache-2.0-header"}}
    assert all(len(block.split()) <= 2 * sizes[names] for block, names in blocks)
    assert rest == {wording}  # both licences of this kind fit: each is measured by the words alone


def test_the_ranking_decides_between_rivals(monkeypatch):
    """Both headers stand in each other's wording; what saves more bytes gets the place, whichever that is."""
    text = licenses.TEMPLATES["GPL-3.0-header"]
    assert [f["template"] for f in licenses.Scanner().scan(text)] == ["GPL-3.0-header"]
    real = licenses.Scanner.reductions
    monkeypatch.setattr(licenses.Scanner, "reductions", lambda *a: {k: (9999 if k == "AGPL-3.0-header" else n, s) for k, (n, s) in real(*a).items()})
    assert [f["template"] for f in licenses.Scanner().scan(text)] == ["AGPL-3.0-header"]


def test_own_templates_empty_tables_and_clashing_keys(spark):
    frame = spark.createDataFrame([("k", "Der Text ist frei wie der Wind."), (None, "text ist frei wie der"), ("z", None)], "template string, text string")
    got = licenses.scan_licenses(frame, "template", templates={"eigen": "Text ist frei wie"})
    assert [(r.template_, r.template) for r in got.collect()] == [("k", "eigen"), (None, "eigen")]
    assert licenses.scan_licenses(frame.where("template = '-'"), "template").count() == 0
    assert licenses.scan_licenses(frame, "text").count() == 0
    assert licenses.Scanner({}).scan("All rights reserved.") == []
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "..."})


def test_many_notices_in_one_text():
    text = "\n".join(licenses.TEMPLATES[n] for n in ("MIT", "reserved", "Apache-2.0", "CC-BY-4.0") * 300)
    assert len(licenses.Scanner().scan(text)) == 1200


def test_wrapped_notices_pass_the_filter_of_texts(spark):
    frame = spark.createDataFrame([(1, "/* All rights\n * reserved. */")], "doc_id bigint, text string")
    assert [r.template for r in licenses.scan_licenses(frame).collect()] == ["reserved"]


def found_in(text: str) -> list[tuple[str, str]]:
    return [(f["template"], text[f["start"] : f["end"]]) for f in licenses.Scanner().scan(text)]


def test_a_reworded_notice_before_an_exact_one():
    exact, other = "Licensed under the Apache License, Version 2.0", "Licensed under the Apache Software License, Version 2.0"
    assert found_in(f"{other}.\n{exact}.") == [("Apache-2.0", other), ("Apache-2.0", exact)]
    assert found_in(f"{exact}.\n{other}.\n{exact}.") == [("Apache-2.0", exact), ("Apache-2.0", other), ("Apache-2.0", exact)]


@pytest.mark.parametrize("step,matched", [(10, 79), (7, 75), (6, None)])
def test_changes_spread_over_a_notice(step, matched):
    words = licenses._words(NOTICE)
    hits = licenses.Scanner().scan(" ".join("other" if k % step == step - 1 else w for k, w in enumerate(words)))
    assert [f["matched"] for f in hits if f["template"] == "MIT-permission"] == ([matched / len(words)] if matched else [])


def test_places_by_trying_every_range():
    rng = np.random.default_rng(6)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    for _ in range(40):
        wording = rng.choice(list("abcd"), 8).tolist()
        words = rng.choice(list("abcde"), 30).tolist()
        want = {(a, b): common(words[a:b], wording) for a in range(30) for b in range(a + 1, 31)}
        want = {p: c for p, c in want.items() if c >= 0.85 * 8 and p[1] - p[0] - c <= 2}
        got = {(a, b): c for a, b, c in licenses._places(wording, words)}
        assert got.items() <= want.items()
        assert all(any(a <= x and y <= b and c >= n for (x, y), c in got.items()) for (a, b), n in want.items())
        for a, b in got:
            missing, added = licenses._difference(wording, words[a:b])
            assert 8 - len(missing) == b - a - len(added) == got[a, b]


@pytest.mark.parametrize("name", ["reserved", "MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"])
def test_notices_amid_many_cues_and_no_line_breaks(name):
    rng = np.random.default_rng(9)
    wording = licenses.TEMPLATES[name]
    for _ in range(20):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 10))) for _ in range(1400)]
        words[::60] = ["copyright"] * len(words[::60])
        middle = int(rng.integers(200, 1200))
        text = " ".join([*words[:middle], wording, *words[middle:]])
        assert found_in(text) == [(name, wording.rstrip("."))]
