"""The inverted index of catalogue names: which pieces are looked up, and what is exploded and shuffled."""

import random

import pytest

from talkgauge.operators import catalog

ITEMS = "item_id bigint, name string, category string, price double"
SEARCHES = "search_id int, query string, category string"


@pytest.fixture(scope="module")
def menu(spark):
    rng = random.Random(3)
    words = ["pizza", "Pie", "ПИЦЦА", "soup", "aaa", "a", "ab", ""]
    rows = [(k, "the best " + " ".join(rng.choice(words) for _ in range(rng.randrange(4))), rng.choice(["Food", "foot", "", None]), 1.0) for k in range(300)]
    rows += [(300, None, "food", 2.0), (301, "", "food", None), (302, "the best zzz quiet", "food", 3.0)]
    return spark.createDataFrame(rows, ITEMS), rows


def brute(rows, searches):
    return sorted(
        (s, k)
        for s, query, category in searches
        if query is not None and category is not None
        for k, name, own, _ in rows
        if own is not None and category.lower() in own.lower()
        if query == "" or name is not None and query.lower() in name.lower()
    )


ASKED = [
    (0, "the best z", "food"), (1, "PIZZA pie", ""), (2, "пицца", "foo"), (3, "a", "t"), (4, "aaa a", ""), (5, "", "oo"),
    (6, "best qu", ""), (7, None, ""), (8, "ab", None), (9, "zzz q", "food"), (10, "PIZZA pie", ""), (11, "e b", "f"), (12, "not there", ""),
]


@pytest.mark.parametrize("share_rows", [1_000_000, 7])
def test_searches_equal_brute_force(spark, menu, share_rows):
    table, rows = menu
    searches = spark.createDataFrame(ASKED, SEARCHES)
    got = catalog.catalog_search(table, searches, share_rows=share_rows).collect()
    assert sorted((r.search_id, r.position) for r in got) == brute(rows, ASKED)


def test_stored_index_gives_the_same(spark, menu, tmp_path):
    table, rows = menu
    catalog.write_index(catalog.name_index(table), str(tmp_path / "i"))
    index = catalog.read_index(spark, str(tmp_path / "i"))
    got = catalog.catalog_search(table, spark.createDataFrame(ASKED, SEARCHES), index).collect()
    assert sorted((r.search_id, r.position) for r in got) == brute(rows, ASKED)


def test_the_rarest_piece_is_looked_up(spark, menu):
    table, rows = menu
    index = catalog.name_index(table)
    counts = {r.piece: r.n for r in index.frequencies.collect()}
    names = [(name or "").lower() for _, name, _, _ in rows]
    assert all(n == sum(piece in name for name in names) for piece, n in counts.items())
    queries = spark.createDataFrame([(q.lower(),) for _, q, _ in ASKED if q], "_query string")
    for r in catalog.rarest_pieces(queries, index.frequencies).collect():
        size = min(3, len(r._query))
        pieces = {r._query[k : k + size] for k in range(len(r._query) - size + 1)}
        assert r._piece in pieces and r._n == counts.get(r._piece, 0) == min(counts.get(p, 0) for p in pieces)
    # "the" is in nearly every name and is never asked while a rarer piece is there
    chosen = {r._query: r._piece for r in catalog.rarest_pieces(queries, index.frequencies).collect()}
    assert chosen["the best z"] in ("t z", " z") or counts[chosen["the best z"]] == 1


def test_only_ids_are_exploded(spark, menu):
    table, _ = menu
    assert catalog.name_index(table).postings.columns == ["item_id", "piece"]
    plan = catalog.catalog_search(table, spark.createDataFrame(ASKED, SEARCHES))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Generate explode" in line:
            assert "price" not in line and "item_category#" not in line.split("explode")[0]


def test_empty_catalogue_and_no_searches(spark, menu):
    table, _ = menu
    none = spark.createDataFrame([], SEARCHES)
    assert catalog.catalog_search(table, none).collect() == []
    assert catalog.catalog_search(table.where("false"), spark.createDataFrame(ASKED, SEARCHES)).collect() == []
