"""Catalogue search, order totals and customer history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_GRAM = 3
# Postings of one piece that a single task looks up.
SHARE_ROWS = 1_000_000


def _grams_of(name: Column) -> Column:
    """Every distinct piece of a name that may serve as the search key of a query."""

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - size + 1)
        cut = F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))
        return F.when(F.length(name) >= size, cut).otherwise(F.array().cast("array<string>"))

    sizes = [pieces(size) for size in range(1, _GRAM + 1)]
    return F.array_distinct(F.concat(*sizes))


def _of_categories(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """Items of the categories that contain a pattern's category, by the pieces of category names."""
    names = items.select("item_category").distinct().withColumn("_own", F.lower("item_category"))
    pieces = F.concat(F.array(F.lit("")), _grams_of(F.col("_own")))
    keyed = patterns.withColumn("_gram", F.substring("_category", 1, _GRAM))
    found = (
        names.select("*", F.explode(pieces).alias("_gram"))
        .join(keyed, "_gram")
        .filter(F.col("_own").contains(F.col("_category")))
    )
    return items.join(found.select("item_category", "_query", "_category"), "item_category")


class Index(NamedTuple):
    """An inverted index of a catalogue's names.

    `postings(piece, item_id)` has each piece of up to three characters with the items that contain it,
    `frequencies(piece, n)` how many those are.
    """

    postings: DataFrame
    frequencies: DataFrame


def name_index(catalog: DataFrame) -> Index:
    """The index of `catalog(item_id, name)`; only ids are exploded."""
    postings = catalog.select("item_id", F.explode(_grams_of(F.lower("name"))).alias("piece"))
    return Index(postings, postings.groupBy("piece").agg(F.count("*").alias("n")))


def write_index(index: Index, path: str) -> None:
    """Store an index; postings are gathered by piece, so that a file holds few and its statistics prune."""
    index.postings.repartitionByRange("piece", "item_id").sortWithinPartitions("piece", "item_id").write.parquet(f"{path}/postings")
    index.frequencies.write.parquet(f"{path}/frequencies")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def rarest_pieces(queries: DataFrame, frequencies: DataFrame) -> DataFrame:
    """`_piece` and its frequency `_n` for each `_query`: of all its pieces the one that fewest names contain.

    A query of less than three characters is its own piece.  A piece that no name contains has
    frequency 0, and its query no match.
    """
    own = F.col("_query")
    starts = F.sequence(F.lit(1), F.greatest(F.length(own) - (_GRAM - 1), F.lit(1)))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(own, i, F.lit(_GRAM))))
    cut = queries.select("_query").distinct().select("_query", F.explode(pieces).alias("piece"))
    counted = cut.join(frequencies, "piece", "left").select("_query", "piece", F.coalesce("n", F.lit(0)).alias("n"))
    best = counted.groupBy("_query").agg(F.min(F.struct("n", "piece")).alias("_best"))
    return best.select("_query", F.col("_best.piece").alias("_piece"), F.col("_best.n").alias("_n"))


def _candidates(index: Index, chosen: DataFrame, share_rows: int) -> DataFrame:
    """`(_query, item_id)` of the items that contain a query's chosen piece.

    A piece of n postings is dealt to n / share_rows parts, to each of which its queries are sent; ordinary
    pieces have one.  There are at most as many dealt pieces as share_rows fit into all postings.
    """
    shares = F.ceil(F.col("n") / F.lit(share_rows)).cast("int")
    frequent = index.frequencies.filter(F.col("n") > share_rows).select("piece", shares.alias("_shares"))
    share = F.pmod(F.xxhash64("item_id"), F.coalesce("_shares", F.lit(1))).cast("int")
    dealt = index.postings.join(frequent, "piece", "left").select("piece", "item_id", share.alias("_share"))
    parts = F.greatest(F.ceil(F.col("_n") / F.lit(share_rows)).cast("int"), F.lit(1))
    asked = chosen.filter(F.col("_n") > 0).select(
        "_query", F.col("_piece").alias("piece"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_share")
    )
    return dealt.join(asked, ["piece", "_share"]).select("_query", "item_id")


def catalog_search(
    catalog: DataFrame, searches: DataFrame, index: Index | None = None, share_rows: int = SHARE_ROWS
) -> DataFrame:
    """Items whose name contains the query and whose category contains the category.

    `catalog(item_id, name, category, price)`, `searches(search_id, query, category)`;
    matching ignores case and an empty text matches everything.  One row per match, with
    `position` for catalogue order.  The substring test runs as equi-joins over an inverted index
    (`name_index`, or a stored one): each query looks up the rarest of its pieces, which gives ids of
    candidates; only those meet their names, categories and prices, and are verified.  Equal
    searches are looked up once.  An empty query asks for categories only, which are few, and needs no
    index.
    """
    wanted = searches.select(
        "search_id", F.lower("query").alias("_query"), F.lower("category").alias("_category")
    )
    patterns = wanted.select("_query", "_category").distinct()
    items = catalog.select(
        "item_id",
        "name",
        F.col("category").alias("item_category"),
        "price",
        F.lower("name").alias("_name"),
    )
    index = index or name_index(catalog)
    named = patterns.filter(F.col("_query") != "")
    found = _candidates(index, rarest_pieces(named, index.frequencies), share_rows)
    verified = found.join(items, "item_id").filter(F.col("_name").contains(F.col("_query")))
    by_name = verified.join(named, "_query").filter(F.lower("item_category").contains(F.col("_category")))
    columns = ["_query", "_category", "item_id", "name", "item_category", "price"]
    matches = by_name.select(*columns).unionByName(
        _of_categories(items, patterns.filter(F.col("_query") == "")).select(*columns)
    )
    return wanted.join(matches, ["_query", "_category"]).select(
        "search_id",
        F.col("item_id").alias("position"),
        "name",
        F.col("item_category").alias("category"),
        "price",
    )


def catalog_search_totals(matches: DataFrame, searches: DataFrame) -> DataFrame:
    """`total_found` of every search, 0 when nothing matched."""
    found = matches.groupBy("search_id").agg(F.count("*").alias("total_found"))
    return searches.select("search_id").join(found, "search_id", "left").select(
        "search_id", F.coalesce("total_found", F.lit(0)).alias("total_found")
    )


def order_total(items: Column) -> Column:
    """Total of an `array<struct<price, quantity>>`: price defaults to 0, quantity to 1."""
    zero = F.lit(0).cast("DECIMAL(28,2)")
    line = lambda i: (
        F.coalesce(i["price"], F.lit(0)).cast("DECIMAL(12,2)")
        * F.coalesce(i["quantity"], F.lit(1)).cast("DECIMAL(12,2)")
    )
    total = F.aggregate(items, zero, lambda acc, i: (acc + line(i)).cast("DECIMAL(28,2)"))
    return F.coalesce(total, zero)


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Total of each order from item rows `(order_id, price, quantity)`; 0 without items."""
    price = F.coalesce("price", F.lit(0)).cast("DECIMAL(12,2)")
    quantity = F.coalesce("quantity", F.lit(1)).cast("DECIMAL(12,2)")
    totals = items.groupBy("order_id").agg(
        F.sum(price * quantity).cast("DECIMAL(28,2)").alias("total_amount")
    )
    return orders.select("order_id").join(totals, "order_id", "left").select(
        "order_id",
        F.coalesce("total_amount", F.lit(0)).cast("DECIMAL(28,2)").alias("total_amount"),
    )


def customer_history(
    customers: DataFrame, orders: DataFrame, items: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Whether a customer is known, how many orders, last order date, two favourite items.

    `customers(customer_id)`, `orders(order_id, customer_id, order_date)`,
    `items(order_id, item_id, quantity)`, `catalog(item_id, name)`.  Favourites are ranked
    by quantity, then item id.  The top two are first taken within each task, so a customer
    with very many different items does not gather them in one place; names are looked up
    for the favourites only.
    """
    summary = orders.groupBy("customer_id").agg(
        F.count("*").alias("previous_orders"), F.max("order_date").alias("last_order_date")
    )
    bought = (
        items.join(orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id", "item_id")
        .agg(F.sum("quantity").alias("_quantity"))
    )
    rank = Window.partitionBy("customer_id").orderBy(F.desc("_quantity"), "item_id")
    top_two = bought.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= 2)
    favourites = (
        top_two.join(catalog.select("item_id", "name"), "item_id", "left")
        .groupBy("customer_id")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("name"))).alias("favorite_item_1"),
            F.max(F.when(F.col("_rank") == 2, F.col("name"))).alias("favorite_item_2"),
        )
    )
    known = F.col("previous_orders").isNotNull()
    return (
        customers.select("customer_id")
        .join(summary, "customer_id", "left")
        .join(favourites, "customer_id", "left")
        .select(
            "customer_id",
            F.when(known, "found").otherwise("not_found").alias("status"),
            F.coalesce("previous_orders", F.lit(0)).alias("previous_orders"),
            "favorite_item_1",
            "favorite_item_2",
            "last_order_date",
        )
    )
