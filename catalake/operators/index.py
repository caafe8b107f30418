"""Indexes over current listings: cheapest, availability, catalogue, counts.

``ts`` and ``url`` give every listing one place in a total order, so that "first"
and "last" are defined. Each index is one aggregation with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order() -> Column:
    return F.struct("ts", "url")


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("removed"))


def positive(price: Column) -> Column:
    return F.coalesce((price > 0) & (price < float("inf")), F.lit(False))


def cheapest(rows: DataFrame, key: str = "sku", require_positive: bool = True) -> DataFrame:
    """The cheapest live listing of each key; of equal prices the first."""
    rows = live(rows)
    if require_positive:
        rows = rows.where(positive(F.col("price_num")))
    best = F.min_by(F.struct("store_label", "price_num"), F.struct("price_num", "ts", "url")).alias("b")
    return rows.groupBy(key).agg(best).select(key, F.col("b.store_label").alias("store_label"), F.col("b.price_num").alias("price_num"))


def availability(rows: DataFrame, key: str = "sku") -> DataFrame:
    """Stores that have the key now, its least price, the stores at that price, and an example's URL."""
    now = live(rows).groupBy(key).agg(
        F.array_sort(F.collect_set("store_label")).alias("stores"), F.min("price_num").alias("min_price"),
        F.collect_set(F.struct("price_num", "store_label")).alias("offers"), F.min_by("url", order()).alias("example_url"),
    )
    tied = F.array_sort(F.transform(F.filter("offers", lambda o: o["price_num"] == F.col("min_price")), lambda o: o["store_label"]))
    return now.select(key, "stores", "min_price", F.array_distinct(tied).alias("cheapest_stores"), "example_url")


def catalogue(rows: DataFrame, key: str = "sku") -> DataFrame:
    """One row a key: first name, cheapest live offer (else the first row's), live and former store sets, search text."""
    is_live = ~F.col("removed")
    offer = F.struct("price", "price_num", "store_label", "url")
    out = rows.groupBy(key).agg(
        F.min_by("name", F.when(F.col("name") != "", order())).alias("name"),
        F.coalesce(F.min_by(offer, F.when(is_live & F.col("price_num").isNotNull(), F.struct("price_num", "ts", "url"))), F.min_by(offer, order())).alias("offer"),
        F.array_sort(F.collect_set(F.when(is_live, F.col("store_label")))).alias("stores"), F.array_sort(F.collect_set("store_label")).alias("stores_ever"),
        F.min(F.col("removed")).alias("removed_everywhere"),
    )
    text = F.lower(F.concat_ws(" | ", key, "name", F.array_join("stores_ever", " | ")))
    return out.select(key, "name", F.col("offer.price").alias("cheapest_price"), F.col("offer.store_label").alias("cheapest_store"), F.col("offer.url").alias("sample_url"), "stores", "stores_ever", F.size("stores").alias("store_count"), F.size("stores_ever").alias("store_count_ever"), "removed_everywhere", text.alias("search_text"))


def live_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("removed")).alias("n_live"), F.countDistinct("store_label").alias("n_stores"))


def name_mode(rows: DataFrame, key: str = "sku", value: str = "name") -> DataFrame:
    """The most frequent value of each key, among live rows if there are any; ties go to the first seen, of equal times to the greatest value."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.count_if(~F.col("removed")).alias("n_live"), F.min(order()).alias("first"), F.min(F.when(~F.col("removed"), order())).alias("first_live"))
    best = lambda n, first: F.max_by(value, F.struct(n, -F.unix_micros(first["ts"].cast("timestamp")).alias("t"), value))
    picked = counted.groupBy(key).agg(F.max("n_live").alias("any_live"), best("n_live", F.coalesce("first_live", "first")).alias("live_mode"), best("n", F.col("first")).alias("all_mode"))
    return picked.select(key, F.when(F.col("any_live") > 0, F.col("live_mode")).otherwise(F.col("all_mode")).alias(value))


def first_url(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The URL of the first live listing, else of the first one."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by("url", F.when(~F.col("removed"), order())), F.min_by("url", order())).alias("url"))


def best_image(rows: DataFrame, key: str = "sku") -> DataFrame:
    """The image of the cheapest live listing that has one, else of the first listing that has one."""
    has = F.col("img") != ""
    return rows.groupBy(key).agg(F.coalesce(F.min_by("img", F.when(has & ~F.col("removed") & F.col("price_num").isNotNull(), F.struct("price_num", "ts", "url"))), F.min_by("img", F.when(has, order())), F.lit("")).alias("img"))


def price_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least price of live rows and of removed rows, apart."""
    return rows.groupBy(*keys).agg(F.min(F.when(~F.col("removed"), F.col("price_num"))).alias("live_min"), F.min(F.when(F.col("removed"), F.col("price_num"))).alias("removed_min"))


def latest(rows: DataFrame, keys: list[str], prefer_live: bool = True) -> DataFrame:
    """The last row of each key by time; of equal times a live one, then the one with the last URL."""
    rest = [c for c in rows.columns if c not in keys]
    # The order is the row's first fields, so that a row is carried once.
    rank = ["ts", *([(~F.col("removed")).alias("live_")] if prefer_live else []), "url"]
    row = F.struct(*rank, *[c for c in rest if c not in ("ts", "url")])
    return rows.groupBy(*keys).agg(F.max(row).alias("r")).select(*keys, "r.*").select(*rows.columns)


def duplicates(rows: DataFrame, key: str = "url") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(key)).alias("n_duplicates"))


def top_suggestions(catalog: DataFrame, n: int, mapped: DataFrame | None = None, pinned: str | None = None) -> DataFrame:
    """The n best rows by 2 stores + 1.2 priced + 1 named + 0.6 unknown, without mapped keys and the pinned one: a top-k report."""
    if mapped is not None:
        catalog = catalog.join(mapped.select("sku"), "sku", "left_anti")
    if pinned is not None:
        catalog = catalog.where(F.col("sku") != pinned)
    score = F.lit(2.0) * F.col("store_count") + F.when(F.col("cheapest_price") != "", 1.2).otherwise(0.0) + F.when(F.col("name") != "", 1.0).otherwise(0.0) + F.when(F.col("sku").startswith("u:"), 0.6).otherwise(0.0)
    return catalog.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "sku").limit(n)


def thumbnail(rows: DataFrame, names: DataFrame, key: str = "sku") -> DataFrame:
    """An image for each key's page, from its live rows, or from all where none is live: the cheapest row's, else the first row's of the key's best name, else the first one."""
    best = names.select(key, F.col("name").alias("best_name"))
    known = rows.join(best, key, "left").withColumn("img", F.nullif(F.trim("img"), F.lit("")))

    def pick(among: Column) -> Column:
        has = among & F.col("img").isNotNull()
        first = lambda which, by: F.min_by("img", F.when(has & which, by))
        return F.coalesce(first(F.col("price_num").isNotNull(), F.struct("price_num", "ts", "url")), first(F.col("name") == F.col("best_name"), order()), first(F.lit(True), order()), F.lit(""))

    now = ~F.col("removed")
    return known.groupBy(key).agg(F.max(now).alias("any_live"), pick(now).alias("of_live"), pick(F.lit(True)).alias("of_all")).select(key, F.when(F.col("any_live"), F.col("of_live")).otherwise(F.col("of_all")).alias("img"))


def store_links(rows: DataFrame, key: str = "sku") -> DataFrame:
    """Each key's stores as a page lists them: the last row of each store, live ones first, then by Unicode collation; place counts from 1."""
    last = latest(rows, [key, "store_label"])
    w = Window.partitionBy(key).orderBy("removed", F.expr("store_label collate UNICODE"))
    return last.select(key, F.row_number().over(w).alias("place"), "store_label", "removed", "url")


def display_url(catalog: DataFrame, urls: DataFrame, key: str = "sku") -> DataFrame:
    """The URL that fits each key's displayed store, else its sample URL."""
    mine = urls.select(key, F.col("store_label").alias("cheapest_store"), F.trim("url").alias("own"))
    return catalog.join(mine, [key, "cheapest_store"], "left").select(key, F.coalesce(F.nullif("own", F.lit("")), F.trim("sample_url"), F.lit("")).alias("url"))
