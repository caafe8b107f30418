"""Change feeds, ranked feeds and alerts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions.time import in_window
from . import index


def history_events(history: DataFrame, keys: list[str]) -> DataFrame:
    """Events between consecutive rows of each key in a versioned history: one window pass instead of a join a version pair."""
    w = Window.partitionBy(*keys).orderBy("ts", "url")
    old_removed, old = F.lag("removed").over(w), F.lag("price_num").over(w)
    rows = history.withColumn("old_removed", old_removed).withColumn("old_num", old).withColumn("old_price", F.lag("price").over(w))
    kind = (
        F.when(F.col("old_removed").isNull() & ~F.col("removed"), "new").when(F.col("old_removed") & ~F.col("removed"), "restored").when(~F.col("old_removed") & F.col("removed"), "removed")
        .when(F.col("old_removed") | F.col("removed"), None).when(F.col("price_num") < F.col("old_num"), "price_down").when(F.col("price_num") > F.col("old_num"), "price_up")
        .when(F.col("price") != F.col("old_price"), "price_change")
    )
    return rows.withColumn("kind", kind).where("kind is not null").select(*keys, "ts", "url", "kind", F.when(F.col("kind").startswith("price"), F.col("old_price")).alias("old_price"), "price")


def newest(events: DataFrame, n: int = 500, order: list[str] = ("ts",)) -> DataFrame:
    """The newest n events by parsed time: a top-k report."""
    return events.orderBy(F.desc("ts"), *[c for c in order if c != "ts"]).limit(n)


def recent(events: DataFrame, now, hours: int = 24) -> DataFrame:
    return events.where(in_window(F.col("ts"), F.lit(now).cast("timestamp"), hours))


def latest_per(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best event of each key: row_number = 1, which plans as a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def ranked(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events with score and tie-break, by the catalogue's cheapest price and store count."""
    joined = events.join(catalog, "sku", "left")
    old, new = P.to_number(F.col("old_price")), P.to_number(F.col("price"))
    down, up = F.col("kind") == "price_down", F.col("kind") == "price_up"
    pct = F.when(down, F.coalesce(P.percent_off(old, new, "zero"), F.lit(0))).when(up, F.coalesce(P.percent_change(old, new), F.lit(0)))
    cheapest = F.coalesce((F.col("best_price") >= new) | P.near(F.col("best_price"), new), F.lit(True))
    score = P.event_score(F.col("kind"), pct, cheapest, F.col("store_count"))
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return joined.withColumn("pct", pct).withColumn("score", score).withColumn("tie", F.when(down | up, F.coalesce(pct, F.lit(0)) * F.lit(100000).cast("long") + millis).otherwise(millis))


def unique_new(changes: DataFrame, available: DataFrame) -> DataFrame:
    """New items that no other store has: the availability set is just this store."""
    joined = changes.where("change = 'new'").join(available, "sku")
    return joined.where((F.size("stores") == 1) & F.array_contains("stores", F.col("store_label")))


def big_sales(changes: DataFrame, available: DataFrame, least: int = 20) -> DataFrame:
    """Drops of at least a percentage to the least price of all stores, with the store among the cheapest."""
    joined = changes.where((F.col("change") == "drop") & (F.col("pct") >= least)).join(available, "sku")
    return joined.where(P.near(P.to_number(F.col("new_price")), F.col("min_price"), 0.005) & F.array_contains("cheapest_stores", F.col("store_label")))


def with_current(changes: DataFrame, rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Changes with ``fields`` of the live row that their key has now, and ``is_current``.

    A key's row now is its last one by time (``index.latest``); where that is removed, or
    there is none, the change's own fields stay, null where it has none. A current row
    counts as a whole: its nulls aren't filled from the change. Keys are compared null
    safe. Changes are kept as they are, repeated ones too.
    """
    now = index.live(index.latest(rows, keys)).select(*[F.col(k).alias(f"key_{i}_") for i, k in enumerate(keys)], F.struct(*fields).alias("current_"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"key_{i}_")) for i, k in enumerate(keys)])
    joined = changes.join(now, same, "left")
    is_current = F.col("current_").isNotNull()
    types = {f.name: f.dataType for f in rows.schema}
    own = {f: F.col(f) if f in changes.columns else F.lit(None).cast(types[f]) for f in fields}
    return joined.select(*[c for c in changes.columns if c not in fields], *[F.when(is_current, F.col("current_")[f]).otherwise(own[f]).alias(f) for f in fields], is_current.alias("is_current"))


def by_percent(changes: DataFrame) -> DataFrame:
    """Drops by falling percentage, then price, item and store, each with its place.

    Places are counted in ranges of the percentage, which has at most a hundred values, so
    that no task ranks all drops."""
    drops = changes.where((F.col("change") == "drop") & (F.col("pct") > 0)).withColumn("w", P.to_number(F.col("new_price")))
    before = drops.groupBy("pct").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("pct")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("pct", "before")
    ranked = drops.withColumn("place", F.row_number().over(Window.partitionBy("pct").orderBy("w", "sku", "store_label")))
    return ranked.join(F.broadcast(before), "pct").select((F.col("place") + F.col("before")).cast("int").alias("place"), "sku", "store_label", "pct")


def cheaper_elsewhere(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Rows with the store that is strictly cheaper, if another one is."""
    b = best.select("sku", F.col("store_label").alias("best_store"), F.col("price_num").alias("best_price"))
    other = (F.col("best_store") != F.col("store_label")) & (F.col("best_price") < F.col("price_num"))
    return rows.join(b, "sku", "left").withColumn("cheaper_at", F.when(other, F.col("best_store")))


def available_elsewhere(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Removed rows with the cheapest other store that still has the item."""
    b = best.select("sku", F.col("store_label").alias("best_store"))
    return rows.join(b, "sku", "left").withColumn("available_at", F.when(F.col("best_store") != F.col("store_label"), F.col("best_store")))
