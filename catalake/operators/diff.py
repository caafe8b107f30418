"""Snapshot differences: both versions are tagged, united and aggregated by key.

That is one shuffle with partial aggregation, where a full outer join would need the
two sides deduplicated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price as P


def _tagged(prev: DataFrame, now: DataFrame, keys: list[str], columns: list[str | Column], order: list[str]) -> DataFrame:
    def side(rows: DataFrame, tag: int) -> DataFrame:
        return rows.select(*keys, F.lit(tag).alias("tag"), F.col("removed"), F.struct(F.struct(*order).alias("o"), "removed", F.struct(*columns).alias("r")).alias("x"))

    def last(tag: int, live: bool) -> Column:
        here = (F.col("tag") == tag) & (~F.col("removed") if live else F.lit(True))
        return F.max(F.when(here, F.col("x")))

    # A row is carried once for each place that it can take, with its order in it.
    both = side(prev, 0).unionByName(side(now, 1))
    d = both.groupBy(*keys).agg(last(0, True).alias("ol"), last(0, False).alias("oa"), last(1, True).alias("nl"), last(1, False).alias("na"))
    return d.select(*keys, F.col("ol.r").alias("old_live"), F.col("oa.r").alias("old_any"), F.col("nl.r").alias("new_live"), F.col("na.r").alias("new_any"), F.col("oa.removed").alias("old_removed"), F.col("na.removed").alias("new_removed"))


def by_url(prev: DataFrame, now: DataFrame, keys: list[str] = ("url",), order: list[str] = ("ts",), also: list[str] = ()) -> DataFrame:
    """new, restored, removed and updated rows by URL; of rows with one URL the last counts, and prices are compared without white space.

    ``also`` names further columns of a listing, given as its newer row has them, else its older one.
    """
    keys = list(keys)
    d = _tagged(prev, now, keys, ["name", "price", *also], list(order))
    newest = lambda c: F.coalesce(f"new_any.{c}", f"old_any.{c}").alias(c)
    old_live, new_live = F.coalesce(~F.col("old_removed"), F.lit(False)), F.coalesce(~F.col("new_removed"), F.lit(False))
    changed = P.normalize(F.col("old_any.price")) != P.normalize(F.col("new_any.price"))
    kind = (
        F.when(F.col("old_any").isNull() & new_live, "new").when(F.col("old_removed") & new_live, "restored").when(old_live & ~new_live, "removed").when(old_live & new_live & changed, "updated")
    )
    return d.withColumn("change", kind).where("change is not null").select(*keys, "change", newest("name"), F.col("old_any.price").alias("old_price"), F.col("new_any.price").alias("new_price"), *map(newest, also))


def _by_key(prev: DataFrame, now: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``by_key`` with both prices as numbers, which are worked out once a row, before rows meet."""
    d = _tagged(prev, now, list(keys), ["price", "url", P.to_number(F.col("price")).alias("number")], list(order))
    old, new = F.col("old_live.number"), F.col("new_live.number")
    differ = F.trim("old_live.price") != F.trim("new_live.price")
    kind = (
        F.when(F.col("old_any").isNull() & F.col("new_live").isNotNull(), "new").when(F.col("old_live").isNull() & F.col("new_live").isNotNull(), "restored")
        .when(F.col("old_live").isNotNull() & F.col("new_live").isNull(), "removed")
        .when(differ & (new < old), "price_down").when(differ & (new > old), "price_up").when(differ, "price_change")
    )
    return d.withColumn("change", kind).where("change is not null").select(*keys, "change", F.col("old_live.price").alias("old_price"), F.col("new_live.price").alias("new_price"), F.coalesce("new_live.url", "old_live.url").alias("url"), old.alias("old_number_"), new.alias("new_number_"))


def by_key(prev: DataFrame, now: DataFrame, keys: list[str], order: list[str] = ("ts", "url")) -> DataFrame:
    """new, restored, removed, price_down, price_up and price_change by identity key; only live rows carry prices."""
    return _by_key(prev, now, keys, order).drop("old_number_", "new_number_")


def drops(prev: DataFrame, now: DataFrame, keys: list[str], order: list[str] = ("ts", "url")) -> DataFrame:
    """The alert's changes: new keys, and strictly lower prices with the percentage off."""
    d = _by_key(prev, now, keys, order).where("change in ('new', 'restored', 'price_down')")
    pct = P.percent_off(F.col("old_number_"), F.col("new_number_"), "zero")
    return d.withColumn("change", F.when(F.col("change") == "price_down", "drop").otherwise("new")).withColumn("pct", F.when(F.col("change") == "drop", pct)).drop("old_number_", "new_number_")
