"""Merging a scan into the previous snapshot: upsert, soft delete, restore and move.

Rows meet by URL in one tagged aggregation. A scanned URL that the snapshot doesn't
know may be a known item at a new address: it is one if a live row with the same
six-digit code exists whose own address the scan doesn't have. Both addresses stay
where the scan has both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions.sku import six_digits

COLUMNS = ["name", "price", "sku", "url", "img"]


def _image(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike("(?i)^data:"), "").otherwise(c)


def _by_url(prev: DataFrame, scan: DataFrame, by: list[str]) -> DataFrame:
    """The columns ``by``, url, p (the snapshot's row) and n (the scan's; of one URL the last, by ord where there is one)."""
    def tagged(rows: DataFrame, tag: int) -> DataFrame:
        order = F.col("ord").cast("long") if "ord" in rows.columns else F.lit(0).cast("long")
        removed = F.coalesce(F.col("removed"), F.lit(False)) if tag == 0 else F.lit(False)
        row = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS], removed.alias("removed"))
        return rows.select(*by, "url", F.lit(tag).alias("tag"), F.struct(order.alias("o"), row.alias("r")).alias("x"))

    both = tagged(prev, 0).unionByName(tagged(scan, 1))
    pick = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("x")))["r"]
    return both.groupBy(*by, "url").agg(pick(0).alias("p"), pick(1).alias("n"))


def merge(prev: DataFrame, scan: DataFrame, complete: bool | DataFrame = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The merged snapshot with each row's outcome: name, price, sku, url, img, removed, change, old_price.

    change is new, restored, updated (the price differs), removed, moved, or null.
    An incomplete scan removes nothing. Null columns count as empty text. With ``by``, both
    sides have those columns and each of their values is a snapshot of its own; complete may
    then be a table of them and complete, and a value that it lacks removes nothing.
    """
    by = list(by)
    met = _by_url(prev, scan, by)
    unknown = met.where("p is null").select(*by, "n.*", six_digits(F.col("n.sku")).alias("code"))
    gone = met.where("n is null and not p.removed").select(*by, "p.*", six_digits(F.col("p.sku")).alias("code")).where("code <> ''")
    # The first address of a code moves to the first new address that has it, so each row moves once.
    first = lambda rows: rows.where("code <> ''").groupBy(*by, "code").agg(F.min("url").alias("url"))
    moves = first(unknown).toDF(*by, "code", "to_url").join(first(gone).toDF(*by, "code", "from_url"), [*by, "code"])
    to = moves.select(*by, F.col("to_url").alias("url"), "from_url")
    away = moves.select(*by, F.col("from_url").alias("url"), F.lit(True).alias("away"))
    old = gone.select(*by, F.col("url").alias("from_url"), F.struct(*COLUMNS, "removed").alias("q"))

    known = met.join(to, [*by, "url"], "left").join(away, [*by, "url"], "left").where("away is null")
    known = known.join(old, [*by, "from_url"], "left").withColumn("p", F.coalesce("p", "q"))
    if not isinstance(complete, DataFrame):
        whole = F.lit(complete)
    else:
        known = known.join(complete.select(*by, F.col("complete").alias("whole")), by, "left")
        whole = F.coalesce(F.col("whole"), F.lit(False))
    code_now, code_old = six_digits(F.col("n.sku")), six_digits(F.col("p.sku"))
    sku = F.coalesce(F.nullif(code_now, F.lit("")), F.when(F.col("p").isNotNull(), F.nullif(F.when(code_old != "", code_old).otherwise(F.col("p.sku")), F.lit(""))), F.lit(""))
    img = F.coalesce(F.nullif(_image(F.col("n.img")), F.lit("")), F.col("p.img"), F.lit(""))
    differs = (F.col("n.name") != F.col("p.name")) | (F.col("n.price") != F.col("p.price")) | (sku != F.col("p.sku")) | (img != F.col("p.img")) | (F.col("url") != F.col("p.url"))
    dearer = P.normalize(F.col("n.price")) != P.normalize(F.col("p.price"))
    seen = F.col("n").isNotNull()
    fresh = F.struct(F.col("n.name").alias("name"), F.col("n.price").alias("price"), sku.alias("sku"), F.col("url").alias("url"), img.alias("img"), F.lit(False).alias("removed"))
    missing = F.col("p").withField("removed", F.col("p.removed") | whole)
    row = F.when(~seen, missing).when(F.col("p").isNull() | F.col("p.removed") | differs, fresh).otherwise(F.col("p"))
    change = (
        F.when(~seen & ~F.col("p.removed") & whole, "removed").when(~seen, F.lit(None)).when(F.col("p").isNull(), "new")
        .when(F.col("p.removed"), "restored").when(dearer, "updated").when(F.col("url") != F.col("p.url"), "moved")
    )
    return known.select(*by, row.alias("row"), change.alias("change"), F.when(change == "updated", F.col("p.price")).alias("old_price")).select(*by, "row.*", "change", "old_price")


def mass_removal(prev: DataFrame, scan: DataFrame, least: float = 0.6) -> DataFrame:
    """Whether a scan looks partial: it has under ``least`` of the live rows of the snapshot, by file."""
    live = prev.where(~F.col("removed")).groupBy("db_file").agg(F.countDistinct("url").alias("n_prev"))
    now = scan.groupBy("db_file").agg(F.countDistinct("url").alias("n_scan"))
    joined = live.join(now, "db_file", "left").fillna(0, ["n_scan"])
    return joined.withColumn("partial", F.col("n_scan") < least * F.col("n_prev"))


def change_counts(merged: DataFrame) -> DataFrame:
    kinds = ("new", "updated", "removed", "restored")
    return merged.agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds]).withColumn("significant", sum((F.col(f"n_{k}") for k in kinds), F.lit(0)) > 0)
