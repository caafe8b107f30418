"""Run reports: totals by store and category, and text for small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import sku as S
from ..functions import text as X
from ..session import checkpointed

KINDS = ("new", "updated", "removed", "restored")


def totals(changes: DataFrame, by: list[str]) -> DataFrame:
    return changes.groupBy(*by).agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in KINDS], F.count("*").alias("n"))


def rolled_up(changes: DataFrame, by: list[str]) -> DataFrame:
    """Totals with subtotals; names the level that a row sums."""
    return changes.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def section(changes: DataFrame, kind: str) -> DataFrame:
    """A section's rows in the order of a reader: label and name by Unicode collation."""
    return changes.where(F.col("change") == kind).orderBy(F.expr("concat(store_label, name) collate UNICODE"), "url")


def lines(changes: DataFrame) -> DataFrame:
    """The report's lines in order, for a file of any length: section, place (0 is the head, with the section's count) and line."""
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    known = changes.where(F.col("change").isin(*KINDS))
    shown = known.select(rank[F.col("change")].alias("section"), F.expr("concat(store_label, name) collate UNICODE").alias("order_"), "url", F.concat(F.lit("  "), F.concat_ws(" | ", "store_label", "name", "price")).alias("line"))
    # Ranges of the report's order: a place is its range's first one and the place in the range, so no section is one task.
    ranged = checkpointed(shown.repartitionByRange("section", "order_", "url").withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy("section", "range_").count()
    begin = F.sum("count").over(Window.partitionBy("section").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("section", "range_", F.coalesce(begin, F.lit(0)).alias("begin_"))
    within = F.row_number().over(Window.partitionBy("section", "range_").orderBy("order_", "url"))
    body = ranged.withColumn("within_", within).join(begins, ["section", "range_"]).select("section", (F.col("begin_") + F.col("within_")).alias("place"), "line")
    counts = known.groupBy("change").agg(F.count("*").alias("n"))
    kinds = changes.sparkSession.createDataFrame([(k,) for k in KINDS], "change string").join(counts, "change", "left")
    head = kinds.select(rank[F.col("change")].alias("section"), F.lit(0).cast("long").alias("place"), F.format_string("%s (%d)", F.upper("change"), F.coalesce("n", F.lit(0))).alias("line"))
    return head.unionByName(body).orderBy("section", "place")


def diff_lines(changes: DataFrame) -> DataFrame:
    """The report of a difference: section, label, name, url, half (0 the heading, 1 an item, 2 its address) and line.

    changes has change (new, restored, removed or updated), store_label, category, name, sku, url,
    old_price and new_price. Sort by section, label and name by Unicode collation, url and half for the
    text. Headings count all of a section; labels are filled to the longest.
    """
    marks = {"new": ("NEW", "+"), "restored": ("RESTORED", "R"), "removed": ("REMOVED", "-"), "updated": ("PRICE CHANGES", "~")}
    pick = lambda k: F.create_map(*[F.lit(x) for kind, m in marks.items() for x in (kind, m[k])])[F.col("change")]
    place = F.create_map(*[F.lit(x) for i, kind in enumerate(marks) for x in (kind, i)])[F.col("change")]
    rows = changes.where(F.col("change").isin(*marks)).withColumn("label", F.concat_ws(" | ", "store_label", "category")).withColumn("section", place)
    heads = rows.groupBy("section", "change").agg(F.count("*").alias("n"), F.max(F.char_length("label")).alias("w"))
    # At most four rows here.
    heads = heads.withColumn("width", F.greatest(F.max("w").over(Window.partitionBy()), F.lit(16)))
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(no price)"))
    code = S.six_digits(F.col("sku"))
    off = P.percent_off(P.to_number(F.col("old_price")), P.to_number(F.col("new_price")), "null_if_zero")
    tag = F.when(off.isNotNull(), F.concat(F.lit(" ["), off.cast("string"), F.lit("% Off]"))).otherwise("")
    price = F.when(F.col("change") == "updated", F.concat(shown("old_price"), F.lit(" -> "), shown("new_price"), tag)).when(F.col("change") == "removed", shown("old_price")).otherwise(shown("new_price"))
    item = F.concat(pick(1), F.lit(" "), X.padded(F.col("label"), F.col("width")), F.lit(" | "), "name", F.when(code != "", F.concat(F.lit(" "), code)).otherwise(""), F.lit("  "), price)
    both = F.explode(F.array(F.struct(F.lit(1).alias("half"), item.alias("line")), F.struct(F.lit(2).alias("half"), F.concat(F.lit("  "), "url").alias("line"))))
    body = rows.join(F.broadcast(heads.select("section", "width")), "section").select("section", "label", "name", "url", both.alias("x")).select("section", "label", "name", "url", "x.half", "x.line")
    head = heads.select("section", F.lit("").alias("label"), F.lit("").alias("name"), F.lit("").alias("url"), F.lit(0).alias("half"), F.format_string("%s (%d)", pick(0), "n").alias("line"))
    return head.unionByName(body)


def text(changes: DataFrame) -> str:
    """The whole report as one text, read row by row: for changes of one run. Write ``lines`` where they may be many."""
    return "\n".join(r["line"] for r in lines(changes).toLocalIterator())


def percent(part: int, of: int) -> str:
    return f"{100 * part / of:.1f}%" if of else "0%"


def human_duration(seconds: float) -> str:
    return f"{seconds:.1f}s" if seconds < 60 else f"{int(seconds // 60)}m {int(seconds % 60)}s"


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f}{unit}" if unit == "B" else f"{n:.1f}{unit}"
        n /= 1024
    return ""
