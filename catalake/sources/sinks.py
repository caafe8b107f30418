"""Writers: snapshots, the flat index, rules, the manifest and the alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .snapshots import shape

#: The columns of the flat index.
INDEX = ["snapshot", "name", "price", "sku", "url", "img", "removed", "store", "store_label", "category", "category_label", "source", "updated_at"]


def by_name(rows: DataFrame) -> DataFrame:
    """Rows in the order of a reader: names by Unicode collation, then URLs."""
    return rows.orderBy(F.expr("name collate UNICODE"), "url")


def reading_order(rows: DataFrame) -> DataFrame:
    """The index's total order: code, store, removed, name and URL as one collated text."""
    return rows.orderBy(F.expr("concat_ws('|', sku, store_label, cast(removed as string), name, url) collate UNICODE"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """The rows of some files replace those files' partitions only; a failed job leaves the old ones."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        shape(rows, "db_file").write.mode("overwrite").partitionBy("db_file").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_if_changed(merged: DataFrame, path: str) -> bool:
    """Writes a merged snapshot unless nothing in it changed; whether it wrote."""
    if merged.where("change is not null").isEmpty():
        return False
    merged.drop("change", "old_price").write.mode("overwrite").parquet(path)
    return True


def index_rows(rows: DataFrame) -> DataFrame:
    """The flat index: trimmed text columns, a flag, and the header of each row's file."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    have = [c for c in INDEX if c in rows.columns]
    return rows.select(*[F.coalesce("removed", F.lit(False)).alias(c) if c == "removed" else text(c) for c in have])


def write_index(rows: DataFrame, path: str) -> None:
    """The index as JSON lines, and beside it one row with the counts."""
    rows = index_rows(rows)
    rows.write.mode("overwrite").json(f"{path}/items")
    rows.agg(F.count("*").alias("count"), F.count_if(~F.col("removed")).alias("countLive"), F.lit(True).alias("includesRemoved"), F.current_timestamp().alias("generatedAt")).write.mode("overwrite").json(f"{path}/header")


def write_manifest(commits: DataFrame, path: str) -> None:
    """Each file's commits, oldest first, as one row."""
    commits.groupBy("db_file").agg(F.array_sort(F.collect_list(F.struct("seq", "snapshot_id", "date"))).alias("commits")).write.mode("overwrite").json(path)


def append_rules(rules: DataFrame, path: str) -> None:
    """Rules are appended as they come; readers take each once."""
    rules.write.mode("append").parquet(path)


def read_rules(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rules of the first path that exists, each once; none if no path does."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return spark.read.schema(schema).parquet(path).distinct()
    return spark.createDataFrame([], schema)


def alert_html(new: DataFrame, sales: DataFrame) -> tuple[str, str, bool]:
    """The alert's HTML, its subject and whether there is anything to send: every row, read one by one, for the alerts of one run."""
    def lines(part: DataFrame) -> list[str]:
        cell = lambda c: escape_html(F.col(c).cast("string")).alias(c)
        return [f"<li><a href=\"{r['url']}\">{r['name']}</a> {r['store_label']} {r['price']}</li>" for r in part.select(*map(cell, ("url", "name", "store_label", "price"))).orderBy("name", "url").toLocalIterator()]

    a, b = lines(new), lines(sales)
    body = "".join(f"<h2>{title} ({len(x)})</h2><ul>{''.join(x)}</ul>" for title, x in (("New", a), ("Sales", b)) if x)
    return f"<html><body>{body}</body></html>", f"{len(a)} new, {len(b)} sales", bool(a or b)


def write_alert(new: DataFrame, sales: DataFrame, path: str) -> None:
    """An alert of any length below ``path``: ``body``, its lines as text files in order, and ``head``, one row with subject, n_new, n_sales and send."""
    cell = lambda c: F.coalesce(escape_html(F.col(c).cast("string")), F.lit(""))
    item = F.concat(F.lit('<li><a href="'), cell("url"), F.lit('">'), cell("name"), F.lit("</a> "), cell("store_label"), F.lit(" "), cell("price"), F.lit("</li>"))

    def part(rows: DataFrame, place: int) -> DataFrame:
        return rows.select(F.lit(place).alias("part"), F.lit(1).alias("half"), "name", "url", item.alias("line"))

    both = part(new, 0).unionByName(part(sales, 1))
    counts = both.agg(*[F.count_if(F.col("part") == i).alias(n) for i, n in enumerate(("n_new", "n_sales"))])
    head = F.format_string("<h2>%s (%d)</h2>", F.element_at(F.array(F.lit("New"), F.lit("Sales")), F.col("part") + 1), F.col("n"))
    heads = both.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(0).alias("half"), F.lit("").alias("name"), F.lit("").alias("url"), head.alias("line"))
    heads.unionByName(both).orderBy("part", "half", "name", "url").select("line").write.mode("overwrite").text(f"{path}/body")
    subject = F.format_string("%d new, %d sales", "n_new", "n_sales")
    counts.select(subject.alias("subject"), "n_new", "n_sales", (F.col("n_new") + F.col("n_sales") > 0).alias("send")).write.mode("overwrite").json(f"{path}/head")
