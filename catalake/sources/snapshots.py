"""Snapshots: files, a versioned table, and the adapter of the test tables.

A snapshot table has one row a listing, version and file: snapshot_id, db_file, ord
(the place in the file), name, price, sku, url, img, removed and the file's header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import price, sku

LISTING = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "price", "sku", "url", "img", "image", "thumb")] + [T.StructField("removed", T.StringType())])
FILE = T.StructType([T.StructField("version", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("store", "storeLabel", "category", "categoryLabel", "source", "updatedAt")] + [T.StructField("count", T.LongType()), T.StructField("items", T.ArrayType(LISTING))])


def read_files(spark: SparkSession, path: str, with_path: bool = True) -> DataFrame:
    """Listings of the JSON snapshot files under a path: a fixed schema, aliases of img honoured, corrupt files empty.

    Only items with an http URL stay; of equal URLs in a file the last one does.
    """
    files = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if with_path:
        files = files.withColumn("db_file", F.col("_metadata.file_path"))
    header = ["store", F.col("storeLabel").alias("store_label"), "category", F.col("categoryLabel").alias("category_label"), "source", F.col("updatedAt").alias("updated_at")]
    rows = files.select(F.col("db_file") if with_path else F.lit(None).cast("string").alias("db_file"), *header, F.posexplode("items").alias("ord", "i"))
    text = lambda *names: F.coalesce(*[F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names], F.lit(""))
    flat = rows.select(
        "db_file", "store", "store_label", "category", "category_label", "source", "updated_at", "ord",
        text("name").alias("name"), text("price").alias("price"), text("sku").alias("sku"), text("url").alias("url"), text("img", "image", "thumb").alias("img"),
        F.coalesce(~F.lower("i.removed").isin("false", "0", "", "null"), F.lit(False)).alias("removed"),
    )
    return last_wins(flat.where(F.col("url").startswith("http")), ["db_file", "url"], "ord")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order of each key, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*").select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("row")).select(*keys, "row.*").select(*rows.columns)


def at_version(table: DataFrame, snapshot_id) -> DataFrame:
    """Time travel: one version's rows, by partition pruning on a table partitioned by snapshot_id."""
    return table.where(F.col("snapshot_id") == F.lit(snapshot_id))


def files_at(table: DataFrame, snapshot_id) -> DataFrame:
    return at_version(table, snapshot_id).select("db_file").distinct()


def changed_files(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Files whose content differs between two versions, or that only one has: an order-free fingerprint per file, one shuffle."""
    def side(rows: DataFrame, n: int) -> DataFrame:
        mark = F.xxhash64(*columns).cast("decimal(38,0)")
        return rows.select("db_file", F.lit(n).alias("side"), mark.alias("mark"))

    both = side(old, 0).union(side(new, 1)).groupBy("db_file").agg(*[f.alias(a) for n in (0, 1) for f, a in ((F.sum(F.when(F.col("side") == n, F.col("mark"))), f"sum{n}"), (F.count_if(F.col("side") == n), f"n{n}"))])
    status = F.when(F.col("n0") == 0, "added").when(F.col("n1") == 0, "deleted").otherwise("changed")
    return both.where(~(F.col("sum0").eqNullSafe(F.col("sum1")) & (F.col("n0") == F.col("n1")))).select("db_file", status.alias("status"))


def version_pairs(snapshots: DataFrame) -> DataFrame:
    """Each version with the one before it in its sequence; the first has none."""
    w = Window.partitionBy(*[c for c in ("db_file",) if c in snapshots.columns]).orderBy("seq")
    return snapshots.withColumn("prev_id", F.lag("snapshot_id").over(w))


def log_since(snapshots: DataFrame, since) -> DataFrame:
    return snapshots.where(F.col("ts") >= F.lit(since)).orderBy("ts", "seq")


def newest_per_day(commits: DataFrame, days: int = 600, raw: int = 2400) -> DataFrame:
    """The manifest: of the newest ``raw`` commits of a file, the newest of each day, for the newest ``days`` days. A report's limits."""
    recent = commits.withColumn("r", F.row_number().over(Window.partitionBy("db_file").orderBy(F.desc("seq")))).where(F.col("r") <= raw)
    daily = recent.withColumn("d", F.row_number().over(Window.partitionBy("db_file", "date").orderBy(F.desc("seq")))).where("d = 1")
    return daily.withColumn("k", F.row_number().over(Window.partitionBy("db_file").orderBy(F.desc("date")))).where(F.col("k") <= days).drop("r", "d", "k")


def shape(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows as they are saved: six columns and those to keep, the sku as a stored key, no data images."""
    return rows.select(
        *keep,
        "name", "price", sku.stored_key(F.col("sku"), F.col("store_label"), F.col("url")).alias("sku"), "url",
        F.when(F.col("img").rlike("(?i)^data:"), "").otherwise(F.coalesce("img", F.lit(""))).alias("img"), F.coalesce("removed", F.lit(False)).alias("removed"),
    )


def part_key(number: Column) -> Column:
    """A part's number as a key of six digits, or of more where it has more."""
    text = number.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables as listings: a line item is a listing of a part at a supplier's store."""
    line, part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    text = F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("s_name").alias("store_label"), F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("sku"), F.col("p_name").alias("name"), text.alias("price"),
        price.to_number(text).alias("price_num"), F.concat_ws("/", F.lit("http:/"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("url"),
        (F.col("l_returnflag") == "R").alias("removed"), F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), "p_size",
    )
