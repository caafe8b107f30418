"""Scans as a stream: each micro-batch is merged into a stored snapshot, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge


def merge_stream(spark: SparkSession, scans: DataFrame, snapshot_dir: str, checkpoint: str):
    """Merges each batch of scans into the newest version under snapshot_dir and writes the next version.

    A version's folder is named by its batch, and a batch that runs again writes the
    same version from the same one before, so a restart repeats nothing.
    """
    schema = "name string, price string, sku string, url string, img string, removed boolean"

    def one(batch: DataFrame, batch_id: int) -> None:
        try:
            prev = spark.read.schema(schema).parquet(f"{snapshot_dir}/version={batch_id - 1}") if batch_id > 0 else spark.createDataFrame([], schema)
        except Exception as error:  # an empty first version has no folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
            prev = spark.createDataFrame([], schema)
        merge(prev, batch).select("name", "price", "sku", "url", "img", "removed").write.mode("overwrite").parquet(f"{snapshot_dir}/version={batch_id}")

    return scans.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events by window and kind, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_per_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
