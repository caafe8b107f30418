"""Link and ignore rules: idempotent inserts, overlays, and edits from text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sku import pair_key

PAYLOAD = "schema string, createdAt string, links array<struct<fromSku:string,toSku:string>>, ignores array<struct<skuA:string,skuB:string>>"


def insert_absent(existing: DataFrame, incoming: DataFrame, a: str, b: str, ordered: bool) -> DataFrame:
    """existing and those incoming rules it lacks, each once; rules without both ends, or with equal ones, are no rules."""
    key = pair_key(F.col(a), F.col(b), ordered)
    new = incoming.withColumn("k_", key).where("k_ <> ''").groupBy("k_").agg(F.min(F.struct(*incoming.columns)).alias("r"))
    have = existing.select(key.alias("k_")).distinct()
    return existing.unionByName(new.join(have, "k_", "left_anti").select("r.*"))


def overlay(base: DataFrame, edits: DataFrame, a: str, b: str, ordered: bool) -> DataFrame:
    """The union of both, base first, one rule a key: one aggregation."""
    both = base.withColumn("p_", F.lit(0)).unionByName(edits.withColumn("p_", F.lit(1)))
    keyed = both.withColumn("k_", pair_key(F.col(a), F.col(b), ordered)).where("k_ <> ''")
    return keyed.groupBy("k_").agg(F.min(F.struct("p_", *base.columns)).alias("r")).select("r.*").drop("p_")


def parse_edits(bodies: DataFrame, fence: str, schema_tag: str, body: str = "body") -> DataFrame:
    """Payloads between the comments ``fence``:BEGIN and ``fence``:END in free text; others, and those of another schema, go."""
    mark = lambda end: rf"<!--\s*\Q{fence}:{end}\E\s*-->"
    inner = F.regexp_extract(F.col(body), rf"(?s){mark('BEGIN')}(.*?){mark('END')}", 1)
    raw = F.trim(F.regexp_replace(inner, r"(?m)^\s*```\w*\s*$", ""))
    return bodies.withColumn("edit", F.from_json(raw, PAYLOAD)).where(F.col("edit.schema") == schema_tag)


def edited_links(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("edit.links").alias("l")).select(F.trim("l.fromSku").alias("from_sku"), F.trim("l.toSku").alias("to_sku"))
    return rows.where(pair_key(F.col("from_sku"), F.col("to_sku"), True) != "").distinct()


def submit(pending: DataFrame, submitted: DataFrame, a: str, b: str, ordered: bool) -> tuple[DataFrame, DataFrame]:
    """Pending edits move to the submitted ones: what is pending afterwards (nothing) and what is submitted."""
    return pending.limit(0), overlay(submitted, pending, a, b, ordered)


def pending_counts(links: DataFrame, ignores: DataFrame) -> DataFrame:
    both = links.select(F.lit(0).alias("k")).unionAll(ignores.select(F.lit(1).alias("k")))
    return both.agg(F.count_if(F.col("k") == 0).alias("n_links"), F.count_if(F.col("k") == 1).alias("n_ignores"))
