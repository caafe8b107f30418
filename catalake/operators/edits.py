"""Edits of link and ignore rules as one append-only log.

A log row has log (whose edits), seq (its place, unique in the log), action and, for adds,
kind, a and b. ``add`` makes a pending edit, ``submit`` hands all pending ones of the log
over, ``clear`` drops the pending and ``clear_submitted`` the submitted ones. Nothing is
rewritten: the state at any place follows from the rows up to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sku import pair_key

#: Places of a log that are counted in one task.
PART = 50_000


def _with_epoch(log: DataFrame) -> DataFrame:
    """log with epoch: how many submits and clears of its log come before the row. Counts of parts of a log are summed first, so a long log is no single task."""
    control = F.col("action").isin("submit", "clear").cast("long")
    rows = log.withColumn("part_", F.floor(F.col("seq") / PART)).withColumn("control_", control)
    sums = rows.groupBy("log", "part_").agg(F.sum("control_").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("log").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.select("log", "part_", F.coalesce(before, F.lit(0)).alias("begin_"))
    within = F.sum("control_").over(Window.partitionBy("log", "part_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("within_", F.coalesce(within, F.lit(0))).join(begins, ["log", "part_"]).withColumn("epoch", F.col("begin_") + F.col("within_")).drop("part_", "control_", "n_", "begin_", "within_")


def state(log: DataFrame, at: int | None = None) -> DataFrame:
    """log, status (pending or submitted), kind, a, b and seq of the edits that stand after place ``at`` (the end by default).

    Links are keyed by their ends in order, ignores by the pair; edits without both ends, or
    with equal ones, are none. Of equal edits of a status the first stands, and an edit that
    is submitted isn't pending as well. Rows without a log, place or known action don't count.
    """
    rows = log.select("log", F.col("seq").cast("long").alias("seq"), "action", "kind", "a", "b").where("log is not null and seq is not null")
    if at is not None:
        rows = rows.where(F.col("seq") <= at)
    rows = _with_epoch(rows.where(F.col("action").isin("add", "submit", "clear", "clear_submitted")))
    key = F.when(F.col("kind") == "link", pair_key(F.col("a"), F.col("b"), True)).when(F.col("kind") == "ignore", pair_key(F.col("a"), F.col("b"), False))
    adds = rows.where("action = 'add'").withColumn("key", key).where("key <> ''")
    controls = rows.where(F.col("action").isin("submit", "clear")).select("log", "epoch", F.col("action").alias("then"), F.col("seq").alias("then_seq"))
    wiped = rows.where("action = 'clear_submitted'").groupBy("log").agg(F.max("seq").alias("wiped"))
    met = adds.join(controls, ["log", "epoch"], "left").join(wiped, "log", "left")
    status = F.when(F.col("then").isNull(), "pending").when((F.col("then") == "submit") & (F.col("wiped").isNull() | (F.col("then_seq") > F.col("wiped"))), "submitted")
    # A submitted edit outdoes a pending one of its key; of one status the first place counts.
    best = met.withColumn("status", status).where("status is not null").groupBy("log", "kind", "key").agg(F.min(F.struct((F.col("status") == "pending").alias("p"), "seq", "status", "a", "b")).alias("r"))
    return best.select("log", "r.status", "kind", "r.a", "r.b", "r.seq")


def counts(standing: DataFrame) -> DataFrame:
    """log, n_links, n_ignores and n_total of the pending edits."""
    pending = standing.where("status = 'pending'")
    return pending.groupBy("log").agg(F.count_if(F.col("kind") == "link").alias("n_links"), F.count_if(F.col("kind") == "ignore").alias("n_ignores"), F.count("*").alias("n_total"))
