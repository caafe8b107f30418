"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Spark's setting by which a run removes its shuffles at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, with its lineage cut.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where it is
    unset, a temporary folder is taken if driver and executors are one local process;
    on a cluster, which can't share such a folder, that is an error. The shuffles that
    the frame was worked out with are removed once it is written, not only when the driver
    next collects garbage; those of other runs of the frame stay.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return frame.select("*").checkpoint()  # a run of its own takes the setting as it is now
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, which driver and executors share; set as ``checkpointed`` says."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows and bytes up to which a checked table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return reduce(add, [_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(16))
        return 8 * F.greatest(F.size(value), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, stored and measured; with a broadcast hint only if it has at most ``rows`` rows and about ``most`` bytes. Beyond that a shuffle join takes it."""
    stored, small = measured(frame, rows, most)
    return F.broadcast(stored) if small else stored


#: Words of 64 bits in a filter of keys. It is of a fixed size; more keys only let more rows through.
FILTER_WORDS = 1 << 19


def among(frame: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of frame that a filter of keys (one column) lets through: all whose key is among them, and some others by chance. With left_anti, those that it holds back, none of which is among them.

    So a join sends no more than these rows through its shuffle, whatever the number of keys.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER_WORDS))
    word, bit = lambda c: F.shiftright(place(c), 6), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    set_ = keys.select(F.col(f"`{keys.columns[0]}`").alias("key")).select(word(F.col("key")).alias("word"), bit(F.col("key")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    mine = frame[f"`{key}`"]
    return frame.join(F.broadcast(set_), (word(mine) == set_["word"]) & (set_["bits"].bitwiseAND(bit(mine)) != 0), how)


def measured(frame: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The frame, stored, and whether it has at most ``rows`` rows and about ``most`` bytes."""
    frame = checkpointed(frame)
    size = reduce(add, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields])
    found = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return frame, found["n"] <= rows and found["b"] <= most
