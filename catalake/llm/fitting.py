"""Bounded numerical work in one executor task: fits on an ordered sample, and dense algebra; only the result reaches the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """doc_id, label and fold of the ``rows`` labelled rows whose id hashes lowest: a bounded table."""
    named = labels.select(labels["doc_id"], labels[label].cast("int").alias("label")).where("label is not null and doc_id is not null")
    if where is not None:
        named = named.where(where)
    return named.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).orderBy("fold", "doc_id", "label").limit(rows)


def labelled_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, label, fold and place, which orders the rows alike however docs is partitioned."""
    place = F.struct("fold", "doc_id", "label", F.xxhash64("text"))
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "label", "fold", place.alias("place"))


class Rows:
    """Feature rows as flat arrays: ``columns`` of row i are those from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, batches: Iterator[pa.RecordBatch], flat: list[str], single: list[str], most: int):
        """The lists ``flat`` (of 32-bit values) and the plain columns ``single`` of the first rows, as many as have ``most`` list entries together."""
        parts: dict[str, list[np.ndarray]] = {c: [] for c in [*flat, *single]}
        sizes, held = [], 0
        for batch in batches:
            size = np.asarray(batch.column(flat[0]).value_lengths(), np.int64)
            n = int(np.searchsorted(held + np.cumsum(size), most, "right"))
            if held < 0 or not n:
                held = -1 if n < len(size) else held
                continue
            for c in flat:
                parts[c].append(batch.column(c).slice(0, n).flatten().to_numpy(zero_copy_only=False).copy())
            for c in single:
                parts[c].append(batch.column(c).slice(0, n).to_numpy(zero_copy_only=False).copy())
            sizes.append(size[:n])
            held = held + int(size[:n].sum()) if n == len(size) else -1
        self.columns = {c: np.concatenate(p) if p else np.zeros(0) for c, p in parts.items()}
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.at = np.concatenate(([0], np.cumsum(size)))

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and which of the rows each belongs to."""
        size = self.at[rows + 1] - self.at[rows]
        before = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.at[rows] - before, size), np.repeat(np.arange(len(rows)), size)


def fitted(features: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """What fit makes of the feature rows in the order of their place: one task, whose result is an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(fit(batches), float).tobytes()], pa.binary())], names=["model"])

    one = features.repartition(1).sortWithinPartitions("place").drop("place")
    row = one.mapInArrow(run, "model binary").first()  # no task runs without rows
    return np.frombuffer(row["model"]) if row else np.zeros(0)


def in_task(spark: SparkSession, f: Callable, *args):
    """f(*args) in one executor task, where numerical libraries have one thread each; arguments and result are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*args))], pa.binary())], names=["out"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "out binary").first()["out"])
