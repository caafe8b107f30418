"""Embedding whitening: principal components of a table of vectors by block Lanczos, and every row projected on them.

The covariance matrix is never formed. Each step multiplies a block of directions by it
in one pass over the stored vectors (centred first, summed by dimension on executors),
and a small dense task orthogonalises the product against every earlier direction, twice,
solves the projected problem and measures residuals. A product that adds no direction
(a breakdown) is replaced by random directions orthogonal to all before, so that vectors
of low rank and repeated eigenvalues are found whole. The basis has at most ``most``
columns and is then restarted from its best Ritz vectors and the newest directions.

Only blocks of dimension x block numbers reach the driver, whatever the number of rows.
The dense algebra runs in an executor task, where numerical libraries have one thread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .fitting import in_task

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries are exact integers as long as x stays below this.
MOST_X = 1 << 52
#: Directions a pass multiplies, and columns of the basis at most.
BLOCK, COLUMNS = 12, 192
#: A Ritz pair is done when its residual is at most this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Eigenvalues up to this share of the trace are zero by rounding, and no components.
NOTHING = 1e-13


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows whose vector has entries, none of them null, NaN or infinite, and the table's most frequent length (ties: the longer).

    A table of vectors has one length; rows of another one can't be projected and go.
    """
    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), v.alias("v")).where("size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def integers(values: np.ndarray) -> np.ndarray:
    """x of finite entries; an entry whose x isn't an exact double is an error."""
    x = np.floor(values * SCALE) + SHIFT
    if len(x) and not np.abs(x).max() < MOST_X:
        raise ValueError(f"an entry is too large to whiten: |x| must stay below {MOST_X}")
    return x.astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            data = batch.column(1).cast(pa.large_binary())
            _, offsets, values = data.buffers()
            at = np.frombuffer(offsets, np.int64, len(data) + 1, data.offset * 8)
            yield batch.column(0), np.frombuffer(values, np.int64, len(data) * d, int(at[0])).reshape(len(data), d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where all fit, else Python's."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 2 * top < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared(dev: np.ndarray) -> list[int]:
    """Each row's sum of squares, exact."""
    top = max((abs(int(v)) for v in (dev.min(initial=0), dev.max(initial=0))), default=0) if dev.size else 0
    if dev.dtype != object and top * top * max(dev.shape[1], 1) < 1 << 62:
        return (dev * dev).sum(1).tolist()
    return (dev.astype(object) ** 2).sum(1).tolist()


class Vectors:
    """The stored integer vectors with their number and sums; ``product`` is one pass."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id and v, all of one length."""
        self.spark = rows.sparkSession
        self.id_type = rows.schema["vec_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(1)
                x = integers(lists.flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1] * 8
                data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["vec_id", "x"])

        self.stored = checkpointed(rows.mapInArrow(run, f"vec_id {self.id_type}, x binary"))
        row = self.stored.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("b")).first()
        self.n, self.d = row["n"], (row["b"] or 0) // 8
        self.sums = [int(s) for s in self._sums()]

    def _sums(self) -> list:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d, object)
            for _, x in _batches(batches, d):
                total += np.add.reduce(x.astype(object) if np.abs(x).max() > (1 << 40) else x, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([str(t) for t in total])], names=["i", "s"])

        if not self.n:
            return []
        rows = self.stored.mapInArrow(run, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        return [r["s"] for r in rows.orderBy("i").collect()]  # one row a dimension

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions: rows are centred, multiplied and summed a partition, and the partitions' sums meet by dimension."""
        d, n, sums, b = self.d, self.n, self.sums, block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, b))
            for _, x in _batches(batches, d):
                centred = deviations(x, n, sums).astype(float) / n
                total += centred.T @ (centred @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *(pa.array(total[:, j]) for j in range(b))], names=["i", *(f"c{j}" for j in range(b))])

        names = [f"c{j}" for j in range(b)]
        parts = self.stored.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names))
        rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()  # one row a dimension
        return np.array([[r[c] for c in names] for r in rows]) / n


def orthonormal(new: np.ndarray, basis: np.ndarray, scale: float, random: np.random.Generator) -> np.ndarray:
    """Directions of ``new`` made orthogonal to ``basis`` and to each other, as many as there is room for; columns that vanish restart at random ones."""
    out = basis
    for j in range(new.shape[1]):
        if out.shape[1] >= len(new):
            break
        v, size = new[:, j], scale
        for attempt in range(20):
            if attempt:  # a breakdown: this column is in the span already
                v, size = random.standard_normal(len(new)), 0.0
            for _ in range(2):
                v = v - out @ (out.T @ v)
            norm = float(np.linalg.norm(v))
            if norm > max(1e-11 * size, 1e-290):
                v = v / norm
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
    return out[:, basis.shape[1] :]


def start(d: int, block: int, seed: int = 7) -> dict:
    random = np.random.default_rng(seed)
    none = np.zeros((d, 0))
    return {"q": none, "aq": none, "next": orthonormal(random.standard_normal((d, min(block, d))), none, 1.0, random), "done": False, "steps": 0, "random": random}


def step(state: dict, product: np.ndarray, k: int, most: int, tolerance: float) -> dict:
    """The state after a pass: Ritz pairs of all directions so far, their residuals, and the next block."""
    q, aq = np.column_stack([state["q"], state["next"]]), np.column_stack([state["aq"], product])
    d, wide = q.shape
    projected = q.T @ aq
    values, rotate = np.linalg.eigh((projected + projected.T) / 2)
    values, rotate = values[::-1], rotate[:, ::-1]
    want = min(k, d)
    ritz, image = q @ rotate[:, :want], aq @ rotate[:, :want]
    residual = np.linalg.norm(image - ritz * values[:want], axis=0)
    largest = max(float(values[0]), 0.0)
    enough = wide >= d or (wide >= want and bool((residual <= tolerance * largest).all()))
    out = {"values": values[:want], "vectors": ritz, "residual": residual, "done": enough, "steps": state["steps"] + 1, "random": state["random"], "q": q, "aq": aq}
    if enough:
        return out
    block = state["next"].shape[1]
    if wide + block > most:  # a thick restart keeps the best Ritz vectors; the newest directions join them
        keep = max(want, most // 2 - block)
        out["q"], out["aq"] = q @ rotate[:, :keep], aq @ rotate[:, :keep]
        fresh = aq @ rotate[:, :block] - (q @ rotate[:, :block]) * values[:block]
        out["next"] = orthonormal(fresh, out["q"], largest, out["random"])
    else:
        out["next"] = orthonormal(product, q, largest, out["random"])
    return out


def components(vectors: Vectors, k: int = 8, block: int = BLOCK, most: int = COLUMNS, tolerance: float = TOLERANCE, passes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the covariance, falling, and their unit eigenvectors as columns.

    It ends when all k residuals are within the tolerance, when the basis spans every
    dimension, or when four passes lower the largest residual no more and rounding is what is left.
    """
    state = in_task(vectors.spark, start, vectors.d, max(block, k))
    best, since = np.inf, 0
    for _ in range(passes):
        state = in_task(vectors.spark, step, state, vectors.product(state["next"]), k, max(most, 3 * max(block, k)), tolerance)
        if state["done"]:
            break
        worst = float(state["residual"].max()) / max(float(state["values"][0]), 1e-300)
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if since >= 4 and best < 1e-10:
            break
    else:
        raise RuntimeError(f"residuals are still {best:.1e} of the largest eigenvalue after {passes} passes")
    return state["values"], state["vectors"]


def whiten(vectors: DataFrame, k: int = 8, id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK, most: int = COLUMNS) -> DataFrame:
    """vec_id, n, deviation, whitened (array of a value a component), explained (array) and identity_error, a row for each usable vector.

    The fit list is all usable rows. deviation is the exact sum over dimensions of
    (n * x - S)^2 as decimal(38,0), null where that is too small a type. A component is
    an eigenvector with variance: a table without variance, or of rank r, has none, or r,
    and a table without usable rows gives no rows. Repeated rows count as often as they come.
    """
    stored = Vectors(usable(vectors, id_column, column))
    schema = f"vec_id {stored.id_type}, n long, deviation decimal(38,0), whitened array<double>"
    more = ", explained array<double>, identity_error double"
    if not stored.n:
        return stored.spark.createDataFrame([], schema + more)
    values, axes = components(stored, k, block, most)
    d, n, sums = stored.d, stored.n, stored.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, d):
            dev = deviations(x, n, sums)
            projected = dev.astype(float) / n @ axes
            total = [t if t < 10**38 else None for t in squared(dev)]
            exact = pa.array(total, pa.int64()).cast(pa.decimal128(38, 0)) if all(t is not None and t < 1 << 62 for t in total) else pa.array([None if t is None else Decimal(t) for t in total], pa.decimal128(38, 0))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]), pa.array(projected.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), n)), exact, rows], names=["vec_id", "n", "deviation", "whitened"])

    projected = checkpointed(stored.stored.mapInArrow(run, schema))
    # The trace is the sum of all squared deviations, over n for the mean and n^2 for their scale.
    scaled = projected.agg(F.sum(F.col("deviation").cast("double") / (float(n) * n)).alias("t"), F.count_if(F.col("deviation").isNull()).alias("lost")).first()
    trace = float(scaled["t"] or 0.0) / n
    if scaled["lost"]:
        trace = sum(float(r["t"]) for r in stored.stored.mapInArrow(_wide_trace(d, n, sums), "t double").agg(F.sum("t").alias("t")).collect()) / n
    real = [i for i, e in enumerate(values) if e > NOTHING * trace and trace > 0]
    scale = [float(1 / np.sqrt(values[i])) for i in real]
    white = F.array(*[F.col("whitened")[i] * F.lit(s) for i, s in zip(real, scale, strict=True)]).cast("array<double>")
    rows = projected.withColumn("whitened", white)
    shares = [float(values[i]) / trace for i in real]
    return rows.withColumn("explained", F.array(*map(F.lit, shares)).cast("array<double>")).withColumn("identity_error", F.lit(identity_error(rows, len(real), n)).cast("double"))


def _wide_trace(d: int, n: int, sums: list[int]) -> Callable:
    """Sums of squared deviations over n^2 as doubles, where exact ones don't fit decimal(38,0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float(((deviations(x, n, sums).astype(float) / n) ** 2).sum()) for _, x in _batches(batches, d))
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

    return run


def identity_error(rows: DataFrame, k: int, n: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened values (divisor n, centred on their means) minus the identity; null without components."""
    if not k:
        return None
    mean = rows.agg(*[(F.sum(F.col("whitened")[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("whitened")[i] - F.lit(float(mean[i])) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*[(F.sum(off[i] * off[j]) / n).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(float(v) - (i == j)) for v, (i, j) in zip(sums, pairs, strict=True))


def long_rows(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation (long; null where it is too large for one), whitened, explained, identity_error."""
    rows = whitened.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
