"""Whitening against dense eigenvectors, exact deviations, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalake.llm import queries, whitening
from catalake.llm.fitting import in_task

SF = "/root/testdata/sf0.001"


def brute(spark, vectors):
    """x, n, deviations, eigenvalues and eigenvectors by numpy and Python's integers."""
    x = [[int(np.floor(1024 * float(e))) + 100_000 for e in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * e - s) / n for e, s in zip(v, sums, strict=True)] for v in x])
    values, axes = in_task(spark, np.linalg.eigh, centred.T @ centred / n)
    return centred, deviation, values[::-1], axes[:, ::-1]


def check(spark, rows, ids, vectors, k=8, close=1e-9):
    centred, deviation, values, axes = brute(spark, vectors)
    real = min(k, int((values > 1e-13 * values.sum()).sum()))
    assert len(rows) == real * len(ids)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(real):
        want = centred @ axes[:, c] / np.sqrt(values[c])
        have = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < close
        assert all(abs(got[i, c + 1]["explained"] - values[c] / values.sum()) < 1e-9 for i in ids)
    assert all(got[i, 1]["deviation"] == d and got[i, 1]["n"] == len(ids) for i, d in zip(ids, deviation, strict=True))
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    rows = queries.op12_embedding_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(spark, rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def frame(spark, vectors, ids=None):
    rows = [(i, v, "own") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").withColumn("n", F.lit("own")).withColumn("x", F.lit(1))


def test_odd_vectors(spark):
    """Nulls, NaN, infinities, other lengths, repeated rows and ids, and clashing columns."""
    good = [[1.0, 2.0, 0.5], [0.25, -3.0, 1.0], [4.0, 0.0, 0.0], [4.0, 0.0, 0.0], [-1.0, 7.5, 2.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [1.0, 2.0]]
    rows = whitening.long_rows(whitening.whiten(frame(spark, good + bad))).collect()
    check(spark, rows, list(range(5)), good)


def test_low_rank_and_no_variance(spark):
    """A breakdown restarts at random directions: rank 2 in 20 dimensions has two components, equal rows and no rows have none."""
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(2, 20)) * 8) / 8  # steps of 1/8 are whole in x, so that the rank stays 2
    vectors = (rng.integers(-9, 10, (60, 2)) @ base).tolist()
    check(spark, whitening.long_rows(whitening.whiten(frame(spark, vectors))).collect(), list(range(60)), vectors)
    assert whitening.long_rows(whitening.whiten(frame(spark, [[1.0, 2.0]] * 5))).collect() == []
    assert whitening.long_rows(whitening.whiten(frame(spark, [None]))).collect() == []
    out = whitening.long_rows(whitening.whiten(frame(spark, [[0.0]], [3]).limit(0)))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues(spark):
    """Six equal largest eigenvalues: the components span their space and the values are white."""
    vectors = [[s if j == i else 0.0 for j in range(6)] for i in range(6) for s in (1.0, -1.0)]
    rows = whitening.long_rows(whitening.whiten(frame(spark, vectors))).collect()
    white = np.zeros((12, 6))
    for r in rows:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(white.T @ white / 12 - np.eye(6)).max() < 1e-9 and all(abs(r["explained"] - 1 / 6) < 1e-9 for r in rows)


@pytest.mark.parametrize(("block", "most"), [(6, 36), (8, 48), (12, 192)])
def test_lanczos_with_restarts(spark, block, most):
    """Against a dense solver, with a basis far smaller than the dimension."""

    def solve():
        rng = np.random.default_rng(2)
        x = rng.normal(size=(400, 120)) * np.linspace(4, 1, 120)
        matrix = x.T @ x / 400
        state, passes = whitening.start(120, max(block, 6)), 0
        while not state["done"] and passes < 400:
            state = whitening.step(state, matrix @ state["next"], 6, most, 1e-12)
            passes += 1
        want, axes = np.linalg.eigh(matrix)
        cosines = np.sum(state["vectors"] * axes[:, ::-1][:, :6], 0)
        return state["done"], passes, np.abs(state["values"] - want[::-1][:6]).max(), np.abs(np.abs(cosines) - 1).max()

    done, passes, values, vectors = in_task(spark, solve)
    assert done and values < 1e-10 and vectors < 1e-9
    assert passes > 120 // max(block, 6) or most >= 120


def test_exact_numbers():
    """Deviations beyond 64 bits are exact, and entries too large for a double's integers are an error."""
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    n, sums = 1 << 30, [7, 1 << 50]
    assert whitening.squared(whitening.deviations(x, n, sums)) == [sum((n * int(e) - s) ** 2 for e, s in zip(v, sums, strict=True)) for v in x]
    assert whitening.squared(whitening.deviations(x[:0], n, sums)) == []
    assert whitening.integers(np.array([-0.5, 0.0009, 1.0])).tolist() == [99_488, 100_000, 101_024]
    with pytest.raises(ValueError, match="too large"):
        whitening.integers(np.array([1e30]))
