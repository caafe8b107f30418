"""Quality rules: fixed counts and a calibrated classifier on hashed n-grams.

``metrics`` gives the fixed counts of each text. ``train`` fits a logistic
regression on hashed word and character n-grams of labelled rows and calibrates
it with Platt's method on rows that were not used for the fit. ``score`` applies
it in Arrow batches; ``rules`` compares with fixed thresholds.

Defined results: a null or empty text has no words, fails the base rule and gets
the classifier's score of the empty feature vector. Repeated rows are scored
alike, and so are rows without an id. A score equal to the threshold keeps. Without
labelled rows of both kinds the classifier gives 1 to every text, so that only the base
rule rejects. An empty table gives no row. ``assess`` reads doc_id and text only;
``keep_good`` gives all columns back, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .fitting import Rows, fitted, labelled_sample, labelled_texts

#: Hash space of word features and of character n-gram features, each.
BUCKETS = 1 << 15
#: At most so many labelled rows are used to fit, those with the smallest hash of doc_id, and of them no more than have so many features together.
TRAIN_ROWS, TRAIN_FEATURES = 6000, 30_000_000
#: A text is kept if its calibrated probability of good quality is at least this.
KEEP_AT = 0.3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
DENSE = 6
CHAR_N = 4
#: Features of a row (with the bias), and what shares of n-grams are multiplied by.
SIZE, SCALE = 2 * BUCKETS + DENSE + 1, 20.0

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return n


def _repeat_words(hashes: np.ndarray, words: K.Words, size: int = 8) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it."""
    keys, at = K.windows(hashes, words, size)
    doc = words.doc()
    with np.errstate(over="ignore"):
        keys = keys + K.splitmix(doc[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.zeros(len(keys), bool)
    equal = sorted_keys[1:] == sorted_keys[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    mark = np.zeros(len(words) + 1, np.int64)
    found = at[order[same]]
    np.add.at(mark, found, 1)
    np.add.at(mark, found + size, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words.counts))


def chunk_metrics(chunk: K.Chunk) -> tuple[dict[str, np.ndarray], np.ndarray, K.Words]:
    words = K.Words(chunk)
    hashes = K.word_hashes(chunk.data, words)
    points = K.code_points(chunk.data)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(points[words.end] - points[words.start], out=total[1:])
    symbols = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(SYMBOLS[chunk.data], out=symbols[1:])
    raw, b = chunk.data.tobytes(), chunk.bounds
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": total[words.first[1:]] - total[words.first[:-1]],
        "n_symbols": symbols[b[1:]] - symbols[b[:-1]],
        "n_dup_lines": np.array([_duplicate_lines(raw[b[i] : b[i + 1]]) for i in range(len(chunk))], np.int64),
        "n_repeat_words": _repeat_words(hashes, words).astype(np.int64),
    }, hashes, words


def _dense(m: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(m["n_words"], 1)
    return np.stack([np.log1p(m["n_words"]) / 8, np.minimum(m["n_symbols"] / n, 3), np.minimum(m["n_dup_lines"] / 10, 2), m["n_repeat_words"] / n, np.minimum(m["word_chars"] / n / 10, 3), np.log1p(m["n_symbols"]) / 5], 1)


def _features(chunk: K.Chunk, hashes: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets with their documents, and character n-gram buckets with theirs."""
    w = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    grams = K.byte_ngrams(chunk.data, CHAR_N)
    doc = np.repeat(np.arange(len(chunk)), np.diff(chunk.bounds))
    at = np.flatnonzero(doc[: len(grams)] == doc[CHAR_N - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    g = (grams[at] & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS
    return w, words.doc(), g, doc[at]


@dataclass
class Model:
    weights: np.ndarray | None = None
    dense: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def score(self, chunk: K.Chunk, metrics: dict[str, np.ndarray], hashes: np.ndarray, words: K.Words) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(chunk))
        w, wd, g, gd = _features(chunk, hashes, words)
        n = len(chunk)
        z = np.bincount(wd, self.weights[w], n) / np.maximum(np.bincount(wd, minlength=n), 1)
        z += np.bincount(gd, self.weights[g], n) / np.maximum(np.bincount(gd, minlength=n), 1)
        z += _dense(metrics) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            metrics, hashes, words = chunk_metrics(chunk)
            w, wd, g, gd = _features(chunk, hashes, words)
            dense = _dense(metrics)
            idx, val = [], []
            tail = np.arange(2 * BUCKETS, SIZE)
            for i in range(len(chunk)):
                parts = []
                for b, d in ((w, wd), (g, gd)):
                    mine = b[np.searchsorted(d, i) : np.searchsorted(d, i, "right")]
                    u, c = np.unique(mine, return_counts=True)
                    parts.append((u, SCALE * c / max(len(mine), 1)))
                idx.append(np.concatenate([*(p[0] for p in parts), tail]).astype(np.int32))
                val.append(np.concatenate([*(p[1] for p in parts), dense[i], [1.0]]).astype(np.float32))
            part = batch.slice(chunk.first, len(chunk))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("fold"), part.column("place"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["label", "fold", "place", "idx", "val"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, features: int = TRAIN_FEATURES, epochs: int = 12, seed: int = 7) -> Model:
    """Fit on at most ``rows`` labelled rows with at most ``features`` features together, in one task; one row in five calibrates and is not fitted on.

    Rows without a label or an id are left out; of repeated rows each counts. The rows'
    order, and so the model, doesn't depend on how docs is partitioned.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        x = Rows(batches, ["idx", "val"], ["label", "fold"], features)
        y = np.asarray(x["label"], float)
        if len(set(y.tolist())) < 2:
            return np.zeros(0)
        held = x["fold"] % 5 == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        order = np.flatnonzero(~held)
        rng = np.random.default_rng(seed)
        theta, grad2 = np.zeros(SIZE), np.full(SIZE, 1e-6)
        weight = np.where(y == 1, 0.5 / max(y[order].mean(), 1e-9), 0.5 / max(1 - y[order].mean(), 1e-9))

        def scores(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            at, row = x.pick(some)
            cols, vals = x["idx"][at], x["val"][at]
            return np.bincount(row, theta[cols] * vals, len(some)), row, cols, vals

        for _ in range(epochs):
            rng.shuffle(order)
            for k in range(0, len(order), 32):
                some = order[k : k + 32]
                z, row, cols, vals = scores(some)
                error = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some])
                g = np.bincount(cols, error[row] * vals, SIZE) + 1e-4 * theta
                grad2 += g * g
                theta -= 0.1 * g / np.sqrt(grad2)
        z = np.concatenate([scores(np.arange(k, min(k + 500, len(y))))[0] for k in range(0, len(y), 500)])
        cal = np.flatnonzero(held) if held.any() else np.arange(len(y))
        return np.concatenate((theta, platt(z[cal], y[cal])))

    picked = labelled_texts(docs, labelled_sample(labels, label, rows))
    place = picked.schema["place"].dataType.simpleString()
    table = picked.mapInArrow(_sparse_rows, f"label int, fold long, place {place}, idx array<int>, val array<float>")
    model = fitted(table, fit)
    if not len(model):
        return Model()
    return Model(model[: 2 * BUCKETS] * SCALE, model[2 * BUCKETS : SIZE - 1], float(model[SIZE - 1]), float(model[SIZE]), float(model[SIZE + 1]))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve from scores to probabilities, with Platt's smoothed targets."""
    pos, neg = (y == 1).sum(), (y != 1).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - t) * z).sum() + 1e-6 * a, (p - t).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-6, (w * z).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return float(a), float(b)


def assess(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the five counts, base_failed, score (probability of good quality) and kept, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                m, hashes, words = chunk_metrics(chunk)
                score = model.score(chunk, m, hashes, words)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                ids = batch.column("doc_id").slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, m.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))], names=["doc_id", *m, "base_failed", "score", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {METRICS}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """docs without the rows that the rules or the classifier reject; all columns stay. Decided row by row, so repeated rows go or stay together."""
    model = train(docs, labels)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for chunk in K.chunks(batch.column("text")):
                m, hashes, words = chunk_metrics(chunk)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                keep.append(~failed & (model.score(chunk, m, hashes, words) >= keep_at))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.select(*columns).mapInArrow(run, docs.schema)
