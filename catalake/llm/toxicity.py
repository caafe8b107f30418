"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's score
is logistic in its hashed terms, and the document's score is the noisy-or of its
sentences' scores: one minus the product of their complements. The gradient of
the document's loss reaches each sentence through that product, so that training
finds the sentences that make a document toxic; ``locate`` returns them.

Terms are lower-cased (A-Z) runs of ASCII letters and digits and of bytes beyond
ASCII. Defined results: null and empty texts score 0 sentences, which is 0.
Repeated rows score alike, and so do rows without an id; a score equal to the threshold
is toxic. Without labelled rows of both kinds every score is 0. An empty table gives no
row. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .fitting import Rows, fitted, labelled_sample, labelled_texts

#: At most so many labelled rows are fitted, those with the smallest hash of doc_id, and of them no more than have so many terms together.
TRAIN_ROWS, TRAIN_TERMS = 8000, 20_000_000
BUCKETS = 1 << 18
#: Terms of fewer fitted documents, or whose share of toxic documents exceeds that of
#: others by fewer standard errors, carry no weight: labels are noisy and terms many.
LEAST_DOCS, LEAST_Z = 5, 4.0
TOXIC_AT = 0.3
#: The score of a sentence without telling terms, in log odds; the weight that telling terms start from; least gradient steps.
BIAS, START, STEPS = -8.0, 6.0, 400
SENTENCE_END = np.isin(np.arange(256), list(b".!?\n"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence of every term; document and byte start of every sentence with a term."""
    data = K.LOWER[chunk.data]
    words = K.Words(K.Chunk(data, chunk.bounds, 0), K.NOT_TERM)
    bucket = (K.word_hashes(data, words) & np.uint64(BUCKETS - 1)).astype(np.int64)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SENTENCE_END[data], out=ends[1:])
    doc = words.doc()
    if not len(words):
        return bucket, doc, doc, doc
    # Terms of one document with the same number of sentence ends before them are one sentence.
    place = ends[words.start]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    return bucket, np.cumsum(fresh) - 1, doc[fresh], words.start[fresh]


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = BIAS

    def sentences(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, document and byte start of every sentence with a term."""
        bucket, sentence, doc, start = _terms(chunk)
        if self.weights is None:
            return np.zeros(len(doc)), doc, start
        z = self.bias + np.bincount(sentence, self.weights[bucket], len(doc))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), doc, start

    def score(self, chunk: K.Chunk) -> np.ndarray:
        p, doc, _ = self.sentences(chunk)
        return 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(chunk)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            bucket, sentence, doc, _ = _terms(chunk)
            of = doc[sentence] if len(sentence) else sentence
            cut = np.searchsorted(of, np.arange(len(chunk) + 1))
            idx = [pa.array(bucket[cut[i] : cut[i + 1]].astype(np.int32)) for i in range(len(chunk))]
            sen = [pa.array((sentence[cut[i] : cut[i + 1]] - (sentence[cut[i]] if cut[i] < cut[i + 1] else 0)).astype(np.int32)) for i in range(len(chunk))]
            part = batch.slice(chunk.first, len(chunk))
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("place"), pa.array(idx, pa.list_(pa.int32())), pa.array(sen, pa.list_(pa.int32()))], names=["label", "place", "idx", "sentence"])


def _telling(total: np.ndarray, toxic: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Buckets that enough documents have and whose shares of the two kinds of documents differ clearly."""
    share = (total + 1) / (n_toxic + n_other + 2)
    gap = toxic / n_toxic - (total - toxic) / n_other
    return (total >= LEAST_DOCS) & (gap >= LEAST_Z * np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other)))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = TRAIN_ROWS, terms: int = TRAIN_TERMS, epochs: int = 15, seed: int = 5) -> Model:
    """Fit on at most ``rows`` rows of labels that satisfy ``where``, with at most ``terms`` terms together, in one task. Rows without a label or an id are left out."""

    def fit(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        x = Rows(batches, ["idx", "sentence"], ["label"], terms)
        y, flat, inner = np.asarray(x["label"], float), x["idx"], x["sentence"]
        if len(set(y.tolist())) < 2:
            return np.zeros(0)
        doc = np.repeat(np.arange(len(y)), np.diff(x.at))
        pairs = np.unique(doc * BUCKETS + flat)
        useful = _telling(np.bincount(pairs % BUCKETS, minlength=BUCKETS), np.bincount(pairs[y[pairs // BUCKETS] == 1] % BUCKETS, minlength=BUCKETS), (y == 1).sum(), (y != 1).sum())
        sizes = np.zeros(len(y), np.int64)
        np.maximum.at(sizes, doc, inner + 1)
        # The bias is set, not learnt: mislabelled documents without any telling term would raise it, and long clean documents with it.
        w, grad2, bias = np.where(useful, START, 0.0), np.full(BUCKETS, 1e-3), BIAS
        rng = np.random.default_rng(seed)
        order = np.arange(len(y))
        heavier = min(4.0, (y == 0).sum() / max((y == 1).sum(), 1))
        for _ in range(max(epochs, -(-STEPS * 128 // len(order)))):
            rng.shuffle(order)
            for k in range(0, len(order), 128):
                pick = np.sort(order[k : k + 128])
                mine, row = x.pick(pick)
                told = useful[flat[mine]]
                mine, row = mine[told], row[told]
                # Sentences of the picked documents, numbered from 0, and the document of each.
                first = np.concatenate(([0], np.cumsum(sizes[pick])))
                own = np.repeat(np.arange(len(pick)), sizes[pick])
                local = first[row] + inner[mine]
                p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(local, w[flat[mine]], len(own)), -30, 30)))
                none = np.exp(np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-9)), len(pick)))[own]
                g = np.where(y[pick][own] == 1, -heavier * p * none / np.maximum(1 - none, 1e-6), p)
                grad = np.bincount(flat[mine], g[local], BUCKETS) + 2e-3 * w * len(pick) / 128
                touched = grad != 0
                grad2[touched] += grad[touched] ** 2
                w[touched] -= 0.5 * grad[touched] / np.sqrt(grad2[touched])
        w[~useful] = 0
        return np.concatenate((w, [bias]))

    picked = labelled_texts(docs, labelled_sample(labels, "toxic", rows, where))
    place = picked.schema["place"].dataType.simpleString()
    model = fitted(picked.mapInArrow(_bags, f"label int, place {place}, idx array<int>, sentence array<int>"), fit)
    return Model(model[:BUCKETS], float(model[BUCKETS])) if len(model) else Model()


def score(docs: DataFrame, model: Model, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                s = model.score(chunk)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(s), pa.array((s >= toxic_at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def locate(docs: DataFrame, model: Model, least: float = TOXIC_AT) -> DataFrame:
    """doc_id, start (code points) and score of each sentence that alone scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                p, doc, start = model.sentences(chunk)
                hit = p >= least
                points = K.code_points(chunk.data)
                at = points[start[hit]] - points[chunk.bounds[doc[hit]]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(chunk)).take(pa.array(doc[hit])), pa.array(at), pa.array(p[hit])], names=["doc_id", "start", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start long, score double")
