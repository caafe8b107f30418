"""The language model against a scalar one, the sum of its probabilities, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalake.llm import language_model as L
from catalake.llm import queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def grams(docs, order):
    """(n-gram, context) of every token, by order."""
    for text in docs:
        line = ["<s>"] * (order - 1) + tokens(text)
        for i in range(order - 1, len(line)):
            yield [tuple(line[i - k : i + 1]) for k in range(order)]


class Scalar:
    """Plain dictionaries and loops."""

    def __init__(self, counted, out, order):
        self.order = order
        self.v = len({g[0] for g in grams(counted + out, order)})
        self.fit(counted)
        self.weight = [{} for _ in range(order)]
        if any(True for _ in grams(out, order)):
            self.learn(list(grams(out, order)))
        self.fit(counted + out)

    def fit(self, docs):
        self.count = [Counter() for _ in range(self.order)]
        for g in grams(docs, self.order):
            for k in range(self.order):
                self.count[k][g[k]] += 1
        self.n, self.texts = sum(self.count[0].values()), len(docs)

    def context(self, g, k):
        if k == 0:
            return self.n
        before = g[k][:-1]
        return self.texts if set(before) == {"<s>"} else self.count[k - 1][before]

    def mixed(self, g, weight):
        p = [1 / (self.v + 1)]
        own, w = [], []
        for k in range(self.order):
            c = self.context(g, k)
            own.append(self.count[k][g[k]] / c if c else 0.0)
            w.append(weight(k, c.bit_length()))
            p.append(w[-1] * own[-1] + (1 - w[-1]) * p[-1])
        return p, own, w

    def of(self, k, b):
        if b == 0:
            return 0.0
        have = sorted(x for x in self.weight[k] if x)
        if not have:
            return 0.5
        return self.weight[k][max([x for x in have if x <= b] or have[:1])]

    def learn(self, held_out):
        for _ in range(L.ROUNDS):
            used, reached = ([Counter() for _ in range(self.order)] for _ in range(2))
            for g in held_out:
                p, own, w = self.mixed(g, self.of)
                left = 1.0
                for k in reversed(range(self.order)):
                    b = self.context(g, k).bit_length()
                    mine = left * w[k] * own[k] / p[k + 1]
                    reached[k][b] += left
                    used[k][b] += mine
                    left -= mine
            new = [{b: min(used[k][b] / r, L.MOST_WEIGHT) if r > 0 else 0.5 for b, r in reached[k].items() if b} for k in range(self.order)]
            change = max(abs(new[k][b] - self.of(k, b)) for k in range(self.order) for b in new[k])
            self.weight = new
            if change < L.CLOSE:
                break

    def score(self, text):
        return sum(math.log10(self.mixed(g, self.of)[0][-1]) for g in grams([text], self.order))


def folds(spark, rows):
    out = {r["doc_id"]: r["o"] for r in spark.createDataFrame([(i,) for i in {i for i, _ in rows}], "doc_id long").withColumn("o", F.pmod(F.xxhash64("doc_id"), F.lit(L.LEFT_OUT)) == 0).collect()}
    train = [(i, t) for i, t in rows if not held(i)]
    return [t for i, t in train if not out[i]], [t for i, t in train if out[i]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_a_scalar_model(spark, monkeypatch, order):
    """Counts, weights and scores agree, over many small chunks and buckets as over one."""
    monkeypatch.setattr(L, "CHUNK", 3000)
    monkeypatch.setattr(L, "BUCKET", 2000)
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()] + [(9001, None), (9002, ""), (9003, "Ça VA ça va unknown"), (None, "the of the of"), (9004, "\x0b \x0c"), (9001, "again the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("own")).withColumn("fold", F.lit("own")).withColumn("score", F.lit("own")).repartition(3)
    counted, out = folds(spark, rows)
    assert counted and out
    scalar, got = Scalar(counted, out, order), L.score(docs, order).collect()
    n, v = sum(scalar.count[0].values()), scalar.v
    want = sorted(((str(i), held(i), len(tokens(t)), sum((w,) in scalar.count[0] for w in tokens(t)), n, sum(math.log10((scalar.count[0][(w,)] + 1) / (n + v + 1)) for w in tokens(t)), scalar.score(t)) for i, t in rows), key=str)
    have = sorted(((str(r["doc_id"]), *r[1:]) for r in got), key=str)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert np.allclose([h[5:] for h in have], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_probabilities_sum_to_one(spark):
    """Over every known word, the end and one unknown word, after contexts seen and not seen."""
    texts = ["a b a c", "a b b", "c c a", "b", "a d"] * 8
    train = [i for i in range(200) if not held(i)][: len(texts)]
    probe = [i for i in range(200, 400) if held(i)]
    rows = list(zip(train, texts, strict=True))
    asked = ["a b", "b zz", "zz", "", "zz a d"]
    got = {r["doc_id"]: r["score"] for r in L.score(spark.createDataFrame(rows + list(zip(probe, asked, strict=False)), "doc_id long, text string")).collect()}
    scalar = Scalar(*folds(spark, rows), 2)
    assert all(abs(got[i] - scalar.score(t)) < 1e-9 for i, t in zip(probe, asked, strict=False))
    for before in ("a", "b", "zz", "<s>"):
        assert abs(sum(scalar.mixed([(w,), (before, w)], scalar.of)[0][-1] for w in ["a", "b", "c", "d", None, "zz"]) - 1) < 1e-9


def test_held_out_documents_are_likelier_than_by_the_base(spark):
    rows = queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"] * 0.9


def test_tables_without_training_or_rows(spark):
    none = [i for i in range(300) if held(i)][:3]
    got = L.score(spark.createDataFrame([(i, "some words") for i in none], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 3
    empty = L.score(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_a_hot_text_and_long_texts(spark, monkeypatch):
    """Copies of a text in many chunks, and texts far longer than a chunk: counts are whole."""
    monkeypatch.setattr(L, "CHUNK", 500)
    long = " ".join(f"w{i % 997}" for i in range(5000))
    rows = [(i, "same words in every copy") for i in range(400)] + [(1000, long), (1001, long), (1002, "x" * 4000)]
    got = {r["doc_id"]: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    n = sum(len(tokens(t)) for i, t in rows if not held(i))
    assert {r["train_tokens"] for r in got.values()} == {n} and len(got) == len(rows)
    assert got[1000]["n_tokens"] == 5001 and len({round(r["score"], 9) for i, r in got.items() if i < 400}) == 1


def test_keys_travel_in_six_bytes():
    keys = np.array([0, 1, (1 << 48) - 1, (1 << 64) - 1, 1 << 63], np.uint64)
    assert L._from_six(L._six(keys)).tolist() == [int(k) & L._LOW for k in keys]
    keys.sort()
    at = L._bucket_bounds(keys, 8)
    assert [sum(1 for k in keys if int(k) * 8 >> 64 == b) for b in range(8)] == np.diff(at).tolist()
    assert [len(k) for k in L.Grams.of(pa.chunked_array([pa.array([], pa.string())]), 2).keys] == [0, 0]
