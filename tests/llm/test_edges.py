"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalake.llm import chat, decontaminate, html, minhash, packing, pii, quality, queries, secrets, tokens, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = ["node", "component", "key", "part", "side", "hub", "salt", "class", "rank", "piece", "run", "row", "of", "found", "seeds", "plain", "hidden", "uid", "value", "label", "fold", "place", "score", "kept", "host", "template", "sizes", "window", "offset", "sequence_id"]
LONG = " ".join(f"mail{i}@x.org" if i % 40 == 0 else f"long{i % 977}" for i in range(20_000))
TEXTS = [None, "", " \n", "one two three four five six seven eight", "one two three four five six seven eight", LONG, LONG + " end", "x" * 20_000, "a", "+1 (017) 555-7713 " * 300]
IDS = [1, 2, 3, 4, 4, None, 7, 8, None, 10]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(list(zip(IDS, TEXTS, strict=True)), "doc_id long, text string")
    return table.select("*", *[F.lit("own").alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4, 7, 8)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, TEXTS[3]), (1, TEXTS[3]), (None, TEXTS[3]), (2, None), (3, "")], "item_id short, text string")


def run(spark, docs):
    """Every operator on docs, as lists of rows."""
    path = queries.tokenizer("word_bpe_49k.json")
    model = toxicity.train(docs, labels(spark))
    out = {
        "minhash": minhash.mark_kept(docs), "packing": packing.pack(packing.tokenize(docs, path).drop("ids")), "toxicity": toxicity.score(docs, model), "locate": toxicity.locate(docs, model),
        "leaks": decontaminate.leaks(docs, bench(spark)), "pii": pii.find_personal_data(docs), "tokens": tokens.count_tokens(docs, queries.tokenizer("piece_bpe_32k.model")),
        "secrets": secrets.find_secrets(docs), "quality": quality.assess(docs, quality.train(docs, labels(spark))),
    }
    return {k: v.collect() for k, v in out.items()}


def test_operators_on_odd_rows(spark, docs):
    got = run(spark, docs)
    for name in ("minhash", "toxicity", "pii", "tokens", "secrets", "quality"):
        assert Counter(r["doc_id"] for r in got[name]) == Counter(IDS), name
    groups = {r["doc_id"]: r["component_id"] for r in got["minhash"] if r["doc_id"] is not None}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4, 7: 7, 8: 8, 10: 10}
    assert sum(r["length"] for r in got["packing"] if r["doc_id"] == 4) == 2 * 9
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in got["leaks"]} == {(4, 1, 1.0), (4, None, 1.0)}
    assert len({tuple(r) for r in got["leaks"]}) == len(got["leaks"]) == 2
    count = {r["doc_id"]: len(r["spans"]) for r in got["pii"] if r["doc_id"] is not None}
    assert count[1] == count[2] == 0 and count[7] == 500 and count[10] == 300


def test_operators_on_an_empty_table(spark, docs):
    assert not any(run(spark, docs.limit(0)).values())
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id short, turn int, role string, text string"), queries.tokenizer("piece_bpe_32k.model"))).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id short, url string, html string")).count() == 0


def test_near_duplicates_of_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    table = spark.createDataFrame([("b", text), ("a", text + " tail"), ("c", "other words stand here alone today"), (None, text)], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.components(table).collect()} == {"a": "a", "b": "a", "c": "c", None: None}


def test_chats_of_short_ids_nulls_and_ties(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "assistant", "a"), (None, 1, "assistant", LONG), (2, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id short, turn int, role string, text string").withColumn("window", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(table, queries.tokenizer("piece_bpe_32k.model"))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[None]["loss_chars"] == len(LONG) and got[None]["loss_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None), (1, "http://h/", "<article>" + "<p>word</p>" * 20_000), (None, "http://h/", "<p>x"), (None, "http://h/", "<p>x")]
    table = spark.createDataFrame(rows, "page_id short, url string, html string").select("*", *[F.lit("own").alias(c) for c in ("host", "template", "sizes", "text")])
    assert sorted(r["text"] for r in html.extract(table).collect()) == sorted(["", " ".join(["word"] * 20_000), "x", "x"])


def test_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    extra = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and set(out.select("node", "rank").distinct().collect()) <= {("own", "own")}, name
        assert stage(spark, extra.limit(0), SF).count() == 0
    hidden = {r["doc_id"]: r for r in corpus_pipeline.STAGES[3][1](spark, extra, SF).collect() if r["doc_id"] is not None}
    assert hidden[1]["text"] is None and "@" not in hidden[7]["text"] and hidden[7]["n_chars"] == len(hidden[7]["text"])


def test_redaction_of_rows_without_an_id(spark):
    def luhn(d):
        return sum((n := int(c) * (1 + k % 2)) - 9 * (n > 9) for k, c in enumerate(reversed(d))) % 10 == 0

    seeds = [f"text before employee number 4111 1111 1111 {n:04d} and after" for n in range(10_000) if luhn(f"411111111111{n:04d}")][:12]
    texts = [*seeds, "some words employee number ZX-20419-77 end"]
    table = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r["text"] for r in pii.redact(table).collect())[0] == "some words employee number [CONTEXT] end"


def test_models_do_not_depend_on_partitioning(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module, name in ((quality, "assess"), (toxicity, "score")):
        one, two = (getattr(module, name)(docs, module.train(d, known)).select("doc_id", "score").collect() for d in (docs, docs.repartition(7)))
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_noisy_or_against_brute_force(spark):
    import re

    import numpy as np

    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, known)
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:60] + ["No. Yes! a-b"]
    from catalake.llm import kernels as K
    import pyarrow as pa

    def weight(term):
        chunk = next(K.chunks(pa.array([term])))
        return model.weights[toxicity._terms(chunk)[0][0]] if model.weights is not None else 0.0

    def brute(text):
        none = 1.0
        for sentence in re.split(r"[.!?\n]", "".join(c.lower() if c.isascii() else c for c in text)):
            terms = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", sentence)
            if terms and model.weights is not None:
                none *= 1 - 1 / (1 + np.exp(-np.clip(model.bias + sum(map(weight, terms)), -30, 30)))
        return 1 - none

    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(abs(r["score"] - brute(texts[r["doc_id"]])) < 1e-9 for r in got)
