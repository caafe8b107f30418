"""Linkage against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalake.functions import text as X
from catalake.operators import components, linkage, report
from catalake.session import checkpointed


def pairs_of(seed, n=60, keys=18):
    rng = np.random.default_rng(seed)
    return [(f"k{a}", f"k{b}", float(s)) for a, b, s in zip(rng.integers(0, keys, n), rng.integers(0, keys, n), rng.integers(0, 6, n), strict=True)]


def test_greedy_match_against_brute_force(spark):
    for seed in range(2):
        rows = pairs_of(seed)
        stores = {f"k{i}": [f"s{i % 5}"] for i in range(18)}
        used, want = set(), []
        for s, a, b in sorted((-s, a, b) for a, b, s in rows):
            if a != b and not {a, b} & used and not set(stores[a]) & set(stores[b]):
                used |= {a, b}
                want.append((a, b, -s))
        table = spark.createDataFrame(rows, "a string, b string, score double")
        known = spark.createDataFrame(list(stores.items()), "sku string, stores array<string>")
        assert sorted(map(tuple, linkage.greedy_match(table, stores=known).collect())) == sorted(want)
        assert [tuple(r) for r in linkage.greedy_match(table, 3, known).collect()] == want[:3]
    assert linkage.greedy_match(table.limit(0)).count() == 0


def test_capped_pairs_against_brute_force(spark):
    rows = [(a, "p" + b, s) for a, b, s in pairs_of(7, 80, 6)] + [("full", f"x{k}", 9.0) for k in range(4)] + [("k1", "x3", 1.0)]
    used, room, want = set(), {}, []
    for s, a, b in sorted((-s, a, b) for a, b, s in rows):
        if b not in used and room.get(a, 0) < 2:
            used.add(b)
            room[a] = room.get(a, 0) + 1
            want.append((a, b, -s))
    table = spark.createDataFrame(rows, "anchor string, sku string, score double")
    assert sorted(map(tuple, linkage.capped_pairs(table, 2).collect())) == sorted(want)


def greedy(rows):
    used, want = set(), []
    for s, a, b in sorted((-s, a, b) for a, b, s in rows):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, -s))
    return want


def test_a_long_chain_of_falling_scores(spark):
    """10,000 pairs that wait for each other end in a few rounds: beside it a star, and pairs in components of their own."""
    rows = [(f"k{i:05}", f"k{i + 1:05}", float(20_000 - i)) for i in range(10_000)] + [("hub", f"s{i}", float(i % 7)) for i in range(300)] + [(f"x{i}", f"y{i}", 1.0) for i in range(2_000)]
    table = spark.createDataFrame(rows, "a string, b string, score double")
    assert sorted(map(tuple, linkage.greedy_match(table).collect())) == sorted(greedy(rows))
    caps = [(f"a{i:04}", f"p{j:04}", float(9_000 - 2 * i - (j == i))) for i in range(4_000) for j in (i, i + 1)] + [(None, "p", 1.0), ("a", None, 1.0)]
    used, count, want = set(), {}, []
    for s, a, b in sorted((-s, a, b) for a, b, s in caps[:-2]):
        if b not in used and not count.get(a):
            used.add(b)
            count[a] = 1
            want.append((a, b, -s))
    table = spark.createDataFrame(caps, "anchor string, sku string, score double")
    assert sorted(map(tuple, linkage.capped_pairs(table, 1).collect())) == sorted(want)


def test_components_too_large_to_settle_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "SETTLED", 3)
    monkeypatch.setattr(linkage, "ROUNDS", 2)
    rows = [(f"k{i:02}", f"k{i + 1:02}", float(99 - i)) for i in range(16)] + [("x", "y", 1.0)]
    table = spark.createDataFrame(rows, "a string, b string, score double")
    assert sorted(map(tuple, linkage.greedy_match(table).collect())) == sorted(greedy(rows))


def test_regions_and_preferred_keys(spark):
    labels = ["Alberta Wine", "Store AB", "cab", "Strath", "BCL Calgary", None, "Kensington"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    assert [r[0] for r in rows.select(linkage.region(rows["label"])).collect()] == ["AB", "AB", "", "BC", "BC", "", ""]
    group = [(1, "000002", "AB"), (1, "000002", "BC"), (1, "000001", ""), (1, "u:1", "AB"), (2, "u:9", "BC"), (2, "u:8", "BC"), (3, "000005", "BC"), (3, "000004", "AB")]
    got = linkage.preferred_key(spark.createDataFrame(group, "grp int, sku string, region string")).collect()
    assert {r["grp"]: r["sku"] for r in got} == {1: "000002", 2: "u:8", 3: "000004"}


def test_similar_items_without_a_shared_token(spark):
    items = spark.createDataFrame([("a", "Glen One"), ("b", "Glem Ome"), ("u:c", "Other Thing"), ("d", "SMWS 1.23 x"), ("e", "SMWS 1.23 zz"), ("f", "")], "sku string, name string")
    got = {(r["a"], r["b"]): r["score"] for r in linkage.similar_to(items.where("sku in ('a', 'd')"), items).collect()}
    assert got["a", "b"] > 0 and got["d", "e"] == 1e9 and ("a", "a") not in got and ("a", "f") not in got
    small = linkage.measured
    try:
        linkage.measured = lambda frame: (small(frame)[0], False)
        again = {(r["a"], r["b"]): r["score"] for r in linkage.similar_to(items.where("sku in ('a', 'd')"), items).collect()}
    finally:
        linkage.measured = small
    assert again == got


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    with pytest.raises(RuntimeError):
        components.connected_components(chain, rounds=1)


def test_report_has_every_row(spark):
    rows = spark.createDataFrame([("new", "S", f"n{k:04d}", "$1", f"u{k}") for k in range(300)] + [("removed", "S", "x", "$2", "u")], "change string, store_label string, name string, price string, url string")
    lines = report.text(rows).split("\n")
    assert lines[0] == "NEW (300)" and lines[1] == "  S | n0000 | $1" and lines[301:] == ["UPDATED (0)", "REMOVED (1)", "  S | x | $2", "RESTORED (0)"]


@pytest.mark.parametrize(("k", "cells"), [(2, True), (5, True), (60, True), (5, False)])
def test_similar_names_lose_none_of_their_best(spark, monkeypatch, k, cells):
    """First tokens with few and many items, codes across first tokens, names without tokens, pinned names that a broadcast may not take."""
    if not cells:
        monkeypatch.setattr(linkage, "measured", lambda frame: (checkpointed(frame), False))
    rng = random.Random(k)
    words = ["glen", "ben", "rum", "oak", "12", "18", "cask"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(90)] + ["smws 12.34 oak", "rum smws 12.34", "smws 1.2 a", "", "the of", "zebra 12", "yak"]
    items = spark.createDataFrame([(("u:" if i % 9 == 0 else "s") + str(i), n) for i, n in enumerate(names)], "sku string, name string")
    pinned = items.where("cast(regexp_extract(sku, '[0-9]+', 0) as int) % 3 = 0 or sku in ('s91', 's92', 's94', 's95')")
    x, y = items.toDF("a", "na").join(pinned.select(F.col("sku").alias("a")), "a"), items.toDF("b", "nb")
    toks = X.similarity_tokens
    raw = X.similarity(F.col("na"), F.col("nb"), toks(F.col("na")), toks(F.col("nb"))) * F.when(F.col("a").startswith("u:") | F.col("b").startswith("u:"), 1.12).otherwise(1.0)
    code = X.code_key(F.col("na"))
    every = x.crossJoin(y).where("a <> b").select("a", "b", F.when((code != "") & (code == X.code_key(F.col("nb"))), 1e9).otherwise(F.round(raw, 6)).alias("score")).where("score > 0").collect()
    want = set()
    for a in {r["a"] for r in every}:
        want |= {tuple(r) for r in sorted((r for r in every if r["a"] == a), key=lambda r: (-r["score"], r["b"]))[:k]}
    assert {tuple(r) for r in linkage.similar_to(pinned, items, k).collect()} == want
