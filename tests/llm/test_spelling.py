"""Spelling variants against brute force: words, near words, forms and roots, and groups split to the last element."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalake.llm import spelling as S

SF = "/root/testdata/sf0.001"


def brute_words(rows, length=5, count=3):
    n = Counter()
    for doc_id, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for word in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= count}


def brute_variants(words):
    """Each word's neighbours by every edit of it."""
    alphabet = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for c in alphabet for j in (0, 1)}
        near = sorted((e for e in edits if e in words and e != w), key=lambda e: (-words[e], e))
        best = near[0] if near and words[near[0]] >= 2 * n else None
        out[w] = (best, n, len(near), words[best] if best else None)
    root = {}
    for w in words:
        at = w
        while out[at][0] is not None:
            at = out[at][0]
        root[w] = at
    return {(w, f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def result(frame):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()}


@pytest.mark.parametrize("hot", [S.HOT, 20])
def test_against_every_edit(spark, hot):
    """The same rows whether groups stay whole or are split, element by element, as far as they may be."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    words = brute_words([(r["doc_id"], r["text"]) for r in table.collect()])
    want = brute_variants(words)
    assert result(S.variants(table, hot=hot)) == want and len(want) > 1000


def crowded(seed=3):
    """Words over two letters, so that nearly all trigrams are frequent and most words have many neighbours, and repeated trigrams within a word."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(400)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "babababab", "éaaaa", "aéaaa", "aaaaÿ", "a" * 300, "a" * 301, "b" + "a" * 300}
    return {w: rng.choice([3, 4, 6, 9, 30, 100]) for w in sorted(words)}


@pytest.mark.parametrize("hot", [1, S.HOT])
def test_crowded_words(spark, hot):
    words = crowded()
    pairs = S.near_pairs(S.grouped(S.with_elements(spark.createDataFrame(list(words.items()), "word string, n long")), hot)).collect()
    got = Counter((r["word"], r["near"]) for r in pairs)
    want = {(w, e) for w in words for e in words if len(e) >= len(w) and S.one_edit(w, e)}
    assert set(got) == want | {(b, a) for a, b in want} and set(got.values()) == {1}
    near = Counter(a for a, _ in got)
    assert near == Counter({w: k for w, _, _, _, k, _ in brute_variants(words) if k})


def test_one_edit():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(len(a) + rng.randint(0, 1)))
        near = a != b and (any(a == b[:i] + b[i + 1 :] for i in range(len(b))) if len(b) > len(a) else sum(x != y for x, y in zip(a, b, strict=True)) == 1)
        assert S.one_edit(a, b) == near, (a, b)
    assert not S.one_edit("abc", "abcde")


def test_runs():
    """Latin letters up to U+00FF belong to words, all else ends them, and A-Z alone is lower-cased."""
    text = "ÀbC dÉf×÷ÿx œuvre naïve12x łódź 日本goİ µm Áb"
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    assert [w.decode() for w in S.runs(text)] == re.findall("[A-Za-zÀ-ÿ]+", lower)
    rng = random.Random(9)
    odd = "aZ é×ÀÿĀœ€一\U0001f600 -'\n"
    for _ in range(300):
        text = "".join(rng.choice(odd) for _ in range(40))
        assert [w.decode() for w in S.runs(text)] == re.findall("[A-Za-zÀ-ÿ]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_forms_lead_to_roots(spark):
    """A chain of forms, ties by code point, a word that is no form's double, and clashing columns."""
    words = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "zzzzy": 7, "zzzzx": 14, "zzzza": 14, "quiet": 5, "quiex": 9}
    # Ids at which no run of the text is misspelt.
    ids = [i for i in range(4000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in words)]
    texts = [" ".join(w for w, n in words.items() if n > i) for i in range(48)]
    rows = list(zip(ids, texts, strict=False))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, n int, word string").withColumn("size", F.lit(1))
    got = {r["word"]: r for r in S.variants(docs).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    assert [got[w]["root"] for w in ("abcde", "abcdef", "abcdefgh", "abcdefghi")] == ["abcdefghi"] * 4 and got["abcdefghi"]["form"] is None
    assert (got["zzzzy"]["form"], got["zzzzy"]["form_n"], got["zzzzy"]["n_near"]) == ("zzzza", 14, 2)
    assert (got["quiet"]["form"], got["quiet"]["root"], got["quiet"]["n_near"], got["quiet"]["form_n"]) == (None, "quiet", 1, None)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and no rows."""
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}word" for i in range(30_000))
    rows = [(None, "ghost ghost ghosts"), (None, "ghost ghost ghosts ghosts"), (1, None), (2, ""), (3, "12 !"), (4, long), (4, long), (5, "x" * 20_000), (6, "x" * 20_000), (7, "x" * 20_000)]
    want = brute_variants(brute_words(rows))
    assert result(S.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want and any(w == "ghost" for w, *_ in want)
    empty = S.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_elements_number_repeated_trigrams():
    gram, word, place = S.trigrams(["aaaaa", "é"])
    assert word.tolist() == [0] * 7 + [1] * 3 and place.tolist() == [0, 1, 2, 3, 4, 5, 6, 0, 1, 2]
    assert len(np.unique(gram)) == 5 + 3
