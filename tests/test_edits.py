"""The edit log replayed at every place against lists, and the generator against a scalar one."""

import random

from pyspark.sql import functions as F

from catalake.functions.seeded import random32, uniform
from catalake.operators import edits, linkage


def replay(log, at):
    """Pending and submitted edits of each log, row by row."""
    pending, submitted = {}, {}
    for name, seq, action, kind, a, b in sorted((r for r in log if r[0] is not None and r[1] is not None and r[1] <= at), key=lambda r: r[1]):
        p, s = pending.setdefault(name, []), submitted.setdefault(name, [])
        x, y = (a or "").strip(), (b or "").strip()
        if action == "add" and x and y and x != y and kind in ("link", "ignore"):
            p.append((kind, (x, y) if kind == "link" else tuple(sorted((x, y))), a, b, seq))
        elif action == "submit":
            s.extend(p)
            p.clear()
        elif action == "clear":
            p.clear()
        elif action == "clear_submitted":
            s.clear()
    out = set()
    for name in pending:
        seen = set()
        for status, rows in (("submitted", submitted[name]), ("pending", pending[name])):
            for kind, key, a, b, seq in rows:
                if (kind, key) not in seen:
                    seen.add((kind, key))
                    out.add((name, status, kind, a, b, seq))
    return out


def test_replay_at_every_place(spark, monkeypatch):
    monkeypatch.setattr(edits, "PART", 7)
    rng = random.Random(2)
    log = []
    for seq in range(60):
        action = rng.choice(["add"] * 6 + ["submit", "clear", "clear_submitted", "other"])
        ends = [rng.choice(["1", "2", "3", " 2", "", None]) for _ in range(2)]
        log.append((rng.choice(["u", "v"]), seq, action, rng.choice(["link", "ignore", None]), *ends))
    log += [(None, 61, "submit", None, None, None), ("u", None, "add", "link", "1", "2")]
    frame = spark.createDataFrame(log, "log string, seq long, action string, kind string, a string, b string").withColumn("status", F.lit("own"))
    for at in (0, 5, 13, 29, 44, 100):
        assert {tuple(r) for r in edits.state(frame, at).collect()} == replay(log, at)
    end = edits.state(frame)
    assert {tuple(r) for r in end.collect()} == replay(log, 100)
    want = {}
    for name, status, kind, *_ in replay(log, 100):
        if status == "pending":
            want.setdefault(name, []).append(kind)
    assert {r["log"]: (r["n_links"], r["n_ignores"], r["n_total"]) for r in edits.counts(end).collect()} == {n: (k.count("link"), k.count("ignore"), len(k)) for n, k in want.items()}
    assert edits.state(frame.limit(0)).collect() == []


def scalar(seed, n):
    """The n-th draw, state by state, with 32-bit numbers."""
    low = (1 << 32) - 1
    t = seed & low
    for _ in range(n):
        t = t + 0x6D2B79F5 & low
    x = (t ^ t >> 15) * (t | 1) & low
    x ^= x + ((x ^ x >> 7) * (x | 61) & low) & low
    return x ^ x >> 14


def test_draws_and_samples(spark):
    for seed in (0, 1, 7, 123_456_789, (1 << 32) - 1, -5):
        got = spark.range(1, 200).select(random32(seed, F.col("id")).alias("x"), uniform(seed, F.col("id")).alias("u")).collect()
        assert [r["x"] for r in got] == [scalar(seed, n) for n in range(1, 200)] and all(0 <= r["u"] < 1 for r in got)
    items = spark.createDataFrame([(f"k{i}", i) for i in range(1, 301)], "sku string, place long").repartition(5)
    want = sorted((scalar(3, i), f"k{i}") for i in range(1, 301))[:40]
    assert [r["sku"] for r in linkage.sampled(items, 40, 3, "place").collect()] == [k for _, k in want]
    again = [r["sku"] for r in linkage.sampled(items, 40, 3).collect()]
    assert len(set(again)) == 40 and again == [r["sku"] for r in linkage.sampled(items.repartition(2), 40, 3).collect()]
