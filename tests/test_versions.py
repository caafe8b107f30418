"""The version store: whole versions, two writers, interrupted writes, comparisons, and indexes kept over versions."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from catalake.operators import index
from catalake.sources.versions import Conflict, KeptIndex, VersionStore

SCHEMA = "db_file string, sku string, url string, price_num double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(rows):
    return sorted(tuple(r[c] for c in ("db_file", "sku", "url", "price_num")) for r in rows.collect())


def statuses(rows):
    return {r["db_file"]: r["status"] for r in rows.collect()}


def test_versions_stay_as_they_were(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    assert store.head() == 0 and store.log().collect() == [] and store.files().collect() == []
    a1, b1, b2, c2 = (("a", "1", "u1", 1.0), ("b/x=y %", "2", "u2", 2.0), ("b/x=y %", "2", "u2", 3.0), ("c", None, None, None))
    assert store.commit(frame(spark, [a1, a1, b1]), note="first") == 1
    assert store.commit(frame(spark, [b2, c2]), parent=1) == 2
    assert store.commit(frame(spark, []), deleted=spark.createDataFrame([("a",), ("nope",)], "db_file string")) == 3
    assert content(store.read(1)) == sorted([a1, a1, b1]) and content(store.read(2)) == sorted([a1, a1, b2, c2], key=str)
    assert sorted(r["db_file"] for r in store.files().collect()) == ["b/x=y %", "c"]
    assert statuses(store.changed(None, 1)) == {"a": "added", "b/x=y %": "added"}
    assert statuses(store.changed(1, 2)) == {"b/x=y %": "changed", "c": "added"} and statuses(store.changed(2, 3)) == {"a": "deleted"}
    assert statuses(store.changed(3, frame(spark, [b2, ("d", "1", "u", 1.0)]))) == {"c": "deleted", "d": "added"}
    assert statuses(store.changed(2, frame(spark, [c2, b2, a1, a1]))) == {} and statuses(store.changed(2, frame(spark, [c2, b2, a1]))) == {"a": "changed"}
    asked = spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "db_file string, k int")
    assert {r["k"]: r["exists"] for r in store.exists(asked, 1).collect()} == {1: True, 2: False, 3: False}
    assert {r["k"]: r["exists"] for r in store.exists(asked, 3).collect()} == {1: False, 2: True, 3: False}
    assert {(r["version"], r["parent"], r["note"]) for r in store.log().collect()} == {(1, 0, "first"), (2, 1, ""), (3, 2, "")}
    assert content(store.read(2, spark.createDataFrame([("c",)], "db_file string"))) == [c2]
    with pytest.raises(ValueError, match="no rows"):
        store.read(0)
    with pytest.raises(Exception, match="no db_file"):
        store.commit(frame(spark, [(None, "1", "u", 1.0)]))
    assert store.head() == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers that reach their records at one time: both commits are versions, and a reader meanwhile sees whole ones."""
    store = VersionStore(spark, str(tmp_path))
    store.commit(frame(spark, [("a", "1", "u", 1.0), ("b", "1", "u", 1.0)]))
    gate, made = threading.Barrier(2, timeout=60), {}

    def meet():
        try:
            gate.wait()
        except threading.BrokenBarrierError:
            pass

    def write(name):
        first = iter([meet])
        made[name] = VersionStore(spark, str(tmp_path)).commit(frame(spark, [(name, "2", "u", 2.0)]), parent=1, before_record=lambda: next(first, lambda: None)())

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made.values()) == [2, 3]
    assert content(store.read(3)) == [("a", "2", "u", 2.0), ("b", "2", "u", 2.0)]
    with pytest.raises(Conflict, match="since version 1"):
        store.commit(frame(spark, [("a", "9", "u", 9.0)]), parent=1)
    assert store.head() == 3 and len(content(store.read())) == 2


def test_an_interrupted_write_is_no_version(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    store.commit(frame(spark, [("a", "1", "u", 1.0)]))

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(frame(spark, [("a", "2", "u", 2.0), ("z", "2", "u", 2.0)]), before_record=stop)
    assert store.head() == 1 and content(store.read()) == [("a", "1", "u", 1.0)]
    assert store.commit(frame(spark, [("b", "3", "u", 3.0)]), parent=1) == 2 and len(content(store.read())) == 2


def test_a_record_is_written_once(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    assert store._create_once("commits/x", "one") and not store._create_once("commits/x", "two")
    assert (tmp_path / "commits" / "x").read_text() == "one" and not list((tmp_path / "staged").glob("[!.]*"))


def test_kept_indexes_equal_rebuilt_ones(spark, tmp_path):
    """After each of several versions, loaded in and out of order; only keys that changed are built."""
    rng, store = random.Random(1), VersionStore(spark, str(tmp_path))
    built = []

    def build(rows):
        return rows.groupBy("sku").agg(F.count("*").alias("n"), F.min("price_num").alias("least"), F.max("url").alias("last"))

    def counted(rows):
        built.append(rows.select("sku").distinct().count())
        return build(rows)

    kept = KeptIndex(store, "prices", counted)
    files = {f"f{i}": [(f"f{i}", f"s{rng.randint(0, 40)}", f"u{i}-{j}", float(rng.randint(1, 9))) for j in range(30)] for i in range(4)}
    for version in range(1, 6):
        if version > 1:
            name = rng.choice(sorted(files))
            rows = files[name]
            rows[rng.randrange(len(rows))] = (name, f"s{rng.randint(0, 60)}", "new", float(version))
            rows.pop(rng.randrange(len(rows)))
            if version == 4:
                del files["f0"]
                store.commit(frame(spark, [r for f in files.values() for r in f]), spark.createDataFrame([("f0",)], "db_file string"))
            else:
                store.commit(frame(spark, rows))
        else:
            store.commit(frame(spark, [r for f in files.values() for r in f]))
        if version != 3:
            got = sorted(map(tuple, kept.load().select("sku", "n", "least", "last").collect()))
            assert got == sorted(map(tuple, build(store.read(version)).collect()))
    assert built[0] > 30 and max(built[1], built[3]) <= 8
    assert sorted(map(tuple, kept.load(3).collect())) == sorted(map(tuple, build(store.read(3)).select(*kept.load(3).columns).collect()))
    kept.load(5)
    assert len(built) == 5  # versions that are there aren't made again


def test_the_cheapest_index(spark, tmp_path):
    rows = [("a", "1", "u1", 2.0), ("a", "2", "u2", 5.0), ("b", "1", "u3", 1.0)]
    full = lambda rows: frame(spark, rows).selectExpr("*", "db_file AS store_label", "false AS removed", "timestamp'2024-01-01' AS ts")
    store = VersionStore(spark, str(tmp_path))
    kept = KeptIndex(store, "cheapest", index.cheapest)
    store.commit(full(rows))
    assert {tuple(r) for r in kept.load().collect()} == {("1", "b", 1.0), ("2", "a", 5.0)}
    store.commit(full([("b", "1", "u3", 3.0)]))
    assert {tuple(r) for r in kept.load().collect()} == {("1", "a", 2.0), ("2", "a", 5.0)}
