"""Keyed state of the latest event: equal to a batch result over a stop and a resume, with expiry."""

import datetime
import random

from pyspark.sql import functions as F

from catalake.streaming import latest

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "sku string, store_label string, ts timestamp, id long, kind string, price double"


def test_latest_events_resume_and_expire(spark, tmp_path):
    """Two runs with one checkpoint. Keys that come again have the batch's latest event; a key that doesn't expires once."""
    rng = random.Random(4)
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    got: list = []

    def run(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / name))
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        query = latest.latest_events(stream, "12 HOUR", "1 hour").writeStream.foreachBatch(lambda batch, n: got.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    event = lambda i, hours, key: (f"k{key}", f"s{key % 2}", T0 + datetime.timedelta(hours=hours), i, rng.choice(["new", "down"]), float(i))
    first = [event(i, rng.uniform(0, 3), i % 5) for i in range(40)] + [("k9", None, T0, 1, "new", 1.0), ("k9", "s", None, 2, "new", 1.0)]
    tie = T0 + datetime.timedelta(hours=4)
    second = [event(100 + i, rng.uniform(3, 5), i % 4) for i in range(30)] + [("k0", "s0", tie, 900, "tie", 1.0), ("k0", "s0", tie, 901, "tie wins", 2.0), ("k0", "s0", tie, 899, "tie", 3.0)]
    run("1", first)
    n_first = len(got)
    assert n_first and not any(r["expired"] for r in got)
    run("2", second)
    newest = {}
    for r in got:
        if not r["expired"]:
            newest[r["sku"], r["store_label"]] = (r["ms"], r["id"], r["kind"], r["price"])
    table = spark.createDataFrame(first + second, SCHEMA).where("ts is not null").withColumn("store_label", F.coalesce("store_label", F.lit(""))).withColumn("ms", F.unix_millis("ts"))
    want = {(r["sku"], r["store_label"]): tuple(r["e"]) for r in table.groupBy("sku", "store_label").agg(F.max_by(F.struct("ms", "id", "kind", "price"), F.struct("ms", "id")).alias("e")).collect()}
    assert newest == want
    # Days later every key's time is over: each leaves once, and comes anew where it has a new event.
    got.clear()
    run("3", [event(500, 72, 0)])
    run("4", [event(501, 74, 1)])
    expired = [(r["sku"], r["store_label"]) for r in got if r["expired"]]
    assert sorted(expired) == sorted(set(expired)) and set(expired) >= {k for k in want if k[0] not in ("k0", "k1")}
    assert {r["id"] for r in got if not r["expired"]} == {500, 501}
