"""The latest event of each key as keyed state with expiry, over a stream.

State is one event a key. A key whose latest event is older than its time to live, by the
watermark, leaves: its row is sent once more, marked expired, and its state is dropped, so
state grows with the keys that are live and not with the history. A later event of the key
begins anew. The query resumes from its checkpoint with state and timers as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "ms long, id long, kind string, price double"
OUT = "sku string, store_label string, ms long, id long, kind string, price double, expired boolean"


class LatestEvent(StatefulProcessor):
    """Of a key's events the one with the largest time counts, of equal times the one with the largest id."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.last.get()) if self.last.exists() else None
        best = max((tuple(r) for r in ((x["ms"], x["id"], x["kind"], x["price"]) for x in rows)), key=lambda e: e[:2], default=None)
        if best is None or held is not None and best[:2] <= held[:2]:
            return
        if held is not None:
            self.handle.deleteTimer(held[0] + self.live_ms)
        self.last.update(best)
        self.handle.registerTimer(best[0] + self.live_ms)
        yield Row(sku=key[0], store_label=key[1], ms=best[0], id=best[1], kind=best[2], price=best[3], expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            held = tuple(self.last.get())
            if held[0] + self.live_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield Row(sku=key[0], store_label=key[1], ms=held[0], id=held[1], kind=held[2], price=held[3], expired=True)

    def close(self) -> None:
        """Nothing is held beside the state."""


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the state store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest_events(events: DataFrame, live: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes of the latest event of each (sku, store_label): a row where it changes, and one marked expired where it leaves.

    events is a stream with sku, store_label, ts, id, kind and price. Rows without ts or id
    have no place and are left out; later than ``late`` behind the newest, the engine drops them.
    """
    use_rocksdb(events.sparkSession)
    live_ms = int(events.sparkSession.sql(f"SELECT CAST(INTERVAL {live} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000)
    rows = events.where("ts is not null and id is not null").withWatermark("ts", late)
    keyed = rows.selectExpr("coalesce(sku, '') AS sku", "coalesce(store_label, '') AS store_label", "ts", "unix_millis(ts) AS ms", "cast(id as long) AS id", "kind", "cast(price as double) AS price")
    return keyed.groupBy("sku", "store_label").transformWithState(statefulProcessor=LatestEvent(live_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
