"""Streams that end by time: orders that close when nothing more comes, tills that fall silent; each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLOSED = "key string, order_id long, labels long, closed_ms long, trigger string"
CHANGED = "key string, at_ms long, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class OrderCloser(StatefulProcessor):
    """The open order of a key: its id, labels so far, and the time of its last event. It closes at the next receipt, or by a timer `idle` ms after that time."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "order_id long, labels long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(t), int(i), k) for f in rows for t, i, k in zip(f["ms"], f["id"], f["kind"], strict=True))
        order, labels, last = self.open.get() if self.open.exists() else (None, 0, None)
        out = []
        for ms, i, kind in events:
            if order is not None and ms - last > self.idle:
                out.append((key[0], order, labels, last + self.idle, "IDLE"))
                order = None
            if kind == "receipt":
                if order is not None:
                    out.append((key[0], order, labels, ms, "NEXT_RECEIPT"))
                order, labels, last = i, 0, ms
            elif order is not None:
                labels, last = labels + 1, ms
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if order is None:
            self.open.clear()
        else:
            self.open.update((order, labels, last))
            self.handle.registerTimer(last + self.idle + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "order_id", "labels", "closed_ms", "trigger"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        order, labels, last = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], order, labels, last + self.idle, "IDLE")], columns=["key", "order_id", "labels", "closed_ms", "trigger"])

    def close(self) -> None:
        pass


def order_close_stream(stream: DataFrame, idle_ms: int, lateness: str) -> DataFrame:
    """Orders as they close, of events (key, id, at, kind): by the next receipt, or when the watermark passes their last event by idle_ms.

    A closed order leaves no state. Events later than the lateness are dropped, as everywhere behind a watermark.
    """
    prepared(stream.sparkSession)
    rows = stream.withWatermark("at", lateness).select("key", "id", "kind", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(OrderCloser(idle_ms), CLOSED, "Append", "EventTime")


def order_closings(events: DataFrame, idle_ms: int, until_ms: int | None = None) -> DataFrame:
    """The batch twin: orders closed by the next receipt within idle_ms of their last event, else idle; those whose time isn't up by until_ms stay open."""
    ms = F.unix_millis("at")
    w = Window.partitionBy("key").orderBy("ms", "id")
    e = events.select("key", "id", "kind", ms.alias("ms"))
    gap = F.coalesce(F.col("ms") - F.lag("ms").over(w) > idle_ms, F.lit(True))
    e = e.withColumn("cut", gap | (F.col("kind") == "receipt"))
    e = e.withColumn("session", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy("key", "session").agg(F.max(F.when(F.col("kind") == "receipt", F.col("id"))).alias("order_id"), F.count_if(F.col("kind") == "label").alias("labels"), F.min("ms").alias("first"), F.max("ms").alias("last"))
    s = s.withColumn("next", F.lead("first").over(Window.partitionBy("key").orderBy("session"))).where("order_id IS NOT NULL")
    idle = F.coalesce(F.col("next") - F.col("last") > idle_ms, F.lit(True))
    s = s.select("key", "order_id", "labels", F.when(idle, F.col("last") + idle_ms).otherwise(F.col("next")).alias("closed_ms"), F.when(idle, "IDLE").otherwise("NEXT_RECEIPT").alias("trigger"))
    return s if until_ms is None else s.where((F.col("trigger") == "NEXT_RECEIPT") | (F.col("closed_ms") < until_ms))


class Silence(StatefulProcessor):
    """The last heartbeat of a key. A timer `quiet` ms after it says that the key is offline; then only the fact remains until it is back."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for ms in sorted(int(t) for f in rows for t in f["ms"]):
            if last is not None and ms - last > self.quiet:
                out.append((key[0], last + self.quiet, "OFFLINE"))
                last = None
            if last is None:
                out.append((key[0], ms, "ONLINE"))
            last = ms
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.last.update((last,))
        self.handle.registerTimer(last + self.quiet + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at_ms", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([(key[0], last + self.quiet, "OFFLINE")], columns=["key", "at_ms", "status"])

    def close(self) -> None:
        pass


def silence_stream(stream: DataFrame, quiet_ms: int, lateness: str) -> DataFrame:
    """Changes between online and offline of heartbeats (key, at): offline once the watermark is quiet_ms behind the last one."""
    prepared(stream.sparkSession)
    rows = stream.withWatermark("at", lateness).select("key", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(Silence(quiet_ms), CHANGED, "Append", "EventTime")


def silences(beats: DataFrame, quiet_ms: int, until_ms: int | None = None) -> DataFrame:
    """The batch twin: online at the first heartbeat and after each silence, offline quiet_ms after the last one before it."""
    w = Window.partitionBy("key").orderBy("ms")
    b = beats.select("key", F.unix_millis("at").alias("ms")).distinct()
    b = b.withColumn("starts", F.coalesce(F.col("ms") - F.lag("ms").over(w) > quiet_ms, F.lit(True))).withColumn("ends", F.coalesce(F.lead("ms").over(w) - F.col("ms") > quiet_ms, F.lit(True)))
    on = b.where("starts").select("key", F.col("ms").alias("at_ms"), F.lit("ONLINE").alias("status"))
    off = b.where("ends").select("key", (F.col("ms") + quiet_ms).alias("at_ms"), F.lit("OFFLINE").alias("status"))
    return on.unionByName(off if until_ms is None else off.where(F.col("at_ms") < until_ms))
