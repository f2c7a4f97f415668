"""Streams of scans, receipts and labels, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockloom.operators.delivery import sorted_fold


def first_of_txn(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first event of each transaction; later ones within the lateness are acknowledged and dropped."""
    return stream.withWatermark("sold_at", lateness).dropDuplicatesWithinWatermark(["company", "txn"])


def accepted(times: pd.Series, last: float | None, gap: float) -> tuple[list[bool], float | None]:
    keep = []
    for t in times:
        ok = last is None or t - last >= gap
        keep.append(ok)
        last = t if ok else last
    return keep, last


def debounce_stream(stream: DataFrame, gap: float = 2.0) -> DataFrame:
    """Drops a code seen less than gap seconds after its last accepted scan. Rows: id, code, seconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seconds", "id"])
        keep, last = accepted(rows["seconds"], state.get[0] if state.exists else None, gap)
        state.update((last,))
        yield rows[keep][["id", "code", "seconds"]]

    return stream.groupBy("code").applyInPandasWithState(run, "id long, code string, seconds double", "last double", "append", GroupStateTimeout.NoTimeout)


def debounce(rows: DataFrame, gap: float = 2.0) -> DataFrame:
    """The batch twin: each code's scans in order of time, as a sorted stream; a dropped scan doesn't move the window.

    A scan at least `gap` behind the one before it is always accepted, whatever came of that one, so there a code's scans are cut into
    sessions and dealt out by them; within a session the next accepted scan is sought by bisection.
    """
    w = Window.partitionBy("code").orderBy("seconds", "id")
    cut = F.coalesce(F.col("seconds") - F.lag("seconds").over(w) >= gap, F.lit(True))
    s = rows.select("code", "seconds", "id").withColumn("session", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = None, 0.0
        for b in batches:
            codes, numbers, times = b.column("code").to_pylist(), b.column("session").to_pylist(), b.column("seconds").to_numpy()
            keep, i, n = [], 0, b.num_rows
            while i < n:
                mine, end = (codes[i], numbers[i]), i
                while end < n and (codes[end], numbers[end]) == mine:
                    end += 1
                if mine != session:
                    session, last = mine, times[i]
                    keep.append(i)
                    i += 1
                while i < end:
                    i += max(0, int(np.searchsorted(times[i:end], last + gap)) - 1)
                    while i < end and times[i] - last < gap:
                        i += 1
                    if i < end:
                        last = times[i]
                        keep.append(i)
                        i += 1
            yield b.select(["id", "code", "seconds"]).take(pa.array(keep, pa.int64()))

    return s.repartition("code", "session").sortWithinPartitions("code", "session", "seconds", "id").mapInArrow(run, "id long, code string, seconds double")


def order_sessions(events: DataFrame, keys: list[str], idle_seconds: int) -> DataFrame:
    """Labels attach to the open order: a receipt opens one; the next receipt or an idle gap closes it.

    events: keys, id, at (timestamp), kind ('receipt' or 'label'). Returns id and order_id, the receipt's
    id, null for labels without an open order.
    """
    w = Window.partitionBy(*keys).orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > idle_seconds * 1_000_000
    e = events.withColumn("cut", F.coalesce(gap, F.lit(True)).cast("int") + (F.col("kind") == "receipt").cast("int"))
    e = e.withColumn("session", F.sum(F.when(F.col("cut") > 0, 1).otherwise(0)).over(upto))
    s = Window.partitionBy(*keys, "session")
    return e.select("id", F.max(F.when(F.col("kind") == "receipt", F.col("id"))).over(s).alias("order_id"))


def refresh_buckets(batch: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """For foreachBatch: recomputes the summary of only those buckets that the batch touched."""
    touched = batch.select(*keys).distinct()
    return ledger.join(touched, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def order_session_stream(stream: DataFrame, idle_seconds: int) -> DataFrame:
    """order_sessions as a stream over (user, id, seconds, kind): the open order and the last event's time are each user's state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seconds", "id"])
        order, last = state.get if state.exists else (None, None)
        out = []
        for i, at, kind in zip(rows["id"], rows["seconds"], rows["kind"], strict=True):
            if last is None or at - last > idle_seconds:
                order = None
            order, last = (int(i) if kind == "receipt" else order), float(at)
            out.append((int(i), order))
        state.update((order, last))
        yield pd.DataFrame({"id": [i for i, _ in out], "order_id": pd.array([o for _, o in out], dtype="Int64")})

    return stream.groupBy("user").applyInPandasWithState(run, "id long, order_id long", "order_id long, last double", "append", GroupStateTimeout.NoTimeout)


def summary_stream(stream: DataFrame, ledger_of, keys: list[str], path: str, checkpoint: str):
    """Starts a stream whose batches recompute the summaries of the buckets they touch, each batch to its own folder under path."""

    def write(batch: DataFrame, number: int) -> None:
        refresh_buckets(batch, ledger_of(batch.sparkSession), keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_buffers(events: DataFrame, key: str, gap: str, most: int) -> DataFrame:
    """Bytes gathered until an idle gap: each buffer's start, number of parts and size, and whether it went over the cap.

    For batches and streams alike: a stream gives each buffer once the watermark has passed its gap, and then forgets it.
    """
    g = events.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("parts"), F.sum("size").alias("bytes"))
    return g.select(key, F.col("w.start").alias("start"), "parts", "bytes", (F.col("bytes") > most).alias("over"))


def key_bursts(events: DataFrame, key: str, gap: float, most: float) -> DataFrame:
    """Keystrokes (key, id, seconds, char) as codes: a gap begins a new one, and so does a burst's greatest length in time.

    Bursts typed too slowly for a scanner, over .08 seconds a character and half a second, are left out.
    """

    def step(state: tuple | None, r: tuple) -> tuple[tuple, tuple]:
        mine, i, seconds, char = r
        first, last, burst = state or (seconds, seconds, i)
        if seconds - last > gap or seconds - first > most:
            first, burst = seconds, i
        return (first, seconds, burst), (mine, burst, i, seconds, char)

    rows = sorted_fold(events.select(key, "id", "seconds", "char"), [key], ["seconds", "id"], step, f"{key} long, burst long, id long, seconds double, char string")
    g = rows.groupBy(key, "burst").agg(F.array_sort(F.collect_list(F.struct("seconds", "id", "char"))).alias("c"), F.min("seconds").alias("a"), F.max("seconds").alias("b"))
    typed = F.array_join(F.transform("c", lambda x: x["char"]), "")
    return g.where(F.col("b") - F.col("a") <= F.size("c") * 0.08 * gap / 0.5 + gap).select(key, "burst", typed.alias("code"))


def retries(attempts: DataFrame) -> DataFrame:
    """When a failed document is tried again: after 5 and then 30 seconds; a third failure goes to review."""
    delay = F.when(F.col("attempt") == 1, 5).when(F.col("attempt") == 2, 30)
    return attempts.withColumn("next_at", F.col("seconds") + delay).withColumn("status", F.when(delay.isNotNull(), "RETRY").otherwise("REVIEW"))
