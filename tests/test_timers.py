"""Streams with timers beside their batch twins, in several batches and with a restart between them."""

import datetime
import random

from pyspark.sql import functions as F

from stockloom.streaming import capture as C
from stockloom.streaming import timers as X

BEGIN = datetime.datetime(2024, 1, 1)
FAR = 10_000_000


def events(rnd, n=240):
    """Events of four keys in order of time, and at last one of a fifth key far ahead, which moves the watermark past all others' timers."""
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([1, 1, 3, 12])
        rows.append((f"k{rnd.randrange(4)}", i, BEGIN + datetime.timedelta(seconds=t), rnd.choice(["receipt", "label", "label"])))
    return [*rows, ("z", n, BEGIN + datetime.timedelta(seconds=t + 1000), "label"), ("z", n + 1, BEGIN + datetime.timedelta(seconds=t + 1001), "label")]


def streamed(spark, rows, schema, make, path, stops):
    """What the stream gives if rows come in as many parts, each in a run of its own that starts from the last one's checkpoint."""
    for k in range(stops):
        part = rows[len(rows) * k // stops : len(rows) * (k + 1) // stops]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
        q = make(stream).writeStream.format("parquet").outputMode("append").option("path", str(path / "out")).option("checkpointLocation", str(path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(str(path / "out"))


def test_orders_close_by_time_or_the_next_receipt(spark, tmp_path):
    rows, schema = events(random.Random(5)), "key string, id long, at timestamp, kind string"
    want = {tuple(r) for r in X.order_closings(spark.createDataFrame(rows, schema), 30_000).collect()}
    got = [tuple(r) for r in streamed(spark, rows, schema, lambda s: X.order_close_stream(s, 30_000, "0 seconds"), tmp_path, 3).select("key", "order_id", "labels", "closed_ms", "trigger").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[4] for r in got} == {"IDLE", "NEXT_RECEIPT"}


def test_open_orders_stay_open(spark, tmp_path):
    schema = "key string, id long, at timestamp, kind string"
    rows = [("a", 1, BEGIN, "receipt"), ("a", 2, BEGIN + datetime.timedelta(seconds=5), "label")]
    assert streamed(spark, rows, schema, lambda s: X.order_close_stream(s, 30_000, "0 seconds"), tmp_path, 1).count() == 0
    assert X.order_closings(spark.createDataFrame(rows, schema), 30_000, until_ms=int(BEGIN.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) + 10_000).count() == 0


def test_silent_tills_go_offline_and_come_back(spark, tmp_path):
    rows, schema = [(k, t) for k, _, t, _ in events(random.Random(6))], "key string, at timestamp"
    want = {tuple(r) for r in X.silences(spark.createDataFrame(rows, schema), 40_000).where("key <> 'z'").collect()}
    got = [tuple(r) for r in streamed(spark, rows, schema, lambda s: X.silence_stream(s, 40_000, "0 seconds"), tmp_path, 3).where("key <> 'z'").select("key", "at_ms", "status").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in got} == {"ONLINE", "OFFLINE"}


def test_idle_buffers_as_a_stream(spark, tmp_path):
    rows, schema = [(k, t, 30000) for k, _, t, _ in events(random.Random(7))], "key string, at timestamp, size long"
    make = lambda s: C.idle_buffers(s.withWatermark("at", "0 seconds"), "key", "20 seconds", 65536)
    want = {tuple(r) for r in C.idle_buffers(spark.createDataFrame(rows, schema), "key", "20 seconds", 65536).where("key <> 'z'").collect()}
    got = [tuple(r) for r in streamed(spark, rows, schema, make, tmp_path, 2).where(F.col("key") != "z").collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[4] for r in got)
