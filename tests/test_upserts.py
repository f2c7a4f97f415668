"""Bucketed tables under streams of changes: replays, restarts, and files that stay."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom.streaming import upserts as U

SCHEMA = "key long, v long, x string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def table(spark, path):
    return {r.key: (r.v, r.x) for r in spark.read.parquet(path).collect()}


def test_the_same_batch_twice_gives_the_same_table(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    batches = [[(k, 1, f"a{k}") for k in range(40)], [(3, 5, "new"), (3, 4, "older"), (99, 1, "added"), (None, 1, "no key")], [(3, 2, "late")], []]
    for rows in batches:
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2):
            U.upsert_batch(batch, path, ["key"], "v", 8)
        for k, v, x in rows:
            if k not in want or v > want[k][0]:
                want[k] = (v, x)
        assert table(spark, path) == want
    assert spark.read.parquet(path).count() == len(want)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    U.upsert_batch(spark.createDataFrame([(k, 1, "a") for k in range(200)], SCHEMA), path, ["key"], "v", 8)
    before = files(path)
    U.upsert_batch(spark.createDataFrame([(5, 2, "b")], SCHEMA), path, ["key"], "v", 8)
    assert len(before - files(path)) == 1 and len(before) == 8 and table(spark, path)[5] == (2, "b") and len(table(spark, path)) == 200


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def apply(batch):
        seen.append(batch.count())
        U.upsert_batch(batch, path, ["key"], "v", 4)

    for n in range(3):
        spark.createDataFrame([(k, n, f"run{n}") for k in range(n, 10)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = U.sink(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), apply, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert seen == [10, 9, 8] and table(spark, path) == {0: (0, "run0"), 1: (1, "run1")} | {k: (2, "run2") for k in range(2, 10)}


def test_late_mappings_price_pending_sales_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(i, 1 + i % 2, f"00000{i % 4}", f"200000{i % 4}012340", Decimal(i + 10), True, i == 7) for i in range(12)] + [(50, 1, "000001", "x", Decimal(5), False, False)]
    U.bucketed_sales(spark.createDataFrame(rows, "id long, store int, code string, barcode string, amount decimal(18,2), needs_mapping boolean, is_cancelled boolean"), path, 4)
    maps = [("000001", "p1", Decimal(10), "FIXED", None, 1), ("000001", "own", Decimal(5), "FIXED", 2, 1)], [("000003", "p3", Decimal(10), "WEIGHT_EMBED", None, 1), ("000001", "newer", Decimal(99), "FIXED", None, 9)]
    for batch in maps:
        for _ in range(2):
            U.map_batch(spark.createDataFrame(batch, "key string, product string, price decimal(18,2), weigh string, store int, updated int"), path, 4)
    got = {r.id: (r.product, r.quantity, r.value, r.needs_mapping) for r in spark.read.parquet(path).collect()}
    assert len(got) == 13 and got[50] == (None, None, None, False) and got[0] == (None, None, None, True)
    assert got[1] == ("own", 2.2, 11.0, False) and got[5][0] == "own" and got[3] == ("p3", 1.234, 12.34, False) and got[7] == (None, None, None, True)
    assert spark.read.parquet(path).where(F.col("product") == "newer").count() == 0
