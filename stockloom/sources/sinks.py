"""Sinks: months as partitions, checked copies, append-only logs, messages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/sink-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that several readers share one computation and a lost executor costs a reread. The files go when the session ends."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_months(df: DataFrame, day: str, path: str) -> DataFrame:
    """df written as one partition a month, a file each, and read back; null days go to the default partition."""
    df.withColumn("month", F.date_format(day, "yyyy-MM")).repartition("month").write.partitionBy("month").mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def archived(months: DataFrame, today: str, years: int = 5) -> DataFrame:
    """The partitions whose month began more than so many years ago, with their rows."""
    old = F.to_date(F.concat(F.col("month").cast("string"), F.lit("-01"))) < F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -12 * years)
    return months.where(old).groupBy("month").agg(F.count("*").alias("n"))


def migrated(df: DataFrame, path: str) -> DataFrame:
    """df copied to path and read back; raises where the numbers of rows differ."""
    df.write.mode("overwrite").parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    if (a := df.count()) != (b := copy.count()):
        raise ValueError(f"{b} rows were copied of {a}")
    return copy


def appended(events: DataFrame, path: str) -> DataFrame:
    """The log at path with these events behind it."""
    events.write.mode("append").parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


def rewritten(rows: DataFrame, column: str, pattern: str, plain: str, more: dict[str, str]) -> DataFrame:
    """Rows whose text has the pattern with it replaced, and keys added to their metadata map."""
    hit = F.col(column).rlike(pattern)
    added = F.create_map(*(F.lit(x) for kv in more.items() for x in kv))
    kept = F.map_filter("meta", lambda k, _: ~k.isin(*more))
    return rows.withColumn("meta", F.when(hit, F.map_concat(kept, added)).otherwise(F.col("meta"))).withColumn(column, F.regexp_replace(column, pattern, plain))


def merged_keeping(old: DataFrame, new: DataFrame, key: str, flag: str, columns: list[str]) -> DataFrame:
    """New rows over old ones by key; the user's flag stays as it was."""
    o = old.select(key, F.col(flag).alias("_flag"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = new.join(o, key, "full")
    return both.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns), F.coalesce("_flag", flag, F.lit(False)).alias(flag))


def due_messages(subscriptions: DataFrame, sent: DataFrame, day: str, text: Column) -> DataFrame:
    """A message for each subscription that hasn't had one on the day."""
    had = sent.where(F.col("day") == F.lit(day).cast("date")).select("subscription").distinct()
    return subscriptions.join(had, "subscription", "left_anti").select("subscription", text.alias("text"))
