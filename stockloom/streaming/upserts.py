"""Sinks for streams of changes: tables of buckets, of which a batch rewrites only those that it touches. A batch that comes twice changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.ledger import latest_per_key, upsert
from stockloom.operators.posting import apply_mapping
from stockloom.sources.sinks import written

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def held(spark: SparkSession, path: str, schema, touched: list[int]) -> DataFrame:
    """The rows of these buckets; none where there is no table yet. Only their files are read."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replaced(rows: DataFrame, path: str) -> None:
    """Puts rows in place of their buckets' rows. They are written aside first, since they come from the files that they replace; then only the buckets that they have are swapped."""
    written(rows).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def touched_by(rows: DataFrame) -> list[int]:
    """The buckets of rows: as many numbers as a table has buckets at most."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def upsert_batch(batch: DataFrame, path: str, keys: list[str], version: str, buckets: int = BUCKETS) -> None:
    """batch over the table at path: of each key the row of the highest version stays. A crash between two buckets is mended by the batch's replay."""
    new = latest_per_key(batch, keys, [F.desc(version)]).withColumn("bucket", bucket_of(keys, buckets))
    if touched := touched_by(new):
        old = held(batch.sparkSession, path, new.schema, touched).select(new.columns)
        replaced(upsert(old, new, keys, version), path)


def map_batch(batch: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Mappings that came late over the sales at path (bucketed by code): pending sales of their codes get product, quantity and value, and pend no more."""
    new = written(batch.withColumn("bucket", bucket_of(["key"], buckets)))
    touched = touched_by(new)
    if not touched:
        return
    rows = batch.sparkSession.read.parquet(path).where(F.col("bucket").isin(touched))
    priced = apply_mapping(rows.where("needs_mapping AND NOT is_cancelled"), new.drop("bucket")).select("id", F.col("product").alias("p"), F.col("quantity").alias("q"), F.col("value").alias("v"))
    x = rows.join(priced, "id", "left").withColumn("needs_mapping", F.col("needs_mapping") & F.col("p").isNull())
    for column, value in (("product", "p"), ("quantity", "q"), ("value", "v")):
        x = x.withColumn(column, F.coalesce(value, column))
    replaced(x.select(rows.columns), path)


def bucketed_sales(sales: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes sales (id, code, ...) as map_batch() takes them: bucketed by code, with product, quantity and value still open."""
    none = {"product": "string", "quantity": "double", "value": "double"}
    rows = sales.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def sink(stream: DataFrame, apply, checkpoint: str):
    """Starts a stream that gives each batch to apply(batch), all that is there now, from its checkpoint on."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
