"""Posting operators over event tables: mappings that come late, cancellations, heartbeats, yield observations, status machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import override_lookup
from .stock import YIELDS

#: The legal transitions of a document's status.
TRANSITIONS = (("QUEUED", "PROCESSING"), ("PROCESSING", "REVIEW"), ("PROCESSING", "SUCCESS"), ("PROCESSING", "RETRY"), ("RETRY", "PROCESSING"), ("REVIEW", "SUCCESS"), ("REVIEW", "POSTED"), ("SUCCESS", "POSTED"))


def apply_mapping(pending: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pending sales whose code is now mapped, priced again: WEIGHT_EMBED overwrites the amount, others keep it and derive the quantity."""
    held = override_lookup(pending, mapping).where("map IS NOT NULL").select("id", "code", "barcode", "amount", F.col("map.product").alias("product"), F.col("map.price").alias("price"), F.col("map.weigh").alias("weigh"))
    grams = F.substring("barcode", 8, 5).cast("decimal(18,3)")
    heavy = F.col("weigh") == "WEIGHT_EMBED"
    quantity = F.when(heavy, F.round(grams / 1000, 3)).when(F.col("price") > 0, F.round(F.col("amount") / F.col("price"), 3))
    value = F.when(heavy, F.round(grams / 1000 * F.col("price"), 2)).otherwise(F.col("amount"))
    return held.select("id", "code", "product", quantity.cast("double").alias("quantity"), value.cast("double").alias("value"))


def cancel(sales: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales with the requested ones cancelled, and the stock rows that put their goods back; what is cancelled already stays as it is."""
    asked = requests.select("id").distinct().withColumn("asked", F.lit(True))
    s = sales.join(asked, "id", "left").withColumn("fresh", F.coalesce(F.col("asked") & ~F.col("is_cancelled"), F.lit(False)))
    back = s.where("fresh").select("id", "company", "store", "code", F.lit("IN").alias("kind"), "amount")
    return s.withColumn("is_cancelled", F.col("is_cancelled") | F.col("fresh")).drop("asked", "fresh"), back


def heartbeats(log: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """The latest state of each agent; a null in a later report keeps the value before."""
    kept = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields]
    return log.groupBy(*keys).agg(F.max(at).alias(at), *kept)


def health(at: Column, now: Column, minutes: int = 15) -> Column:
    return F.when(at.isNull(), "NEVER").when(F.unix_micros(now) - F.unix_micros(at) > minutes * 60_000_000, "OFFLINE").otherwise("ONLINE")


def yield_observations(observed: DataFrame, keys: list[str], order: list[str], prior: str) -> DataFrame:
    """Each observation's status by how well its masses balance, and the learned rate after it; only those within a twentieth teach."""
    rate, low, high, kg = YIELDS[prior]
    residual = F.abs(F.col("input") - F.col("output") - F.col("byproduct") - F.col("loss")) / F.col("input")
    status = F.when(residual <= 0.02, "ACCEPTED").when(residual <= 0.05, "WARNING").when(residual <= 0.10, "REVIEW").otherwise("EXCLUDED")
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    o = observed.withColumn("status", status).withColumn("teaches", F.col("status").isin("ACCEPTED", "WARNING"))
    so_far = lambda c: F.sum(F.when(F.col("teaches"), F.col(c)).otherwise(0)).over(upto)
    n = F.sum(F.col("teaches").cast("int")).over(upto)
    learned = F.greatest(F.lit(low), F.least(F.lit(high), (rate * kg + so_far("output")) / (kg + so_far("input"))))
    return o.withColumn("samples", n).withColumn("rate", F.round(learned, 6)).withColumn("source", F.when(n >= 30, "STORE_LEARNED").when(n > 0, "BLENDED").otherwise("PRIOR")).drop("teaches")


def illegal_transitions(log: DataFrame, key: str, order: list[str], transitions: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """Log rows whose status can't follow the one before; the table of legal steps is small and fixed."""
    spark = log.sparkSession
    steps = F.broadcast(spark.createDataFrame(list(transitions), "before string, status string"))
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("before", F.lag("status").over(w)).where("before IS NOT NULL AND before <> status").join(steps, ["before", "status"], "left_anti")
