"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import scalars as S
from stockloom.sources.adapters import read, sales

from .registry import query


@query("SELECT id, CASE WHEN regexp_full_match(barcode, '2[0-9]{12}') THEN substr(barcode, 2, 6) END AS item, CASE WHEN regexp_full_match(barcode, '2[0-9]{12}') THEN CAST(substr(barcode, 8, 5) AS BIGINT) END AS embedded FROM sales")
def bc_parse(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).select("id", S.item_key(F.col("barcode")).alias("item"), S.embedded_value(F.col("barcode")).alias("embedded"))


@query("SELECT id, (list_sum(list_transform(range(1, 14), lambda i: CAST(substr(barcode, i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) = 0 AS valid FROM sales")
def bc_ean13(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).select("id", S.ean13_valid(F.col("barcode")).alias("valid"))


@query("SELECT p_partkey, CAST(p_size % 10 AS VARCHAR) || CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE CAST(p_partkey AS VARCHAR) END AS key FROM part")
def bc_key_for(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", S.plu_key((F.col("p_size") % 10).cast("string"), F.col("p_partkey").cast("string")).alias("key"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice * 10 WHEN 1 THEN round(p_retailprice / 0.6, 2) ELSE p_retailprice END AS price FROM part")
def bc_basis_to_kg(spark: SparkSession, d: str) -> DataFrame:
    basis = F.when(F.col("p_size") % 3 == 0, "100g").when(F.col("p_size") % 3 == 1, "600g").otherwise("1kg")
    return read(spark, d, "part").select("p_partkey", S.per_kilogram(F.col("p_retailprice"), basis).alias("price"))


@query("""SELECT arg_max(p, (n, -length(p))) AS prefix, max(n) AS n FROM (SELECT p, count(*) FILTER (starts_with(code, p)) AS n FROM sales, (SELECT unnest(['', '0', '00', '1', '2', '01']) AS p) GROUP BY p)""")
def bc_detect_rule(spark: SparkSession, d: str) -> DataFrame:
    """The prefix that most observed codes have; the shorter one on ties."""
    prefixes = [r for r in ("", "0", "00", "1", "2", "01")]
    counts = sales(spark, d).agg(F.array(*(F.struct(F.count_if(F.startswith("code", F.lit(p))).alias("n"), F.lit(-len(p)).alias("short"), F.lit(p).alias("p")) for p in prefixes)).alias("c"))
    return counts.select(F.array_max("c").alias("m")).select(F.col("m.p").alias("prefix"), F.col("m.n").alias("n"))


@query("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events")
def dt_business_date(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.business_date(F.col("ts").cast("timestamp")).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def dt_trunc_month(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.to_date(F.trunc("o_orderdate", "month")).alias("month"))


@query("SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def dt_week_start(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))


@query("SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1996-01-01', CAST(l_shipdate AS DATE)) AS days FROM lineitem")
def dt_days_between(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.datediff(F.to_date("l_shipdate"), F.lit("1996-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT event_id, CASE WHEN hour(ts) < 11 THEN 'morning' WHEN hour(ts) < 15 THEN 'lunch' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM events")
def dt_day_part(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.day_part(F.col("ts")).alias("part"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season FROM orders")
def dt_season(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", S.season(F.col("o_orderdate")).alias("season"))


@query("SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS up, CAST(floor(-value + 0.5) AS BIGINT) AS down FROM events")
def mth_round_money(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.js_round(F.col("value")).alias("up"), S.js_round(-F.col("value")).alias("down"))


@query("SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, coalesce(c_acctbal, 0))) AS v FROM customer")
def mth_clamp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", S.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size >= 49 THEN 1.88 WHEN p_size >= 48 THEN 1.65 WHEN p_size >= 45 THEN 1.28 ELSE 0.84 END::DOUBLE AS z FROM part")
def mth_zscore_step(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("p_size") >= 49, 0.99).when(F.col("p_size") >= 48, 0.95).when(F.col("p_size") >= 45, 0.9).otherwise(0.5)
    return read(spark, d, "part").select("p_partkey", S.z_score(level).alias("z"))


@query("SELECT l_returnflag AS flag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def mth_median(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.median("l_quantity").alias("median"))


@query("SELECT p_partkey, least(15.0::DOUBLE, log2(p_size + 1) * 4) + 50 AS impact FROM part")
def mth_learning_impact(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", (F.least(F.lit(15.0), F.log2(F.col("p_size") + 1.0) * 4) + 50).alias("impact"))


@query("SELECT DISTINCT p_name, lower(regexp_replace(p_name, '[\\s[:punct:]]+', '', 'g')) AS k FROM part")
def str_sql_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_name").distinct().withColumn("k", S.normalise(F.col("p_name")))


@query("SELECT DISTINCT p_type, list_reduce(list_prepend(CAST(7 AS BIGINT), list_transform(string_split(p_type, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part")
def str_hash31(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_type").distinct().withColumn("h", S.hash31(F.col("p_type")))


@query("SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.-]+', '', 'g') AS DOUBLE) AS n FROM events")
def str_csv_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.number(F.col("props")).alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_type) > 10 THEN substr(p_type, 1, 9) || '…' ELSE p_type END AS short FROM part")
def str_clip(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", S.clip(F.col("p_type"), 10).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, substr(md5(c_name), 1, 12) AS code, sha256(c_name) AS key FROM customer")
def hash_md5_sha256(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.substring(F.md5("c_name"), 1, 12).alias("code"), F.sha2("c_name", 256).alias("key"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'frozen' WHEN 'MACHINERY' THEN 'chilled' ELSE 'fresh' END AS storage FROM customer")
def prj_storage_label(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "frozen").when(F.col("c_mktsegment") == "MACHINERY", "chilled").otherwise("fresh").alias("storage"))


@query("SELECT p_partkey, 'brand:' || coalesce(p_brand, '-') || '|type:' || coalesce(p_type, '-') || '|size:' || coalesce(CAST(p_size AS VARCHAR), '-') AS signature FROM part")
def prj_attribute_signature(spark: SparkSession, d: str) -> DataFrame:
    fields = [("brand", "p_brand"), ("type", "p_type"), ("size", "p_size")]
    return read(spark, d, "part").select("p_partkey", F.concat_ws("|", *(F.concat(F.lit(f"{k}:"), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for k, c in fields)).alias("signature"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(replace(p_name, ' ', '')), 'red') AND p_size > 10")
def flt_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.contains(F.lower(F.regexp_replace("p_name", r"\s+", "")), F.lit("red")) & (F.col("p_size") > 10)).select("p_partkey", "p_name")
