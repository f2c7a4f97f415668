"""Queries of entity resolution, document checks, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators import resolution as R
from stockloom.operators import stock as S
from stockloom.sources.adapters import barcodes, cards, invoices, movements, read, sales

from .registry import query

RULES = "rules AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS supplier, p_name AS key, p_type AS target, p_partkey % 200 AS score, 80 + p_size % 20 AS confidence, p_size % 5 AS success, p_partkey AS seen FROM part)"


def rules(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("supplier"), F.col("p_name").alias("key"), F.col("p_type").alias("target"), (F.col("p_partkey") % 200).alias("score"), (80 + F.col("p_size") % 20).alias("confidence"), (F.col("p_size") % 5).alias("success"), F.col("p_partkey").alias("seen"))


@query(f"WITH {RULES} SELECT supplier, key, target, score, confidence, success FROM (SELECT *, row_number() OVER (PARTITION BY supplier, key ORDER BY score DESC, target, confidence DESC, success DESC) AS k FROM rules WHERE confidence >= 90 AND success >= 1) WHERE k = 1")
def er_merge_rules(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_rules(rules(spark, d)).drop("seen")


@query(f"WITH {RULES} SELECT key, count(DISTINCT target) AS targets, count(DISTINCT supplier) AS suppliers FROM rules GROUP BY 1 HAVING count(DISTINCT target) > 1")
def er_rule_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_conflicts(rules(spark, d))


@query(f"WITH {RULES} SELECT key, any_value(target) AS target FROM (SELECT left(key, 4) || seen % 40 AS key, left(target, 2) AS target FROM rules) GROUP BY 1 HAVING count(DISTINCT target) = 1")
def set_conflict_removal(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).select(F.concat(F.substring("key", 1, 4), F.col("seen") % 40).alias("key"), F.substring("target", 1, 2).alias("target"))
    return R.without_conflicts(r).select("key", "target")


@query(f"WITH {RULES} SELECT key, max(confidence) AS confidence, count(*) AS uses, arg_max(target, (seen, target)) AS target FROM rules GROUP BY 1")
def er_memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    return R.memory_upsert(rules(spark, d))


@query(f"WITH {RULES} SELECT key, target, count(*) AS confirmations, count(DISTINCT supplier) AS suppliers FROM rules GROUP BY 1, 2 HAVING bool_or(supplier IS NULL) OR count(*) >= 3 OR count(DISTINCT supplier) >= 2")
def pst_learn_confirm(spark: SparkSession, d: str) -> DataFrame:
    return R.promotions(rules(spark, d))


@query("SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.9 AND p_size / 50.0 - (p_partkey % 10) / 10.0 >= 0.1 THEN 'AUTO' WHEN p_size / 50.0 >= 0.75 THEN 'SUGGESTED' ELSE 'NONE' END AS decision FROM part")
def er_mapping_decision(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", R.mapping_decision(F.col("p_size").cast("decimal(10,1)") / 50, (F.col("p_partkey") % 10).cast("decimal(10,1)") / 10).alias("decision"))


@query("SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' ELSE 'E' END AS grade FROM part")
def doc_grade(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", S.grade(F.col("p_size") * 2).alias("grade"))


@query("SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part, abs(l_quantity * 1000 - l_extendedprice) <= 1 AS ok FROM lineitem")
def doc_line_arith(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.abs(F.col("l_quantity") * 1000 - F.col("l_extendedprice")) <= 1).alias("ok"))


@query("SELECT doc, total::DOUBLE AS total FROM invoices ORDER BY created_at DESC, doc LIMIT 50")
def src_list_table(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).orderBy(F.desc("created_at"), "doc").limit(50).select("doc", F.col("total").cast("double").alias("total"))


@query("SELECT card, count(*) AS n, CAST(sum(amount - fee) AS DOUBLE) AS net FROM (SELECT *, row_number() OVER (PARTITION BY card, sale_date, amount ORDER BY id DESC) AS k FROM cards) WHERE k = 1 GROUP BY 1")
def src_card_collect_a(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.operators.ledger import amount, latest_per_key

    return latest_per_key(cards(spark, d), ["card", "sale_date", "amount"], [F.desc("id")]).groupBy("card").agg(F.count("*").alias("n"), amount(F.col("amount") - F.col("fee")).alias("net"))


@query("SELECT code, 'unmapped' AS origin FROM (SELECT code FROM sales WHERE needs_mapping) UNION SELECT key, 'mapped' FROM barcodes")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = sales(spark, d).where("needs_mapping").select("code", F.lit("unmapped").alias("origin"))
    return a.unionByName(barcodes(spark, d).select(F.col("key").alias("code"), F.lit("mapped").alias("origin"))).distinct()


@query("SELECT s.code, count(*) AS n FROM sales s WHERE NOT EXISTS (SELECT 1 FROM barcodes b WHERE b.key = s.code AND b.weigh <> 'FIXED') GROUP BY 1")
def snk_insert_not_exists(spark: SparkSession, d: str) -> DataFrame:
    known = barcodes(spark, d).where("weigh <> 'FIXED'").select(F.col("key").alias("code"))
    return sales(spark, d).join(known, "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT store, code, n FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY n DESC, code) AS k FROM (SELECT store, code, count(*) AS n FROM sales GROUP BY 1, 2)) WHERE k <= 5")
def lim_topk(spark: SparkSession, d: str) -> DataFrame:
    c = sales(spark, d).groupBy("store", "code").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("n"), "code"))).where("k <= 5").drop("k")


@query("SELECT store, sale_date, CAST(amount AS DOUBLE) AS amount, CAST(coalesce(before, 0) AS DOUBLE) AS before FROM (SELECT store, sale_date, a AS amount, lag(a) OVER (PARTITION BY store ORDER BY sale_date) AS before FROM (SELECT store, sale_date, sum(amount) AS a FROM sales WHERE NOT is_cancelled GROUP BY 1, 2))")
def win_previous_template(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d).where("NOT is_cancelled").groupBy("store", "sale_date").agg(F.sum("amount").cast("double").alias("amount"))
    return s.withColumn("before", F.coalesce(F.lag("amount").over(Window.partitionBy("store").orderBy("sale_date")), F.lit(0.0)))
