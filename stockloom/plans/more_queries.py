"""Further queries: joins, windows, counts, projections, sinks and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators import posting as P
from stockloom.operators.ledger import amount, latest_per_key, seen_before, signed
from stockloom.sources.adapters import barcodes, cards, invoices, movements, read, sales

from .registry import query


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def jn_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).agg(F.count("*").alias("n"))


@query("SELECT n_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(DISTINCT c_custkey) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def jn_left_join_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Both sides are counted before the join, so their rows don't multiply."""
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    return read(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT b.key, b.product FROM barcodes b WHERE EXISTS (SELECT 1 FROM movements m WHERE m.product = b.product AND is_active GROUP BY m.product HAVING sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) > 0)")
def jn_stock_semijoin(spark: SparkSession, d: str) -> DataFrame:
    stock = movements(spark, d).where("is_active").groupBy("product").agg(F.sum(signed("qty")).alias("q")).where("q > 0")
    return barcodes(spark, d).join(stock, "product", "left_semi").select("key", "product")


@query("SELECT id, card, CAST(round(amount * coalesce(r, 0.02), 2) AS DOUBLE) AS fee FROM cards LEFT JOIN (VALUES ('BUILDING', 0.015), ('MACHINERY', 0.01)) v(c, r) ON c = card")
def jn_rule_default_override(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("BUILDING", "0.015"), ("MACHINERY", "0.010")], "card string, rate string").select("card", F.col("rate").cast("decimal(5,3)").alias("rate"))
    c = cards(spark, d).join(F.broadcast(rules), "card", "left")
    return c.select("id", "card", F.round(F.col("amount") * F.coalesce("rate", F.lit("0.020").cast("decimal(5,3)")), 2).cast("double").alias("fee"))


@query("SELECT w.id, max(p.sold_at) AS pos_at FROM sales w JOIN sales p ON p.source = 'local-agent' AND p.code = w.code AND p.sold_at <= w.sold_at AND epoch_us(w.sold_at) - epoch_us(p.sold_at) <= 7200000000 WHERE w.source = 'web-scan' GROUP BY 1")
def jn_recent_exists(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    return seen_before(s.where("source = 'web-scan'"), s.where("source = 'local-agent'"))


@query("SELECT a.r_name AS parent, n_name AS child FROM nation JOIN region a ON a.r_regionkey = n_regionkey")
def jn_self_parent(spark: SparkSession, d: str) -> DataFrame:
    tree = read(spark, d, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent"))
    tree = tree.unionByName(read(spark, d, "nation").select((F.col("n_nationkey") + 1000).alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")))
    up = tree.select(F.col("code").alias("parent"), F.col("name").alias("up"))
    return tree.join(up, "parent").select(F.col("up").alias("parent"), F.col("name").alias("child"))


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM orders) AS orders")
def agg_learning_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, n: read(spark, d, t).agg(F.count("*").alias(n))
    return one("customer", "customers").crossJoin(one("supplier", "suppliers")).crossJoin(one("part", "parts")).crossJoin(one("orders", "orders"))


@query("SELECT source, count(*) AS n, count(*) FILTER (is_cancelled) AS failed, round(100 * count(*) FILTER (NOT is_cancelled) / count(*), 1) AS success FROM sales WHERE sold_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR AND sold_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def agg_operation_24h(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    s = sales(spark, d).where((F.col("sold_at") > end - F.expr("INTERVAL 24 HOURS")) & (F.col("sold_at") <= end))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_cancelled").alias("failed"), F.round(100 * F.count_if(~F.col("is_cancelled")) / F.count("*"), 1).alias("success"))


@query("SELECT store, count(*) AS n, count(*) FILTER (changed) AS changes FROM (SELECT store, channel <> lag(channel) OVER (PARTITION BY store ORDER BY sold_at, id) AS changed FROM sales) GROUP BY 1")
def agg_provider_health(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("store").orderBy("sold_at", "id")
    return sales(spark, d).withColumn("changed", F.col("channel") != F.lag("channel").over(w)).groupBy("store").agg(F.count("*").alias("n"), F.count_if("changed").alias("changes"))


@query("SELECT product, CASE WHEN count(*) FILTER (weigh = 'WEIGHT_EMBED') > count(*) FILTER (weigh = 'PRICE_EMBED') THEN 'WEIGHT_EMBED' ELSE 'PRICE_EMBED' END AS weigh FROM barcodes GROUP BY 1")
def agg_embed_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = lambda k: F.count_if(F.col("weigh") == k)
    return barcodes(spark, d).groupBy("product").agg(F.when(votes("WEIGHT_EMBED") > votes("PRICE_EMBED"), "WEIGHT_EMBED").otherwise("PRICE_EMBED").alias("weigh"))


@query("SELECT store, count(*) AS n, 1.96 * sqrt(0.25 / count(*)) * 100 AS margin FROM sales GROUP BY 1")
def agg_margin_of_error(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).groupBy("store").agg(F.count("*").alias("n")).withColumn("margin", 1.96 * F.sqrt(0.25 / F.col("n")) * 100)


@query("SELECT channel, t AS target, coalesce(n, 0) AS actual, coalesce(n, 0) >= t AS met FROM (VALUES ('STORE', 1000), ('BAEMIN', 100000), ('NONE', 1)) v(channel, t) LEFT JOIN (SELECT channel AS c, count(*) AS n FROM sales GROUP BY 1) ON c = channel")
def agg_stratum_quota(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("STORE", 1000), ("BAEMIN", 100000), ("NONE", 1)], "channel string, target int")
    have = sales(spark, d).groupBy("channel").agg(F.count("*").alias("actual"))
    return want.join(have, "channel", "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("met", F.col("actual") >= F.col("target"))


@query("SELECT company, sale_date, count(*) AS n, count(DISTINCT store) AS stores FROM sales GROUP BY 1, 2")
def agg_tenant_usage(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).groupBy("company", "sale_date").agg(F.count("*").alias("n"), F.countDistinct("store").alias("stores"))


@query("SELECT doc, count(*) AS n, count(DISTINCT line) = count(*) AND max(line) = count(*) AND min(line) = 1 AS contiguous FROM movements GROUP BY 1")
def win_row_contiguity(spark: SparkSession, d: str) -> DataFrame:
    g = movements(spark, d).groupBy("doc").agg(F.count("*").alias("n"), F.countDistinct("line").alias("u"), F.max("line").alias("hi"), F.min("line").alias("lo"))
    return g.select("doc", "n", ((F.col("u") == F.col("n")) & (F.col("hi") == F.col("n")) & (F.col("lo") == 1)).alias("contiguous"))


@query("SELECT store, best, best - second AS margin FROM (SELECT store, n AS best, lead(n) OVER w AS second, row_number() OVER w AS k FROM (SELECT store, channel, count(*) AS n FROM sales GROUP BY 1, 2) WINDOW w AS (PARTITION BY store ORDER BY n DESC, channel)) WHERE k = 1")
def win_margin_top2(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("store").orderBy(F.desc("n"), "channel")
    c = sales(spark, d).groupBy("store", "channel").agg(F.count("*").alias("n"))
    return c.withColumn("second", F.lead("n").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1").select("store", F.col("n").alias("best"), (F.col("n") - F.col("second")).alias("margin"))


@query("SELECT product, origin, supplier FROM (SELECT product, origin, supplier, row_number() OVER (PARTITION BY product ORDER BY amount DESC, doc, line, supplier, origin) AS k FROM movements) WHERE k = 1")
def win_dedupe_best(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(movements(spark, d, supplier=True), ["product"], [F.desc("amount"), F.asc("doc"), F.asc("line"), F.asc("supplier"), F.asc("origin")]).select("product", "origin", "supplier")


@query("SELECT doc, line, supplier, qty::DOUBLE AS qty FROM movements WHERE is_active ORDER BY qty DESC, supplier, doc DESC, line, amount LIMIT 40")
def srt_multi_key(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d, supplier=True).where("is_active").orderBy(F.desc("qty"), "supplier", F.desc("doc"), "line", "amount").limit(40).select("doc", "line", "supplier", F.col("qty").cast("double").alias("qty"))


@query("SELECT doc, invoice_date FROM invoices ORDER BY invoice_date DESC NULLS LAST, doc LIMIT 40")
def srt_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).orderBy(F.desc_nulls_last("invoice_date"), "doc").limit(40).select("doc", "invoice_date")


@query("SELECT id, store, coalesce(company, 0) AS company, CASE WHEN is_cancelled THEN 'CANCELLED' WHEN needs_mapping THEN 'REVIEW' ELSE 'POSTED' END AS status FROM sales")
def prj_status_bucket(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).select("id", "store", F.coalesce("company", F.lit(0)).alias("company"), F.when(F.col("is_cancelled"), "CANCELLED").when(F.col("needs_mapping"), "REVIEW").otherwise("POSTED").alias("status"))


@query("SELECT id, amount::DOUBLE AS amount FROM sales WHERE NOT coalesce(is_cancelled, false)")
def flt_active_notcancelled(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).where(~F.coalesce("is_cancelled", F.lit(False))).select("id", F.col("amount").cast("double").alias("amount"))


@query("SELECT key, store FROM barcodes WHERE store IS NOT DISTINCT FROM NULL OR store = 5")
def flt_null_safe_store(spark: SparkSession, d: str) -> DataFrame:
    return barcodes(spark, d).where(F.col("store").eqNullSafe(F.lit(None)) | (F.col("store") == 5)).select("key", "store")


@query("SELECT c_custkey, phone, regexp_full_match(phone, '01[016789][0-9]{7,8}') AS valid FROM (SELECT c_custkey, regexp_replace('010-' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') || CASE WHEN c_custkey % 7 = 0 THEN '99' ELSE '' END, '[^0-9]', '', 'g') AS phone FROM customer)")
def flt_pii_phone(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("010-"), F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0"), F.when(F.col("c_custkey") % 7 == 0, "99").otherwise(""))
    c = read(spark, d, "customer").select("c_custkey", F.regexp_replace(raw, "[^0-9]", "").alias("phone"))
    return c.withColumn("valid", F.col("phone").rlike("^01[016789][0-9]{7,8}$"))


@query("SELECT key, product, CAST(greatest(price, coalesce(m, 0)) AS DOUBLE) AS price FROM barcodes LEFT JOIN (SELECT p_name, max(CAST(round(p_retailprice, 2) AS DECIMAL(18,2))) AS m FROM part WHERE p_size > 40 GROUP BY 1) ON p_name = product")
def snk_update_from(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "part").where("p_size > 40").groupBy(F.col("p_name").alias("product")).agg(F.max(F.round("p_retailprice", 2).cast("decimal(18,2)")).alias("m"))
    return barcodes(spark, d).join(top, "product", "left").select("key", "product", F.greatest("price", "m").cast("double").alias("price"))


@query("SELECT doc, coalesce(invoice_date, o, DATE '1970-01-01') AS day FROM invoices LEFT JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders WHERE o_orderkey % 3 > 0) ON o_orderkey = doc")
def snk_backfill_from_parent(spark: SparkSession, d: str) -> DataFrame:
    parent = read(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("o"))
    return invoices(spark, d).join(parent, "doc", "left").select("doc", F.coalesce("invoice_date", "o", F.lit("1970-01-01").cast("date")).alias("day"))


@query("""SELECT id, code, product, CAST(CASE WHEN weigh = 'WEIGHT_EMBED' THEN round(e * 0.001, 3) WHEN price > 0 THEN round(amount / price, 3) END AS DOUBLE) AS quantity, CAST(CASE WHEN weigh = 'WEIGHT_EMBED' THEN round(e * price * 0.001, 2) ELSE amount END AS DOUBLE) AS value
 FROM (SELECT s.*, coalesce(a.product, b.product) AS product, coalesce(a.price, b.price) AS price, coalesce(a.weigh, b.weigh) AS weigh, CAST(substr(barcode, 8, 5) AS INTEGER) AS e FROM sales s LEFT JOIN mapped a ON a.key = s.code AND a.store = s.store LEFT JOIN mapped b ON b.key = s.code AND b.store IS NULL WHERE needs_mapping AND NOT is_cancelled) WHERE product IS NOT NULL""")
def pst_apply_mapping(spark: SparkSession, d: str) -> DataFrame:
    return P.apply_mapping(sales(spark, d).where("needs_mapping AND NOT is_cancelled"), barcodes(spark, d))


@query("SELECT code, count(*) FILTER (is_cancelled OR id % 10 = 3) AS cancelled, count(*) FILTER (NOT is_cancelled AND id % 10 = 3) AS restored FROM sales GROUP BY 1")
def pst_sale_cancel(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    after, back = P.cancel(s, s.where("id % 10 = 3").select("id"))
    a = after.groupBy("code").agg(F.count_if("is_cancelled").alias("cancelled"))
    return a.join(back.groupBy("code").agg(F.count("*").alias("restored")), "code", "left").withColumn("restored", F.coalesce("restored", F.lit(0)))


@query("SELECT store, max(sold_at) AS sold_at, arg_max(v, sold_at) FILTER (v IS NOT NULL) AS v FROM (SELECT *, CASE WHEN id % 3 = 0 THEN id END AS v FROM sales) GROUP BY 1")
def pst_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return P.heartbeats(sales(spark, d).withColumn("v", F.when(F.col("id") % 3 == 0, F.col("id"))), ["store"], "sold_at", ["v"])


@query("""SELECT brand, k, status, CAST(samples AS BIGINT) AS samples, round(greatest(0.78, least(0.96, (44 + o) / (50 + i))), 6)::DOUBLE AS rate FROM (SELECT *, sum(CASE WHEN status IN ('ACCEPTED', 'WARNING') THEN 1 ELSE 0 END) OVER w AS samples,
 sum(CASE WHEN status IN ('ACCEPTED', 'WARNING') THEN out ELSE 0 END) OVER w AS o, sum(CASE WHEN status IN ('ACCEPTED', 'WARNING') THEN inp ELSE 0 END) OVER w AS i FROM (SELECT *, CASE WHEN r <= 0.02 THEN 'ACCEPTED' WHEN r <= 0.05 THEN 'WARNING' WHEN r <= 0.1 THEN 'REVIEW' ELSE 'EXCLUDED' END AS status FROM
 (SELECT p_brand AS brand, p_partkey AS k, p_size::DOUBLE AS inp, p_size::DOUBLE * 0.875 AS out, abs(p_size - p_size::DOUBLE * 0.875 - 1) / p_size AS r FROM part)) WINDOW w AS (PARTITION BY brand ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")  # fmt: skip
def pst_yield_observe(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    p = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), size.alias("input"), (size * 0.875).alias("output"), F.lit(0.0).alias("byproduct"), F.lit(1.0).alias("loss"))
    return P.yield_observations(p, ["brand"], ["k"], "TRIM_STANDARD").select("brand", "k", "status", "samples", "rate")


@query("SELECT doc, k AS page_line, line FROM (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY line) AS k FROM (SELECT DISTINCT doc, line FROM movements))")
def arr_flatten_pages(spark: SparkSession, d: str) -> DataFrame:
    g = movements(spark, d).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return g.select("doc", F.posexplode("lines").alias("p", "line")).select("doc", (F.col("p") + 1).cast("long").alias("page_line"), "line")


@query("SELECT code, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales WHERE needs_mapping AND NOT is_cancelled GROUP BY 1")
def an_plu_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).where("needs_mapping AND NOT is_cancelled").groupBy("code").agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


@query("SELECT id, sale_date FROM (SELECT id, sale_date, amount, avg(CAST(amount AS DOUBLE)) OVER (PARTITION BY store) AS m FROM sales) WHERE amount > 2 * m ORDER BY id LIMIT 1")
def an_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """The first sale of more than twice its store's mean."""
    s = sales(spark, d)
    m = s.groupBy("store").agg(F.avg(F.col("amount").cast("double")).alias("m"))
    return s.join(m, "store").where("amount > 2 * m").orderBy("id").limit(1).select("id", "sale_date")
