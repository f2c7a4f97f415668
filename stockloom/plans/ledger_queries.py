"""Queries over the sales and stock ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators import ledger as L
from stockloom.sources.adapters import barcodes, cards, invoices, movements, read, sales

from .registry import query

DAY, MONTH = "2024-01-20", "2024-01-01"
SOLD = "SELECT company, store, {0} AS bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales {1} GROUP BY 1, 2, 3"
BOUGHT = "SELECT company, store, strftime(coalesce(invoice_date, CAST(created_at AS DATE)), '{0}') AS bucket, count(*) AS n, CAST(sum(total) AS DOUBLE) AS amount FROM invoices WHERE status = 'POSTED' GROUP BY 1, 2, 3"
SIGN = "CASE WHEN kind = 'OUT' THEN -{0} ELSE {0} END"


@query(f"SELECT company, product, origin, CAST(sum({SIGN.format('qty')}) AS DOUBLE) AS qty, CAST(sum({SIGN.format('amount')}) AS DOUBLE) AS amount, count(*) AS n, max(day) AS last_day FROM movements WHERE is_active GROUP BY 1, 2, 3")
def agg_inventory_balance(spark: SparkSession, d: str) -> DataFrame:
    return L.inventory_balance(movements(spark, d))


@query(f"SELECT company, store, product, CAST(sum({SIGN.format('qty')}) AS DOUBLE) AS qty, CAST(sum({SIGN.format('amount')}) AS DOUBLE) AS amount, sum({SIGN.format('qty')}) <= 0 AS low_stock FROM movements WHERE is_active GROUP BY 1, 2, 3")
def agg_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.inventory_summary(movements(spark, d))


@query(SOLD.format("sale_date", "WHERE NOT is_cancelled"))
def agg_daily_sales(spark: SparkSession, d: str) -> DataFrame:
    return L.sales_summary(sales(spark, d), F.col("sale_date"))


@query(SOLD.format("strftime(sale_date, '%Y-%m')", "WHERE NOT is_cancelled"))
def agg_monthly_sales(spark: SparkSession, d: str) -> DataFrame:
    return L.sales_summary(sales(spark, d), F.date_format("sale_date", "yyyy-MM"))


@query(SOLD.format("sale_date", ""))
def agg_backfill(spark: SparkSession, d: str) -> DataFrame:
    return L.sales_summary(sales(spark, d), F.col("sale_date"), cancelled=True)


@query(BOUGHT.format("%Y-%m-%d"))
def agg_daily_purchase(spark: SparkSession, d: str) -> DataFrame:
    return L.purchase_summary(invoices(spark, d), "yyyy-MM-dd")


@query(BOUGHT.format("%Y-%m"))
def agg_monthly_purchase(spark: SparkSession, d: str) -> DataFrame:
    return L.purchase_summary(invoices(spark, d), "yyyy-MM")


@query(f"""SELECT s.*, u.*, c.*, m.*, b.*, DATE '{DAY}' AS day FROM
 (SELECT CAST(coalesce(sum(amount) FILTER (sale_date = DATE '{DAY}'), 0) AS DOUBLE) AS today, CAST(coalesce(sum(amount) FILTER (sale_date = DATE '{DAY}' - 1), 0) AS DOUBLE) AS yesterday,
  CAST(coalesce(sum(amount) FILTER (sale_date = DATE '{DAY}' - 8), 0) AS DOUBLE) AS last_week_same_day, CAST(coalesce(sum(amount) FILTER (sale_date BETWEEN DATE '{MONTH}' AND DATE '{DAY}'), 0) AS DOUBLE) AS month_sales,
  count(*) FILTER (sale_date = DATE '{DAY}') AS today_n FROM sales WHERE NOT is_cancelled) s,
 (SELECT count(*) AS unmapped_codes, CAST(coalesce(sum(n), 0) AS BIGINT) AS unmapped_n, CAST(coalesce(sum(a), 0) AS DOUBLE) AS unmapped_amount, CAST(to_json(coalesce(list(code ORDER BY n DESC, code), [])) AS VARCHAR) AS codes FROM
  (SELECT code, count(*) AS n, sum(amount) AS a FROM sales WHERE needs_mapping AND NOT is_cancelled GROUP BY 1 ORDER BY n DESC, code LIMIT 20)) u,
 (SELECT count(*) AS deposits_n, CAST(coalesce(sum(amount - fee), 0) AS DOUBLE) AS deposits FROM cards WHERE status = 'SCHEDULED' AND deposit_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 6) c,
 (SELECT count(*) AS expiring_n FROM movements WHERE is_active AND expiry BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 3) m,
 (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS month_purchases FROM movements WHERE is_active AND kind = 'IN' AND day BETWEEN DATE '{MONTH}' AND DATE '{DAY}' AND memo IS NULL) b""")  # fmt: skip
def agg_money_brief(spark: SparkSession, d: str) -> DataFrame:
    return L.money_brief(sales(spark, d), movements(spark, d), cards(spark, d), DAY)


@query("SELECT code, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, max(barcode) AS barcode FROM sales WHERE needs_mapping AND NOT is_cancelled GROUP BY 1 ORDER BY n DESC, code LIMIT 20")
def agg_unmapped_codes(spark: SparkSession, d: str) -> DataFrame:
    return L.unmapped_codes(sales(spark, d), 20)


@query("SELECT deposit_date, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM cards WHERE status = 'SCHEDULED' AND deposit_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-07' GROUP BY 1")
def agg_card_deposits(spark: SparkSession, d: str) -> DataFrame:
    return L.card_deposits(cards(spark, d), "1996-03-01")


@query(f"SELECT channel, count(*) FILTER (sale_date = DATE '{DAY}') AS today_n, CAST(coalesce(sum(amount) FILTER (sale_date = DATE '{DAY}'), 0) AS DOUBLE) AS today, count(*) AS month_n, CAST(sum(amount) AS DOUBLE) AS month FROM sales WHERE NOT is_cancelled AND sale_date BETWEEN DATE '{MONTH}' AND DATE '{DAY}' GROUP BY 1")
def agg_channel_sales(spark: SparkSession, d: str) -> DataFrame:
    return L.channel_sales(sales(spark, d), DAY)


KPI = ", ".join(f"count(*) FILTER ({{0}} BETWEEN {b} AND DATE '{{2}}') AS {k}_n, CAST(coalesce(sum({{1}}) FILTER ({{0}} BETWEEN {b} AND DATE '{{2}}'), 0) AS DOUBLE) AS {k}" for k, b in (("month", "date_trunc('month', DATE '{2}')"), ("week", "date_trunc('week', DATE '{2}')"), ("today", "DATE '{2}'")))


@query(f"SELECT {KPI.format('sale_date', 'amount', DAY)} FROM sales WHERE NOT is_cancelled")
def agg_kpi_mwd(spark: SparkSession, d: str) -> DataFrame:
    return L.kpi(L.active(sales(spark, d)), "sale_date", "amount", DAY)


@query(f"SELECT {KPI.format('invoice_date', 'total', '1996-03-20')} FROM invoices WHERE status = 'POSTED'")
def agg_purchase_kpi(spark: SparkSession, d: str) -> DataFrame:
    return L.kpi(invoices(spark, d).where("status = 'POSTED'"), "invoice_date", "total", "1996-03-20")


@query(f"SELECT CAST(date_trunc('week', sale_date) AS DATE) AS week, sale_date AS day, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales WHERE NOT is_cancelled AND date_trunc('month', sale_date) = DATE '{MONTH}' GROUP BY ROLLUP (CAST(date_trunc('week', sale_date) AS DATE), sale_date)")
def agg_calendar(spark: SparkSession, d: str) -> DataFrame:
    return L.calendar(sales(spark, d), MONTH)


@query("SELECT CAST((SELECT sum(amount) FROM sales WHERE NOT is_cancelled) AS DOUBLE) AS raw, CAST(sum(s) AS DOUBLE) AS summary, (SELECT sum(amount) FROM sales WHERE NOT is_cancelled) = sum(s) AS equal FROM (SELECT sum(amount) AS s FROM sales WHERE NOT is_cancelled GROUP BY company, store, sale_date)")
def agg_reconcile(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    return L.reconcile(L.active(s), L.sales_summary(s, F.col("sale_date")))


@query("SELECT supplier, product, count(*) AS n, CAST(round(sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END), 3) AS DOUBLE) AS net FROM movements GROUP BY 1, 2")
def agg_supplier_product_net(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d, supplier=True).groupBy("supplier", "product").agg(F.count("*").alias("n"), F.round(F.sum(L.signed("qty")), 3).cast("double").alias("net"))


@query("SELECT store, product, CAST(sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) AS DOUBLE) AS qty, count(DISTINCT origin) FILTER (amount > 1000) AS origins FROM movements WHERE is_active GROUP BY 1, 2 HAVING sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) > 0")
def agg_stock_having(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d).where("is_active").groupBy("store", "product").agg(L.amount(L.signed("qty")).alias("qty"), F.countDistinct(F.when(F.col("amount") > 1000, F.col("origin"))).alias("origins")).where("qty > 0")


@query("SELECT store, count(DISTINCT code) FILTER (needs_mapping) AS unmapped, count(DISTINCT code) AS codes, CAST(sum(amount) AS DOUBLE) AS amount FROM sales GROUP BY 1")
def agg_count_filter_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).groupBy("store").agg(F.countDistinct(F.when(F.col("needs_mapping"), F.col("code"))).alias("unmapped"), F.countDistinct("code").alias("codes"), L.amount(F.col("amount")).alias("amount"))


@query("SELECT product, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM movements GROUP BY 1")
def agg_array_distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


@query("SELECT doc, line, count(*) AS n FROM movements GROUP BY 1, 2 HAVING count(*) > 1")
def agg_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d).groupBy("doc", "line").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT lower(trim(email)) AS email, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN ' User' || c_custkey % 997 || '@Shop.com' ELSE 'user' || c_custkey || '@shop.com ' END AS email FROM customer) GROUP BY 1 HAVING count(*) > 1")
def agg_dup_emails(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    email = F.when(k % 2 == 0, F.concat(F.lit(" User"), k % 997, F.lit("@Shop.com"))).otherwise(F.concat(F.lit("user"), k, F.lit("@shop.com ")))
    return L.repeated(read(spark, d, "customer").select(email.alias("email")), F.lower(F.trim("email")), "email")


@query("SELECT channel, count(*) AS n FROM sales GROUP BY 1")
def agg_count_by(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).groupBy("channel").agg(F.count("*").alias("n")).orderBy("channel")


@query("SELECT store, arg_min(channel, (-n, channel)) AS top, max(n) AS n FROM (SELECT store, channel, count(*) AS n FROM sales GROUP BY 1, 2) GROUP BY 1")
def agg_top_entry(spark: SparkSession, d: str) -> DataFrame:
    c = sales(spark, d).groupBy("store", "channel").agg(F.count("*").alias("n"))
    return c.groupBy("store").agg(F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("top"), F.max("n").alias("n"))


@query("SELECT product, kind, CAST(sum(qty) AS DOUBLE) AS qty FROM movements WHERE is_active AND day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1, 2")
def flt_date_range_month(spark: SparkSession, d: str) -> DataFrame:
    return movements(spark, d).where("is_active").where(F.col("day").between("1996-01-01", "1996-12-31")).groupBy("product", "kind").agg(L.amount(F.col("qty")).alias("qty"))


@query("SELECT doc, line, product, expiry, date_diff('day', DATE '1998-06-01', expiry) AS days, CASE WHEN expiry < DATE '1998-06-01' THEN 'expired' WHEN expiry <= DATE '1998-06-02' THEN 'danger' ELSE 'warn' END AS bucket FROM movements WHERE expiry <= DATE '1998-06-04'")
def flt_expiry_window(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1998-06-01").cast("date")
    m = movements(spark, d).where(F.col("expiry") <= F.date_add(day, 3)).withColumn("days", F.datediff("expiry", day).cast("long"))
    return m.select("doc", "line", "product", "expiry", "days", F.when(F.col("days") < 0, "expired").when(F.col("days") <= 1, "danger").otherwise("warn").alias("bucket"))


@query("SELECT s.id, coalesce(a.product, b.product) AS product, CAST(coalesce(a.price, b.price) AS DOUBLE) AS price, a.product IS NOT NULL AS own FROM sales s LEFT JOIN mapped a ON a.key = s.code AND a.store = s.store LEFT JOIN mapped b ON b.key = s.code AND b.store IS NULL")
def jn_override_top1(spark: SparkSession, d: str) -> DataFrame:
    b = barcodes(spark, d)
    own = b.where("store IS NOT NULL").select("key", "store").distinct().withColumn("own", F.lit(True))
    out = L.override_lookup(sales(spark, d), b).join(own, (F.col("code") == F.col("key")) & (sales_store() == own["store"]), "left")
    return out.select("id", F.col("map.product").alias("product"), F.col("map.price").cast("double").alias("price"), F.coalesce("own", F.lit(False)).alias("own"))


def sales_store() -> Column:
    return F.pmod(F.col("code").cast("long"), F.lit(10))


@query("""SELECT w.id, w.barcode, min(p.sold_at) AS pos_at, count(*) AS n FROM sales w JOIN sales p ON p.barcode = w.barcode AND p.company = w.company AND p.source = 'local-agent'
 AND abs(epoch_us(w.sold_at) - epoch_us(p.sold_at)) <= 7200000000 WHERE w.source = 'web-scan' GROUP BY 1, 2""")
def jn_lateral_interval(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    return L.recent_duplicates(s.where("source = 'web-scan'"), s.where("source = 'local-agent'"))


@query("SELECT count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales WHERE EXISTS (SELECT 1 FROM barcodes WHERE key = code)")
def jn_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    b = barcodes(spark, d).select(F.col("key").alias("code"))
    return sales(spark, d).join(b, "code", "left_semi").agg(F.count("*").alias("n"), L.amount(F.col("amount")).alias("amount"))


@query("SELECT code, count(*) AS n FROM sales WHERE NOT EXISTS (SELECT 1 FROM barcodes WHERE key = code) GROUP BY 1")
def jn_anti(spark: SparkSession, d: str) -> DataFrame:
    b = barcodes(spark, d).select(F.col("key").alias("code"))
    return sales(spark, d).join(b, "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT s_name AS supplier, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier")
def jn_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"))
    s = read(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_name").alias("supplier"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("SELECT id, txn FROM (SELECT id, txn, row_number() OVER (PARTITION BY company, txn ORDER BY sold_at, id) AS k FROM sales) WHERE k = 1")
def stm_idempotent_txn(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_per_key(sales(spark, d), ["company", "txn"], [F.asc("sold_at"), F.asc("id")]).select("id", "txn")


@query("""SELECT id, company, store, txn, CASE WHEN k > 1 THEN 'DUPLICATE' WHEN v IS NULL THEN 'PENDING' ELSE 'PROCESSED' END AS status, product, CAST(q AS DOUBLE) AS quantity, CAST(v AS DOUBLE) AS value, weigh IS NULL AS needs_mapping FROM (
 SELECT *, CASE weigh WHEN 'WEIGHT_EMBED' THEN round(e / 1000.0, 3) WHEN 'PRICE_EMBED' THEN round(e / price, 3) WHEN 'FIXED' THEN 1 END AS q,
  CASE WHEN weigh = 'WEIGHT_EMBED' THEN round(e * price * 0.001, 2) WHEN weigh = 'PRICE_EMBED' THEN e WHEN weigh = 'FIXED' THEN price WHEN weigh IS NULL THEN e END AS v FROM (
 SELECT s.*, row_number() OVER (PARTITION BY company, txn ORDER BY sold_at, id) AS k, CAST(substr(barcode, 8, 5) AS INTEGER) AS e, coalesce(a.product, b.product) AS product, coalesce(a.price, b.price) AS price, coalesce(a.weigh, b.weigh) AS weigh
 FROM sales s LEFT JOIN mapped a ON a.key = s.code AND a.store = s.store LEFT JOIN mapped b ON b.key = s.code AND b.store IS NULL))""")  # fmt: skip
def pst_scan_sale(spark: SparkSession, d: str) -> DataFrame:
    return L.scan_sale(sales(spark, d), barcodes(spark, d))


LINES = "SELECT DISTINCT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part, CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS scale FROM lineitem"


@query(f""", lines AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line, part, scale) AS k, count(*) OVER (PARTITION BY doc) AS n, sum(scale) OVER (PARTITION BY doc) AS whole FROM ({LINES})),
 shares AS (SELECT l.*, total, CAST(round(CAST(total AS DOUBLE) * CAST(scale AS DOUBLE) / CAST(whole AS DOUBLE), 2) AS DECIMAL(18,2)) AS share FROM lines l JOIN invoices i ON i.doc = l.doc)
 SELECT doc, CAST(sum(CASE WHEN k = n THEN total - coalesce(b, 0) ELSE share END) AS DOUBLE) AS allocated, count(*) AS n, CAST(max(total) AS DOUBLE) AS total FROM
 (SELECT *, sum(share) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM shares) GROUP BY doc""")
def pst_allocate(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("scale")).distinct()
    out = L.allocate(lines.join(invoices(spark, d).select("doc", "total"), "doc"), "doc", ["line", "part", "scale"], "scale", "total")
    return out.groupBy("doc").agg(L.amount(F.col("allocated")).alias("allocated"), F.count("*").alias("n"), F.max("total").cast("double").alias("total"))


@query("SELECT doc, line, part, k AS line_no, k = 1 OR line <> p AS fresh FROM (SELECT *, row_number() OVER w AS k, lag(line) OVER w AS p FROM (" + LINES + ") WINDOW w AS (PARTITION BY doc ORDER BY line, part, scale))")
def win_next_line_no(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("line", "part", "scale")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("scale")).distinct()
    out = lines.withColumn("line_no", F.row_number().over(w).cast("long")).withColumn("p", F.lag("line").over(w))
    return out.select("doc", "line", "part", "line_no", ((F.col("line_no") == 1) | (F.col("line") != F.col("p"))).alias("fresh"))


@query("SELECT store, sale_date, arg_max(id, (sold_at, id)) AS id FROM sales GROUP BY 1, 2")
def win_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_per_key(sales(spark, d), ["store", "sale_date"], [F.desc("sold_at"), F.desc("id")]).select("store", "sale_date", "id")


@query("SELECT id, company FROM sales WHERE company = 1 AND store IN (SELECT n_nationkey % 10 FROM nation WHERE n_regionkey = 2)")
def rls_filter(spark: SparkSession, d: str) -> DataFrame:
    member = read(spark, d, "nation").where("n_regionkey = 2").select((F.col("n_nationkey") % 10).cast("long").alias("store"))
    return sales(spark, d).where("company = 1").join(member, "store", "left_semi").select("id", "company")


@query("SELECT id FROM (SELECT id, CASE WHEN company > 0 THEN company END AS tenant FROM sales) WHERE tenant = 1 OR tenant IS NULL")
def rls_client_filter(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d).select("id", F.when(F.col("company") > 0, F.col("company")).alias("tenant"))
    return s.where((F.col("tenant") == 1) | F.col("tenant").isNull()).select("id")


@query("SELECT key, store, product, CAST(CASE WHEN CAST(key AS INTEGER) % 2 = 0 THEN price + 1 ELSE price END AS DOUBLE) AS price FROM mapped")
def snk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Later versions of mappings over earlier ones, and over those new prices for every second key."""
    b = barcodes(spark, d).select("key", "store", "product", F.col("price").cast("double").alias("price"), F.struct("updated", "price").alias("v"))
    top = L.upsert(b.limit(0), b, ["key", "store"], "v")
    new = top.where(F.col("key").cast("int") % 2 == 0).withColumn("price", F.col("price") + 1)
    return L.upsert(top, new, ["key", "store"], "v").drop("v")


@query("SELECT key, store, product, CAST(price AS DOUBLE) AS price, updated FROM mapped")
def snk_upsert_table(spark: SparkSession, d: str) -> DataFrame:
    """The mappings as a table in buckets, put together by batches in any order, one of them twice."""
    from stockloom.sources.sinks import folder
    from stockloom.streaming.upserts import upsert_batch

    b, path = barcodes(spark, d).withColumn("v", F.struct("updated", "price")), folder(spark)
    for part in (2, 0, 1, 0):
        upsert_batch(b.where(F.pmod("updated", F.lit(3)) == part), path, ["key", "store"], "v", 8)
    return spark.read.parquet(path).select("key", "store", "product", F.col("price").cast("double").alias("price"), "updated")


@query("""SELECT s.id, coalesce(a.product, b.product) AS product, s.needs_mapping AND (is_cancelled OR coalesce(a.key, b.key) IS NULL) AS needs_mapping FROM sales s LEFT JOIN mapped a ON needs_mapping AND NOT is_cancelled AND a.key = s.code AND a.store = s.store LEFT JOIN mapped b ON needs_mapping AND NOT is_cancelled AND b.key = s.code AND b.store IS NULL""")
def snk_late_mapping_table(spark: SparkSession, d: str) -> DataFrame:
    """Sales in buckets of codes, priced by mappings that come late; the batch comes twice."""
    from stockloom.sources.sinks import folder
    from stockloom.streaming.upserts import bucketed_sales, map_batch

    path = folder(spark)
    bucketed_sales(sales(spark, d), path, 8)
    for _ in range(2):
        map_batch(barcodes(spark, d), path, 8)
    return spark.read.parquet(path).select("id", "product", "needs_mapping")


@query("SELECT CAST(sum(CASE WHEN sale_date >= DATE '2024-01-01' AND NOT is_cancelled THEN amount END) AS DOUBLE) - (SELECT CAST(sum(amount) AS DOUBLE) FROM movements WHERE is_active AND kind = 'IN' AND day BETWEEN DATE '1996-01-01' AND DATE '1996-01-31') AS month_left FROM sales")
def an_month_left(spark: SparkSession, d: str) -> DataFrame:
    s = L.active(sales(spark, d)).where("sale_date >= '2024-01-01'").agg(L.amount(F.col("amount")).alias("s"))
    p = movements(spark, d).where("is_active AND kind = 'IN'").where(F.col("day").between("1996-01-01", "1996-01-31")).agg(L.amount(F.col("amount")).alias("p"))
    return s.crossJoin(p).select((F.col("s") - F.col("p")).alias("month_left"))
