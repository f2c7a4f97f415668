"""Queries of postings: delivery orders, channels, tills, observation, receipts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators import delivery as V
from stockloom.operators import ledger as L
from stockloom.operators import posting as P
from stockloom.sources.adapters import barcodes, invoice_lines, movements, read, sales
from stockloom.streaming import capture as C

from .registry import query


def stock_of(spark: SparkSession, d: str, times: int) -> DataFrame:
    m = movements(spark, d).where("is_active").groupBy("store", "product").agg(F.sum(L.signed("qty")).alias("q"))
    return m.select("store", "product", (F.col("q") * times).cast("decimal(18,3)").alias("available"))


STOCK = "stock AS (SELECT store, product, sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) AS q FROM movements WHERE is_active GROUP BY 1, 2)"
ORDERED = f"""{STOCK}, o AS (SELECT o_orderkey AS order_id, o_custkey % 10 AS store, CASE WHEN o_orderkey % 6 > 0 THEN 'COUPANG' ELSE 'BAEMIN' END AS channel, CASE WHEN o_orderkey % 11 > 0 THEN CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) ELSE 0 END AS amount, o_orderdate AS seen FROM orders),
 ln AS (SELECT doc AS order_id, row AS line_no, CASE WHEN part < 100000 THEN lpad(CAST(part AS VARCHAR), 6, '0') ELSE CAST(part AS VARCHAR) END AS code, '2' || lpad(CAST(part AS VARCHAR), 6, '0') || lpad(CAST(part * 37 % 100000 AS VARCHAR), 5, '0') || '0' AS barcode, quantity, amount, part * 37 % 100000 AS e FROM invoice_lines),
 h AS (SELECT o.*, n, CASE WHEN channel <> 'COUPANG' THEN 'DELIVERY_CHANNEL_NOT_SUPPORTED' WHEN length(CAST(o.order_id AS VARCHAR)) < 3 THEN 'DELIVERY_ORDER_ID_REQUIRED' WHEN amount <= 0 THEN 'DELIVERY_ORDER_AMOUNT_REQUIRED' WHEN coalesce(n, 0) < 1 THEN 'DELIVERY_LINES_REQUIRED' WHEN n > 50 THEN 'DELIVERY_LINE_COUNT_INVALID' END AS head FROM o LEFT JOIN (SELECT order_id, count(*) AS n FROM ln GROUP BY 1) USING (order_id)),
 m AS (SELECT ln.*, h.store, h.seen, h.amount AS total, coalesce(a.product, b.product) AS product, coalesce(a.price, b.price) AS price, coalesce(a.weigh, b.weigh) AS weigh FROM ln JOIN h ON h.order_id = ln.order_id AND head IS NULL LEFT JOIN mapped a ON a.key = code AND a.store = h.store LEFT JOIN mapped b ON b.key = code AND b.store IS NULL),
 v AS (SELECT *, CAST(CASE weigh WHEN 'PRICE_EMBED' THEN round(e / price, 3) WHEN 'WEIGHT_EMBED' THEN round(e * 0.001, 3) WHEN 'FIXED' THEN 1 WHEN 'MANUAL' THEN quantity END AS DECIMAL(18,3)) AS qty, CAST(CASE weigh WHEN 'PRICE_EMBED' THEN e WHEN 'WEIGHT_EMBED' THEN round(e * price * 0.001, 2) WHEN 'FIXED' THEN price WHEN 'MANUAL' THEN CASE WHEN quantity > 0 THEN amount END END AS DECIMAL(18,2)) AS worth FROM m),
 w AS (SELECT *, CASE WHEN product IS NULL THEN 'BARCODE_NOT_MAPPED' WHEN qty IS NULL OR worth IS NULL THEN 'SALE_VALUE_REQUIRED' WHEN qty <= 0 THEN 'INVALID_QUANTITY' END AS wrong FROM v),
 g AS (SELECT order_id, arg_min(wrong || '_LINE_' || line_no, line_no) FILTER (wrong IS NOT NULL) AS line_error, sum(worth) AS scale FROM w GROUP BY 1),
 k AS (SELECT order_id, coalesce(line_error, CASE WHEN NOT coalesce(scale > 0, false) THEN 'DELIVERY_SCALE_AMOUNT_REQUIRED' END) AS line_error, scale FROM g),
 u AS (SELECT w.*, scale, coalesce(CAST(q * 20 AS DECIMAL(18,3)), 0) AS available FROM w JOIN k USING (order_id) LEFT JOIN stock s ON s.store = w.store AND s.product = w.product WHERE line_error IS NULL),
 rare AS (SELECT store, product FROM u GROUP BY 1, 2 HAVING sum(qty) > any_value(available)),
 ro AS (SELECT u.store, order_id, row_number() OVER (PARTITION BY u.store ORDER BY any_value(seen), order_id) AS i, list({{'line': line_no, 'product': u.product, 'qty': qty, 'available': available}} ORDER BY line_no) AS ls FROM u JOIN rare ON rare.store = u.store AND rare.product = u.product GROUP BY u.store, order_id),
 fold AS (SELECT DISTINCT store, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS order_id, CAST([] AS STRUCT(product VARCHAR, qty DECIMAL(18,3))[]) AS taken, CAST(NULL AS STRUCT(line BIGINT, rest DECIMAL(38,3), qty DECIMAL(18,3))) AS bad FROM ro
  UNION ALL SELECT store, i, order_id, CASE WHEN bad IS NULL THEN taken || list_transform(ls, lambda z: {{'product': z.product, 'qty': z.qty}}) ELSE taken END, bad FROM (
  SELECT ro.store, ro.i, ro.order_id, ls, taken, list_filter(list_transform(range(1, len(ls) + 1), lambda j: {{'line': ls[j].line, 'rest': CAST(ls[j].available - coalesce(list_sum(list_transform(list_filter(taken || list_transform(ls[1:j - 1], lambda z: {{'product': z.product, 'qty': z.qty}}), lambda y: y.product = ls[j].product), lambda y: y.qty)), 0) AS DECIMAL(38,3)), 'qty': ls[j].qty}}), lambda z: z.rest < z.qty)[1] AS bad FROM fold JOIN ro ON ro.store = fold.store AND ro.i = fold.i + 1)),
 l AS (SELECT order_id, bad.line AS short_line, CAST(bad.rest AS DECIMAL(18,3)) AS rest FROM fold WHERE bad IS NOT NULL)"""


def delivery(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(k.alias("order_id"), (F.col("o_custkey") % 10).alias("store"), F.when(k % 6 > 0, "COUPANG").otherwise("BAEMIN").alias("channel"), F.when(k % 11 > 0, F.round("o_totalprice", 2)).otherwise(0).cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").alias("at"))
    part = F.col("part").cast("string")
    code = F.when(F.length(part) < 6, F.lpad(part, 6, "0")).otherwise(part)
    barcode = F.concat(F.lit("2"), F.lpad(part, 6, "0"), F.lpad((F.col("part") * 37 % 100000).cast("string"), 5, "0"), F.lit("0"))
    l = invoice_lines(spark, d).select(F.col("doc").alias("order_id"), F.col("row").alias("line_no"), code.alias("code"), barcode.alias("barcode"), F.col("quantity").cast("decimal(18,3)").alias("quantity"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    return V.fulfilled(o, l, barcodes(spark, d), stock_of(spark, d, 20))


@query(f"WITH {ORDERED} SELECT h.order_id, coalesce(head, line_error, CASE WHEN short_line IS NOT NULL THEN 'INSUFFICIENT_STOCK_LINE_' || short_line || '_AVAILABLE_' || CAST(rest AS VARCHAR) END) AS error FROM h LEFT JOIN k USING (order_id) LEFT JOIN l USING (order_id)")
def pst_delivery_fulfil(spark: SparkSession, d: str) -> DataFrame:
    return delivery(spark, d)[0].select("order_id", "error")


@query(f"""WITH {ORDERED}, p AS (SELECT u.*, row_number() OVER (PARTITION BY order_id ORDER BY line_no) AS i, count(*) OVER (PARTITION BY order_id) AS n, CAST(round(CAST(total AS DOUBLE) * CAST(worth AS DOUBLE) / CAST(scale AS DOUBLE), 2) AS DECIMAL(18,2)) AS share FROM u ANTI JOIN l USING (order_id)),
 r AS (SELECT *, sum(share) OVER (PARTITION BY order_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
 SELECT store, count(*) AS lines, CAST(sum(qty) AS DOUBLE) AS quantity, CAST(sum(CASE WHEN i = n THEN total - coalesce(b, 0) ELSE share END) AS DOUBLE) AS amount FROM r GROUP BY 1""")
def pst_delivery_lines(spark: SparkSession, d: str) -> DataFrame:
    """What delivery orders post to each store."""
    q = lambda c, n: F.sum(F.col(c).cast(f"decimal(18,{n})")).cast("double").alias(c)
    return delivery(spark, d)[1].groupBy("store").agg(F.count("*").alias("lines"), q("quantity", 3), q("amount", 2))


PLACED = "p AS (SELECT o_orderkey AS order_id, ['FULFILLED', 'REVIEW', 'CANCELLED', 'OPEN'][o_orderkey % 4 + 1] AS status, o_orderkey % 5 = 0 AS shadow FROM orders)"


@query(f"WITH {PLACED} SELECT order_id, CASE WHEN order_id % 3 = 0 AND status IN ('FULFILLED', 'REVIEW') THEN 'CANCELLED' ELSE status END AS status, CASE WHEN order_id % 3 = 0 THEN CASE WHEN status IN ('FULFILLED', 'REVIEW') THEN 'CANCELLED' WHEN status = 'CANCELLED' THEN 'ALREADY_CANCELLED' ELSE 'DELIVERY_ORDER_NOT_CANCELLABLE' END END AS outcome FROM p")
def pst_delivery_cancel(spark: SparkSession, d: str) -> DataFrame:
    return cancelled(spark, d)[0]


@query(f"WITH {PLACED} SELECT doc AS order_id, row AS line_no FROM invoice_lines JOIN p ON order_id = doc WHERE doc % 3 = 0 AND status IN ('FULFILLED', 'REVIEW') AND NOT shadow AND part % 2 = 0 AND part % 7 > 0")
def stm_shadow(spark: SparkSession, d: str) -> DataFrame:
    """The rows that go back to stock: orders in shadow mode give none."""
    return cancelled(spark, d)[1].select("order_id", "line_no")


def cancelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("FULFILLED", "REVIEW", "CANCELLED", "OPEN"))), (k % 4).cast("int"))
    o = read(spark, d, "orders").select(k.alias("order_id"), status.alias("status"), (k % 5 == 0).alias("shadow"))
    l = invoice_lines(spark, d).select(F.col("doc").alias("order_id"), F.col("row").alias("line_no"), F.concat(F.lit("P"), "part").alias("product"), "quantity", "amount", (F.col("part") % 2 == 0).alias("posted"), (F.col("part") % 7 == 0).alias("reversed"))
    return V.cancelled(o.where("order_id % 3 = 0").select("order_id"), o, l)


@query("SELECT w.id, w.channel, max(p.sold_at) AS recorded_at, CASE WHEN max(p.sold_at) IS NOT NULL THEN 'POS_ALREADY_RECORDED' ELSE 'PROCESSED' END AS status FROM sales w LEFT JOIN sales p ON w.channel <> 'STORE' AND w.id % 9 > 0 AND p.source = 'local-agent' AND NOT p.is_cancelled AND p.store = w.store AND p.barcode = w.barcode AND p.sold_at <= w.sold_at AND epoch_us(w.sold_at) - epoch_us(p.sold_at) <= 7200000000 WHERE w.source = 'web-scan' GROUP BY 1, 2")
def pst_channel_sale(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    scans = s.where("source = 'web-scan'").withColumn("allow", F.col("id") % 9 == 0)
    return V.channel_sales(scans, s.where("source = 'local-agent' AND NOT is_cancelled"), s.select("id", F.lit("PROCESSED").alias("status")))


@query(f"""WITH {STOCK}, s AS (SELECT p_partkey AS id, p_partkey % 10 AS store, p_name AS product, CASE WHEN p_size % 7 > 0 THEN CAST(p_size % 7 * 100 AS DECIMAL(18,3)) END AS q, CASE WHEN p_partkey % 2 = 1 THEN CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) END AS price, CASE WHEN p_partkey % 2 = 0 THEN CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) END AS amount FROM part)
 SELECT id, CAST(coalesce(s.amount, s.q * coalesce(s.price, 0)) AS DOUBLE) AS amount, coalesce(CAST(s.price AS DOUBLE), CASE WHEN s.q > 0 THEN (CAST(coalesce(s.amount, 0) * 100 AS BIGINT) * 2000 + CAST(s.q * 1000 AS BIGINT)) // (2 * CAST(s.q * 1000 AS BIGINT)) / 100 END) AS price,
 CASE WHEN s.q IS NULL THEN 'QUANTITY_REQUIRED' END AS error, CASE WHEN s.q IS NOT NULL THEN coalesce(stock.q, 0) < s.q END AS low FROM s LEFT JOIN stock ON stock.store = s.store AND stock.product = s.product""")
def pst_manual_sale(spark: SparkSession, d: str) -> DataFrame:
    """Sales typed in by hand, some without a quantity: what is missing follows from the rest, and low stock is told, not refused."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.round("p_retailprice", 2).cast("decimal(18,2)")
    given = read(spark, d, "part").select(k.alias("id"), (k % 10).alias("store"), F.col("p_name").alias("product"), F.when(size % 7 > 0, (size % 7 * 100).cast("decimal(18,3)")).alias("quantity"), F.when(k % 2 == 1, price).alias("each"), F.when(k % 2 == 0, price).alias("whole"))
    x = V.with_stock_warning(given, stock_of(spark, d, 1)).withColumn("x", V.manual_sale(F.col("quantity"), F.col("each"), F.col("whole")))
    return x.select("id", "x.*", "low")


TILL = f"""{STOCK}, t AS (SELECT s.id, s.store, b.product, s.txn, s.sold_at, CAST(s.id % 30 + 1 AS DOUBLE) AS q, row_number() OVER (PARTITION BY s.store, s.txn ORDER BY s.sold_at, s.id) > 1 AS again FROM sales s JOIN (SELECT key, min(product) AS product FROM barcodes GROUP BY 1) b ON b.key = s.code),
 e AS (SELECT t.*, coalesce(CAST(st.q AS DOUBLE), 0) AS available, row_number() OVER (PARTITION BY t.store, t.product ORDER BY sold_at, id) AS k FROM t LEFT JOIN stock st ON st.store = t.store AND st.product = t.product)"""


@query(f"""WITH {TILL}, r AS (SELECT store, product, k, id, CASE WHEN again THEN 'DUPLICATE_EVENT' WHEN q > available THEN 'INSUFFICIENT_STOCK' ELSE 'SOLD' END AS status, CASE WHEN again OR q > available THEN available ELSE available - q END AS rest FROM e WHERE k = 1
 UNION ALL SELECT e.store, e.product, e.k, e.id, CASE WHEN again THEN 'DUPLICATE_EVENT' WHEN q > rest THEN 'INSUFFICIENT_STOCK' ELSE 'SOLD' END, CASE WHEN again OR q > rest THEN rest ELSE rest - q END FROM r JOIN e ON e.store = r.store AND e.product = r.product AND e.k = r.k + 1)
 SELECT id, status, rest AS "left" FROM r""")
def pst_pos_sale_v1(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    b = barcodes(spark, d).groupBy(F.col("key").alias("code")).agg(F.min("product").alias("product"))
    t = s.join(b, "code").withColumn("quantity", F.col("id") % 30 + 1)
    return V.till_sales(t, stock_of(spark, d, 1))


@query(f"""WITH {TILL.replace("row_number() OVER (PARTITION BY s.store, s.txn ORDER BY s.sold_at, s.id) > 1", "false")}, r AS (SELECT store, product, k, id, CASE WHEN q > available THEN 'INSUFFICIENT_STOCK' ELSE 'SOLD' END AS status, CASE WHEN q > available THEN available ELSE available - q END AS rest FROM e WHERE k = 1
 UNION ALL SELECT e.store, e.product, e.k, e.id, CASE WHEN q > rest THEN 'INSUFFICIENT_STOCK' ELSE 'SOLD' END, CASE WHEN q > rest THEN rest ELSE rest - q END FROM r JOIN e ON e.store = r.store AND e.product = r.product AND e.k = r.k + 1)
 SELECT id, status, rest AS "left" FROM r""")
def pst_manual_sale_v1(spark: SparkSession, d: str) -> DataFrame:
    """The older rule: a sale that lacks stock is refused and takes nothing."""
    s = sales(spark, d)
    b = barcodes(spark, d).groupBy(F.col("key").alias("code")).agg(F.min("product").alias("product"))
    t = s.join(b, "code").withColumn("quantity", F.col("id") % 30 + 1)
    return V.manual_sales_v1(t, stock_of(spark, d, 1))


SEEN = """x AS (SELECT s.id, CASE WHEN id % 8 = 0 THEN 'a/b' ELSE barcode END AS barcode, CAST(substr(barcode, 8, 5) AS INTEGER) AS e, coalesce(a.product, b.product) AS product, coalesce(a.price, b.price) AS price, coalesce(a.weigh, b.weigh) AS weigh FROM sales s LEFT JOIN mapped a ON a.key = s.code AND a.store = s.store LEFT JOIN mapped b ON b.key = s.code AND b.store IS NULL),
 y AS (SELECT *, CASE WHEN id % 8 = 0 THEN CASE WHEN weigh = 'FIXED' THEN 1 END ELSE CASE weigh WHEN 'PRICE_EMBED' THEN round(e / price, 3) WHEN 'WEIGHT_EMBED' THEN round(e * 0.001, 3) WHEN 'FIXED' THEN 1 END END AS qty, CASE WHEN id % 8 = 0 THEN CASE WHEN weigh = 'FIXED' THEN price END ELSE CASE weigh WHEN 'PRICE_EMBED' THEN e WHEN 'WEIGHT_EMBED' THEN round(e * price * 0.001, 2) WHEN 'FIXED' THEN price END END AS worth FROM x),
 z AS (SELECT id, product, CAST(qty AS DOUBLE) AS quantity, CAST(worth AS DOUBLE) AS amount, CASE WHEN id % 8 = 0 THEN 'INVALID_BARCODE' WHEN product IS NULL THEN 'BARCODE_NOT_MAPPED' WHEN worth IS NULL THEN 'SALE_VALUE_REQUIRED' END AS error FROM y)"""


def seen(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).drop("amount").withColumn("barcode", F.when(F.col("id") % 8 == 0, "a/b").otherwise(F.col("barcode")))


@query(f"WITH {SEEN} SELECT id, CASE WHEN error IS NULL THEN 'OBSERVED' ELSE 'PENDING' END AS status, product, quantity, amount, error FROM z WHERE id % 8 > 0")
def pst_observe_v1(spark: SparkSession, d: str) -> DataFrame:
    return V.observed(seen(spark, d), barcodes(spark, d), keep_odd=False)


@query(f"WITH {SEEN} SELECT id, CASE WHEN error IS NULL THEN 'OBSERVED' ELSE 'PENDING' END AS status, product, quantity, amount, error FROM z")
def pst_observe_v2(spark: SparkSession, d: str) -> DataFrame:
    return V.observed(seen(spark, d), barcodes(spark, d), keep_odd=True)


@query(f"WITH {SEEN} SELECT id, CASE WHEN id % 8 = 0 OR product IS NULL THEN 'FAILED' WHEN worth IS NULL THEN 'PENDING' ELSE 'PROCESSED' END AS status, CAST(round(worth) AS BIGINT) AS amount FROM y")
def pst_scan_v0(spark: SparkSession, d: str) -> DataFrame:
    return V.first_scan(seen(spark, d), barcodes(spark, d))


@query("WITH ready AS (SELECT doc FROM invoice_lines GROUP BY 1 HAVING count(*) FILTER (part % 23 = 0 OR trace = '') = 0) SELECT doc, row, quantity, 'IN' AS kind FROM invoice_lines JOIN invoices USING (doc) SEMI JOIN ready USING (doc) WHERE status = 'POSTED'")
def pst_ocr_post(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.sources.adapters import invoices

    docs = invoices(spark, d).select("doc", F.when(F.col("status") == "POSTED", "APPROVED").otherwise("OPEN").alias("status"))
    return V.received(docs, invoice_lines(spark, d).withColumn("name", F.concat(F.lit("P"), "part"))).select("doc", "row", "quantity", "kind")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN c > 0 THEN 'ADJUST_IN' ELSE 'ADJUST_OUT' END WHEN c > 0 THEN 'IN' ELSE 'OUT' END AS kind, abs(c) AS quantity FROM (SELECT event_id AS id, event_id % 21 - 10 AS c FROM events) WHERE c <> 0")
def pst_ledger_mem(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 21 - 10).alias("change"), (F.col("event_id") % 4 == 0).alias("adjust"))
    return V.signed_rows(e).select("id", "kind", "quantity")


KEYED = "SELECT s.id, s.store % 7 AS k FROM sales s WHERE source = '{}' AND s.store % 7 <> 4"


def keyed(spark: SparkSession, d: str, source: str) -> DataFrame:
    """Sales with the secret of the agent that sent them; one of the seven agents is switched off."""
    s = sales(spark, d).where(F.col("source") == source).select("id", F.concat(F.lit("secret"), F.col("store") % 7).alias("key"))
    c = spark.range(7).select(F.sha2(F.concat(F.lit("secret"), "id"), 256).alias("digest"), F.col("id").alias("store"), (F.col("id") != 4).alias("active"), F.lit(1).alias("since"))
    return V.by_credential(s, c).select("id", F.col("store").alias("k"))


@query(KEYED.format("local-agent"))
def pst_agent_sale(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d, "local-agent")


@query(KEYED.format("web-scan"))
def pst_web_sale(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d, "web-scan")


@query("SELECT id, status, before FROM (SELECT event_id AS id, user_id, s AS status, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, ['QUEUED', 'PROCESSING', 'REVIEW', 'SUCCESS', 'POSTED'][event_id % 5 + 1] AS s FROM events)) WHERE before <> status AND (before, status) NOT IN (('QUEUED', 'PROCESSING'), ('PROCESSING', 'REVIEW'), ('PROCESSING', 'SUCCESS'), ('PROCESSING', 'RETRY'), ('RETRY', 'PROCESSING'), ('REVIEW', 'SUCCESS'), ('REVIEW', 'POSTED'), ('SUCCESS', 'POSTED'))")
def pst_status_machine(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("QUEUED", "PROCESSING", "REVIEW", "SUCCESS", "POSTED"))), (F.col("event_id") % 5).cast("int"))
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", status.alias("status"))
    return P.illegal_transitions(e, "user_id", ["ts", "id"]).select("id", "status", "before")


@query("SELECT id FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id % 10, round(value, 1), CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stm_idempotent_hash(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each credential and digest of what it says."""
    e = read(spark, d, "events")
    said = F.sha2(F.concat_ws("|", F.format_number(F.round("value", 1), 1), F.to_date("ts").cast("string")), 256)
    return L.latest_per_key(e.withColumn("credential", F.col("user_id") % 10).withColumn("digest", said), ["credential", "digest"], [F.asc("ts"), F.asc("event_id")]).select(F.col("event_id").alias("id"))


@query("SELECT user_id % 10 AS store, min(ts) AS start, count(*) AS parts, CAST(sum(event_id % 3000) AS BIGINT) AS bytes, sum(event_id % 3000) > 65536 AS over FROM (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id)) >= 3240000000, true) AS g FROM events)) GROUP BY user_id % 10, s")
def stm_idle_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Hours stand for seconds: 0.9 of them end a buffer."""
    e = read(spark, d, "events").select((F.col("user_id") % 10).alias("store"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3000).alias("size"))
    return C.idle_buffers(e, "store", "54 minutes", 65536).withColumn("start", F.col("start").cast("timestamp_ntz"))


ORDERS_OF = """z AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'receipt' ELSE 'label' END AS kind, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 172800000000, true) AS g FROM events),
 s AS (SELECT *, sum(CASE WHEN g OR kind = 'receipt' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM z), w AS (SELECT id, user_id, kind, max(CASE WHEN kind = 'receipt' THEN id END) OVER (PARTITION BY user_id, n) AS order_id FROM s)"""


@query(f"WITH {ORDERS_OF} SELECT id, 'REVIEW' AS status FROM w WHERE order_id IS NULL AND kind = 'label'")
def stm_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Labels without an open order go to review."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "receipt").otherwise("label").alias("kind"))
    return C.order_sessions(e, ["user_id"], 172800).where("order_id IS NULL").select("id", F.lit("REVIEW").alias("status"))


@query("WITH touched AS (SELECT DISTINCT key FROM barcodes WHERE updated >= 45) SELECT s.code, count(*) AS n FROM sales s JOIN mapped m ON m.key = s.code AND m.store IS NULL SEMI JOIN touched t ON t.key = s.code WHERE needs_mapping AND NOT is_cancelled GROUP BY 1")
def stm_late_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Pending sales that the mappings of the last batch price again: those common to all stores."""
    b = barcodes(spark, d)
    fresh = b.where("updated >= 45").select(F.col("key").alias("code")).distinct()
    pending = sales(spark, d).where("needs_mapping AND NOT is_cancelled").join(fresh, "code", "left_semi")
    return P.apply_mapping(pending, b.where("store IS NULL")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_id + 5 WHEN event_id % 3 = 1 THEN event_id + 30 END AS next_at, CASE WHEN event_id % 3 < 2 THEN 'RETRY' ELSE 'REVIEW' END AS status FROM events")
def stm_retry(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seconds"), (F.col("event_id") % 3 + 1).alias("attempt"))
    return C.retries(e).select("id", "next_at", "status")


@query("SELECT store, greatest(5, least(22, store * 3)) AS hour, n FROM (SELECT store, count(*) AS n FROM sales WHERE sale_date = DATE '2024-01-14' GROUP BY 1) WHERE greatest(5, least(22, store * 3)) = 5")
def stm_cron(spark: SparkSession, d: str) -> DataFrame:
    """The stores whose brief goes out at five: an hour outside of 5 to 22 is moved into it."""
    n = sales(spark, d).where(F.col("sale_date") == F.lit("2024-01-14").cast("date")).groupBy("store").agg(F.count("*").alias("n"))
    return n.withColumn("hour", F.greatest(F.lit(5), F.least(F.lit(22), F.col("store") * 3))).where("hour = 5").select("store", "hour", "n")


@query("SELECT sale_date, count(*) AS n, count(*) FILTER (id % 50 = 0) AS late, CAST(sum(amount) AS DOUBLE) AS amount FROM sales WHERE sale_date IN (SELECT sale_date FROM sales WHERE id % 50 = 0) GROUP BY 1")
def stm_late_data(spark: SparkSession, d: str) -> DataFrame:
    """Late events count for their own day, whose summary is made again."""
    s = sales(spark, d)
    late = s.where("id % 50 = 0")
    n = late.groupBy("sale_date").agg(F.count("*").alias("late"))
    return C.refresh_buckets(late, s, ["sale_date"]).join(n, "sale_date").select("sale_date", "n", "late", "amount")


@query("""WITH RECURSIVE e AS (SELECT user_id % 10 AS device, event_id AS id, epoch_us(ts) / 3600000000 AS seconds, CAST(event_id % 10 AS VARCHAR) AS ch, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT device, k, id, seconds, ch, seconds AS first, id AS burst FROM e WHERE k = 1 UNION ALL SELECT e.device, e.k, e.id, e.seconds, e.ch, CASE WHEN e.seconds - r.seconds > 0.5 OR e.seconds - r.first > 3 THEN e.seconds ELSE r.first END, CASE WHEN e.seconds - r.seconds > 0.5 OR e.seconds - r.first > 3 THEN e.id ELSE r.burst END FROM r JOIN e ON e.device = r.device AND e.k = r.k + 1)
 SELECT device, burst, string_agg(ch, '' ORDER BY seconds, id) AS code FROM r GROUP BY 1, 2 HAVING max(seconds) - min(seconds) <= count(*) * 0.08 + 0.5""")
def stm_key_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Hours stand for seconds."""
    e = read(spark, d, "events").select((F.col("user_id") % 10).alias("device"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("seconds"), (F.col("event_id") % 10).cast("string").alias("char"))
    return C.key_bursts(e, "device", 0.5, 3.0)
