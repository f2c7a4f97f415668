"""Queries of replenishment, invoice checks, scorecards and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators import ledger as L
from stockloom.operators import stock as S
from stockloom.sources.adapters import goods, movements, read, sales
from stockloom.streaming import capture as C
from stockloom.streaming import timers as X

from .registry import query

DAY = "2024-01-28"
SERIES = f""", days AS (SELECT CAST(unnest(range(DATE '{DAY}' - 55, DATE '{DAY}' + 1, INTERVAL 1 DAY)) AS DATE) AS sale_date), sold AS (SELECT code, sale_date, CAST(sum(amount) AS DOUBLE) AS s FROM sales WHERE NOT is_cancelled AND sale_date BETWEEN DATE '{DAY}' - 55 AND DATE '{DAY}' GROUP BY 1, 2),
 series AS (SELECT c.code, d.sale_date, coalesce(s, 0) AS sold FROM (SELECT DISTINCT code FROM sold) c CROSS JOIN days d LEFT JOIN sold ON sold.code = c.code AND sold.sale_date = d.sale_date),
 stats AS (SELECT code, round(avg(sold) FILTER (sale_date > DATE '{DAY}' - 7) * 0.65 + avg(sold) * 0.35, 3) AS demand, round(stddev_samp(sold), 3) AS deviation, count(*) AS days, round(least(0.95, 0.25 + count(*) / 56), 2)::DOUBLE AS confidence FROM series GROUP BY 1)"""


@query(SERIES + " SELECT * FROM stats")
def agg_demand_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.demand_stats(S.demand_series(L.active(sales(spark, d)), ["code"], DAY), ["code"], DAY)


@query(SERIES + " SELECT code, sale_date, sold FROM series")
def map_demand_series(spark: SparkSession, d: str) -> DataFrame:
    return S.demand_series(L.active(sales(spark, d)), ["code"], DAY)


@query(SERIES + """, a AS (SELECT *, 1.28 * deviation AS safety, CASE WHEN demand > 0 THEN demand * 5 * 0.9 ELSE 'inf'::DOUBLE END AS cap, (CAST(code AS INTEGER) % 40)::DOUBLE AS on_hand, (CASE WHEN CAST(code AS INTEGER) % 9 = 0 THEN 2 ELSE 0 END)::DOUBLE AS waste FROM stats),
 b AS (SELECT *, greatest(0, least(demand * 2 + safety, cap)) AS t, greatest(0, on_hand - waste) AS available FROM a),
 c AS (SELECT *, CASE WHEN t - available <= 0 THEN 0 ELSE greatest(10, ceil((t - available) / 5) * 5) END AS r, least(0.98, confidence * 0.35 + 0.27 + 0.2 + 0.12) AS sure FROM b)
 SELECT code, round(safety + demand, 3) AS reorder_point, round(t, 3) AS target, round(r, 3)::DOUBLE AS recommended, CASE WHEN sure < 0.55 OR days < 7 THEN 'REVIEW' WHEN waste > 0 OR available >= cap THEN 'REDUCE' WHEN r > 0 THEN 'ORDER' ELSE 'HOLD' END AS action FROM c""")  # fmt: skip
def an_safety_stock(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code").cast("int")
    s = agg_demand_stats(spark, d).withColumns({"on_hand": (code % 40).cast("double"), "waste": F.when(code % 9 == 0, 2.0).otherwise(0.0), "pack": F.lit(5.0), "moq": F.lit(10.0), "stock_confidence": F.lit(0.9), "lead_samples": F.lit(20)})
    return S.safety_stock(s, "F1_CORE_FRESH").select("code", "reorder_point", "target", "recommended", "action")


@query("""SELECT p_brand AS brand, round(greatest(0.78, least(0.96, (0.88 * 50 + sum(o) FILTER (ok)) / (50 + sum(i) FILTER (ok)))), 4)::DOUBLE AS rate, round(sum(l) FILTER (ok) / sum(i) FILTER (ok), 4) AS loss_rate, count(*) FILTER (ok) AS n,
 round(greatest(0.25, least(0.98, 0.25 + count(*) FILTER (ok) / 40 + sum(i) FILTER (ok) / 500)), 2)::DOUBLE AS confidence, CASE WHEN count(*) FILTER (ok) >= 30 THEN 'STORE_LEARNED' ELSE 'BLENDED' END AS source
 FROM (SELECT p_brand, p_size::DOUBLE AS i, p_size * 0.9::DOUBLE AS o, 0.5::DOUBLE AS l, abs(p_size::DOUBLE - p_size * 0.9::DOUBLE - 0.5::DOUBLE) / p_size <= 0.1 AS ok FROM part) GROUP BY 1""")  # fmt: skip
def an_yield_profile(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("input"), (F.col("p_size") * 0.9).alias("output"), F.lit(0.0).alias("byproduct"), F.lit(0.5).alias("loss"))
    return S.yield_profile(p, ["brand"], "TRIM_STANDARD")


@query("SELECT product, CAST(q AS DOUBLE) AS qty, CASE WHEN q <= 150 THEN 'danger' WHEN q < 300 THEN 'warn' ELSE 'ok' END AS status, CASE WHEN q < 300 THEN greatest(50, CAST(ceil(450 - q) AS BIGINT)) END AS recommended FROM (SELECT product, sum(CASE WHEN kind = 'OUT' THEN -qty ELSE qty END) AS q FROM movements WHERE is_active GROUP BY 1)")
def an_reorder(spark: SparkSession, d: str) -> DataFrame:
    m = movements(spark, d).where("is_active").groupBy("product").agg(L.amount(L.signed("qty")).alias("qty"))
    safe = F.lit(300.0)
    return m.select("product", "qty", S.stock_status(F.col("qty"), safe).alias("status"), S.reorder(F.col("qty"), safe, F.lit(50)).cast("long").alias("recommended"))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN p_retailprice WHEN p_size > 25 THEN p_size::DOUBLE ELSE p_size * p_retailprice END AS line FROM part")
def agg_page_subtotal(spark: SparkSession, d: str) -> DataFrame:
    supply, total = F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")), F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    return read(spark, d, "part").select("p_partkey", S.line_amount(supply, total, F.col("p_size"), F.col("p_retailprice")).alias("line"))


@query("""SELECT doc, count(*) AS pages, sum(s)::DOUBLE AS actual, sum(g)::DOUBLE AS displayed_sum, (CASE WHEN max(k) > 1 THEN arg_max(g, (k, -f)) ELSE 0 END)::DOUBLE AS repeated FROM
 (SELECT *, count(*) OVER (PARTITION BY doc, g) AS k, min(page) OVER (PARTITION BY doc, g) AS f FROM (SELECT l_orderkey AS doc, l_linenumber AS page, sum(CAST(l_quantity AS BIGINT)) AS s, max(CAST(l_quantity AS BIGINT)) % 4 + 1 AS g FROM lineitem GROUP BY 1, 2)) GROUP BY doc""")
def agg_pages_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    p = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.sum(q).alias("subtotal"), (F.max(q) % 4 + 1).alias("displayed"))
    return S.page_summary(p, "doc")


@query("""SELECT user_id, day, sum(CASE r WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END)::BIGINT AS score, count(*) AS items FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id % 3 AS r FROM events) GROUP BY 1, 2""")
def an_sanitation_score(spark: SparkSession, d: str) -> DataFrame:
    points = S.sanitation_points(F.col("event_id") % 3 + 1)
    return read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(points).alias("score"), F.count("*").alias("items"))


@query("SELECT id, CASE WHEN contains(n, '냉동') OR contains(n, 'frozen') THEN 'F4_FROZEN_BUFFER' WHEN contains(n, '다짐') OR contains(n, '양념') THEN 'F2_SHORT_LIFE_PROCESSED' WHEN (contains(n, '특수') OR contains(n, '한우') OR contains(n, '안심') OR contains(n, '채끝')) AND size % 5 < 2 THEN 'F3_PREMIUM_INTERMITTENT' WHEN contains(n, '미박') OR contains(n, '앞다리') OR contains(n, '뒷다리') THEN 'F5_TRANSFORMABLE_RAW' ELSE 'F1_CORE_FRESH' END AS class FROM (SELECT id, lower(name) AS n, size FROM goods)")
def an_policy_class(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", S.policy_class(F.col("name"), F.col("size") % 5).alias("class"))


@query("""SELECT id, max(CASE WHEN kind = 'receipt' THEN id END) OVER (PARTITION BY user_id, s) AS order_id FROM (SELECT *, sum(CASE WHEN g OR kind = 'receipt' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM
 (SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'receipt' ELSE 'label' END AS kind, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 172800000000, true) AS g FROM events))""")
def stm_order_session(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "receipt").otherwise("label").alias("kind"))
    return C.order_sessions(e, ["user_id"], 172800)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'purchase' THEN 'receipt' ELSE 'label' END AS kind FROM events),
 g AS (SELECT *, sum(CASE WHEN kind = 'receipt' OR coalesce(ms - b > 172800000, true) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, lag(ms) OVER (PARTITION BY key ORDER BY ms, id) AS b FROM e)),
 s AS (SELECT key, n, max(id) FILTER (kind = 'receipt') AS order_id, count(*) FILTER (kind = 'label') AS labels, max(ms) AS last, lead(min(ms)) OVER (PARTITION BY key ORDER BY n) AS next FROM g GROUP BY 1, 2)
 SELECT key, order_id, labels, CASE WHEN coalesce(next - last > 172800000, true) THEN last + 172800000 ELSE next END AS closed_ms, CASE WHEN coalesce(next - last > 172800000, true) THEN 'IDLE' ELSE 'NEXT_RECEIPT' END AS "trigger" FROM s WHERE order_id IS NOT NULL""")
def stm_order_close(spark: SparkSession, d: str) -> DataFrame:
    """When and why each order closes; two days stand for the idle time."""
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "receipt").otherwise("label").alias("kind"))
    return X.order_closings(e, 172_800_000)


@query("""WITH b AS (SELECT DISTINCT CAST(user_id % 100 AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, lag(ms) OVER (PARTITION BY key ORDER BY ms) AS p, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS f FROM b)
 SELECT key, ms AS at_ms, 'ONLINE' AS status FROM g WHERE coalesce(ms - p > 54000000, true) UNION ALL SELECT key, ms + 54000000, 'OFFLINE' FROM g WHERE coalesce(f - ms > 54000000, true)""")
def stm_online_changes(spark: SparkSession, d: str) -> DataFrame:
    """Tills going offline and coming back; fifteen hours stand for as many minutes."""
    b = read(spark, d, "events").select((F.col("user_id") % 100).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return X.silences(b, 54_000_000)


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS code, epoch_us(ts) / 3600000000 AS seconds FROM events), f AS (SELECT code, min(seconds) AS seconds, arg_min(id, (seconds, id)) AS id FROM e GROUP BY 1),
 r AS (SELECT * FROM f UNION ALL SELECT e.code, min(e.seconds), arg_min(e.id, (e.seconds, e.id)) FROM r JOIN e ON e.code = r.code AND e.seconds - r.seconds >= 24 GROUP BY e.code) SELECT id, code, seconds FROM r""")
def stm_debounce_2s(spark: SparkSession, d: str) -> DataFrame:
    """Hours stand for seconds: the events are that far apart."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("code"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("seconds"))
    return C.debounce(e, 24.0)


@query("SELECT company, store, sale_date, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales WHERE (company, store, sale_date) IN (SELECT company, store, sale_date FROM sales WHERE channel = 'ETC') GROUP BY 1, 2, 3")
def stm_summary_trigger(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    return C.refresh_buckets(s.where("channel = 'ETC'"), s, ["company", "store", "sale_date"])
