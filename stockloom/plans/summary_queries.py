"""Queries of summaries, rankings, sets, joins with overrides and the daily brief."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators import ledger as L
from stockloom.operators import posting as P
from stockloom.operators import stock as S
from stockloom.operators import summaries as M
from stockloom.sources.adapters import PIECES, asked_names, barcodes, cards, goods, invoice_lines, invoices, learned_rules, movements, picked, read, sales

from .registry import query

DAY = "2024-01-15"


@query("SELECT count(*) AS n, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM movements WHERE is_active AND kind = 'IN' AND day BETWEEN DATE '1994-03-01' AND DATE '1994-03-20' AND NOT coalesce(starts_with(memo, '판매취소 재고원복'), false)")
def agg_month_purchases(spark: SparkSession, d: str) -> DataFrame:
    return L.month_purchases(movements(spark, d), "1994-03-20")


STATUS = "CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'view' THEN 'REVIEW_REQUIRED' WHEN 'error' THEN 'FAILED' ELSE 'PARSE_COMPLETED' END"


def documents(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_type") == "view", "REVIEW_REQUIRED").when(F.col("event_type") == "error", "FAILED").otherwise("PARSE_COMPLETED")
    k = F.col("event_id")
    return e.select(k.alias("id"), "ts", "user_id", status.alias("status"), F.when(k % 4 == 0, "PENDING").alias("review"), (k % 101).alias("quality"), F.when(k % 3 > 0, k % 97).alias("confidence"), F.when(k % 6 > 0, k % 5000).otherwise(-1).alias("millis"), (k % 9 == 0).alias("duplicate"))


@query(f"""SELECT count(*) AS total, CAST(floor(100 * count(*) FILTER (s <> 'FAILED') / count(*) + 0.5) AS BIGINT) AS success, CAST(floor(avg(CASE WHEN k % 3 > 0 THEN k % 97 ELSE k % 101 END) + 0.5) AS BIGINT) AS confidence, CAST(floor(100 * count(*) FILTER (s = 'REVIEW_REQUIRED' OR k % 4 = 0) / count(*) + 0.5) AS BIGINT) AS review,
 CAST(floor(100 * count(*) FILTER (k % 101 < 70) / count(*) + 0.5) AS BIGINT) AS recapture, CAST(floor(avg(k % 5000) FILTER (k % 6 > 0) + 0.5) AS BIGINT) AS millis, count(*) FILTER (k % 9 = 0) AS duplicates FROM (SELECT event_id AS k, {STATUS} AS s FROM events)""")
def agg_queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.queue(documents(spark, d))


@query("SELECT count(*) FILTER (is_cancelled) AS cancelled, count(*) FILTER (needs_mapping AND NOT is_cancelled) AS pending, count(*) FILTER (NOT needs_mapping AND NOT is_cancelled) AS done FROM sales WHERE CAST(sold_at + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-15'")
def agg_health_today(spark: SparkSession, d: str) -> DataFrame:
    """The statuses of the day that began at midnight in Seoul."""
    s = sales(spark, d).where(F.col("sold_at").between(F.lit("2024-01-14 15:00:00").cast("timestamp_ntz"), F.lit("2024-01-15 14:59:59.999999").cast("timestamp_ntz")))
    on = lambda c, n: F.count_if(c).alias(n)
    c, m = F.col("is_cancelled"), F.col("needs_mapping")
    return s.agg(on(c, "cancelled"), on(m & ~c, "pending"), on(~m & ~c, "done"))


@query("SELECT store, count(*) FILTER (event_type = 'purchase') AS orders, count(*) FILTER (event_type <> 'purchase') AS labels, count(*) FILTER (event_type = 'view') AS matched, count(*) FILTER (event_type = 'error') AS review FROM (SELECT user_id % 10 AS store, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15') GROUP BY 1")
def agg_delivery_status(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where(F.to_date("ts") == F.lit(DAY).cast("date"))
    is_ = lambda *t: F.col("event_type").isin(*t)
    return e.groupBy((F.col("user_id") % 10).alias("store")).agg(F.count_if(is_("purchase")).alias("orders"), F.count_if(~is_("purchase")).alias("labels"), F.count_if(is_("view")).alias("matched"), F.count_if(is_("error")).alias("review"))


PROBED = ("customer", "orders", "lineitem", "part", "supplier", "events")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) > 0 AS ok, bool_and(ok) OVER () AS all_ok FROM (SELECT count(*) AS n, count(*) > 0 AS ok FROM {t}) GROUP BY ok" for t in PROBED) + ")")
def agg_table_probe(spark: SparkSession, d: str) -> DataFrame:
    each = [read(spark, d, t).limit(1).agg((F.count("*") > 0).alias("ok")).select(F.lit(t).alias("name"), "ok") for t in PROBED]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.crossJoin(rows.agg(F.bool_and("ok").alias("all_ok")))


@query("SELECT store, logs = 0 AS missing, CASE WHEN logs > 0 THEN expiring ELSE 0 END AS badge FROM (SELECT store, count(*) FILTER (day = DATE '1995-06-15') AS logs, count(*) FILTER (is_active AND expiry BETWEEN DATE '1995-06-15' AND DATE '1995-06-18') AS expiring FROM movements GROUP BY 1)")
def agg_alert_badge(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1995-06-15").cast("date")
    g = movements(spark, d).groupBy("store").agg(F.count_if(F.col("day") == day).alias("logs"), F.count_if(F.col("is_active") & F.col("expiry").between(day, F.date_add(day, 3))).alias("expiring"))
    return g.select("store", (F.col("logs") == 0).alias("missing"), F.when(F.col("logs") > 0, F.col("expiring")).otherwise(0).alias("badge"))


@query("SELECT total, confidence, repeated, unknown, automatic, CAST(least(100, floor(confidence * 0.6 + least(40, repeated * 4) + 0.5)) AS BIGINT) AS learning FROM (SELECT count(*) AS total, CAST(floor(avg(p_size) + 0.5) AS BIGINT) AS confidence, CAST(sum(greatest(0, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 ELSE 1 END - 1)) AS BIGINT) AS repeated, count(*) FILTER (p_partkey % 7 = 0) AS unknown, count(*) FILTER (p_partkey % 7 = 1) AS automatic FROM part)")
def agg_history_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return M.history(read(spark, d, "part").select(F.col("p_size").alias("confidence"), F.when(k % 5 > 0, k % 4).alias("selections"), F.when(k % 7 == 0, "UNKNOWN").when(k % 7 == 1, "AUTO_APPROVED").alias("decision")))


@query("SELECT count(*) AS total, count(*) FILTER (p_partkey % 4 = 0) AS automatic, count(*) FILTER (p_partkey % 4 IN (1, 2)) AS review, count(*) FILTER (p_partkey % 4 = 3) AS unknown, count(DISTINCT CASE WHEN p_size > 10 THEN p_brand END) AS entries, CAST(floor(100 * count(*) FILTER (p_partkey % 4 = 0) / count(*) + 0.5) AS BIGINT) AS accuracy FROM part")
def agg_candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("AUTO_APPROVED", "REVIEW_REQUIRED", "USER_SELECT", "UNKNOWN"))), (F.col("p_partkey") % 4).cast("int"))
    return M.candidates(read(spark, d, "part").select(status.alias("status"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("dictionary")))


@query("SELECT count(*) AS cases, count(*) FILTER (p_partkey % 3 > 0) AS open, round(avg(CASE WHEN p_partkey % 5 > 0 THEN p_size ELSE 0 END), 6) AS confidence FROM part")
def agg_failure_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return M.failures(read(spark, d, "part").select(F.when(k % 3 == 0, "RESOLVED").when(k % 3 == 1, "OPEN").alias("status"), F.when(k % 5 > 0, F.col("p_size")).alias("confidence")))


@query("SELECT count(*) AS loaded, count(*) FILTER (size > 20) AS mapped, count(*) FILTER (size <= 20) AS pending, count(*) FILTER (unit = 'box') AS costs, (SELECT count(*) FROM (SELECT 1 FROM goods GROUP BY name, supplier HAVING count(*) > 1)) AS duplicate_groups FROM goods")
def agg_source_summary(spark: SparkSession, d: str) -> DataFrame:
    g = goods(spark, d).withColumn("mapped", F.col("size") > 20).withColumn("cost", F.col("unit") == "box")
    return M.sources(g, F.struct("name", "supplier"))


LOGS = "logs AS (SELECT user_id % 10 AS store, CAST(ts AS DATE) AS day, ts AS created, event_id AS id, list_transform(range(1, 11), lambda i: [10, 5, 1, 10][(event_id * i + user_id) % 4 + 1]) AS points FROM events)"


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Sanitation logs: ten items of 10, 5 or 1 points."""
    k, u = F.col("event_id"), F.col("user_id")
    points = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.get(F.array(F.lit(10), F.lit(5), F.lit(1), F.lit(10)), ((k * i + u) % 4).cast("int")))
    return read(spark, d, "events").select((u % 10).alias("store"), F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("created"), points.alias("points"))


@query(f"WITH {LOGS} SELECT store, item, mean, place FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY mean, item) AS place FROM (SELECT store, i AS item, round(avg(points[i]), 4) AS mean FROM logs, range(1, 11) r(i) GROUP BY 1, 2) WHERE mean < 8) WHERE place <= 3")
def agg_monthly_sanitation(spark: SparkSession, d: str) -> DataFrame:
    return M.weakest_items(logs(spark, d), ["store"])


@query(f"WITH {LOGS} SELECT store, day, {', '.join(f'p[{i}] AS item{i}' for i in range(1, 11))}, CAST(list_sum(p) AS BIGINT) AS total, list_sum(p) < 80 AS short FROM (SELECT store, day, arg_max(points, (created, id)) AS p FROM logs GROUP BY 1, 2)")
def agg_month_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return M.scorecard(logs(spark, d), ["store"], 10)


@query("SELECT supplier, id, round(avg(size) OVER w, 6) AS mean, count(*) OVER w AS samples FROM goods WINDOW w AS (PARTITION BY supplier ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def agg_running_average(spark: SparkSession, d: str) -> DataFrame:
    return M.running_average(goods(spark, d), ["supplier"], ["id"], "size").select("supplier", "id", "mean", "samples")


@query("SELECT unit AS family, count(*) AS n, " + ", ".join(f"count(*) FILTER (o = '{s}') AS {s}, round(100 * count(*) FILTER (o = '{s}') / count(*), 2) AS {s}_rate" for s in ("correct", "safe", "wrong")) + " FROM (SELECT unit, CASE WHEN size > 20 THEN 'correct' WHEN size > 5 THEN 'safe' ELSE 'wrong' END AS o FROM goods) GROUP BY 1")
def agg_accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    return M.accuracy(goods(spark, d).select(F.col("unit").alias("family"), F.when(F.col("size") > 20, "correct").when(F.col("size") > 5, "safe").otherwise("wrong").alias("outcome")))


@query("SELECT s_suppkey AS store, n_name AS company, count(b.key) AS codes, coalesce(any_value(q), 0) AS stock FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT DISTINCT key, store FROM barcodes) b ON b.store = s_suppkey % 10 OR b.store IS NULL AND s_suppkey % 10 = 3 LEFT JOIN (SELECT store, CAST(sum(qty) AS DOUBLE) AS q FROM movements WHERE is_active GROUP BY 1) m ON m.store = s_suppkey % 10 GROUP BY 1, 2")
def jn_left_multi(spark: SparkSession, d: str) -> DataFrame:
    """Stores with the codes that hold for them (store 3 has the common ones too) and their stock: both are counted before the join."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("store"), F.col("n_name").alias("company"), (F.col("s_suppkey") % 10).alias("shop"))
    b = barcodes(spark, d).select("key", "store").distinct().groupBy(F.coalesce("store", F.lit(3)).alias("shop")).agg(F.count("*").alias("codes"))
    m = movements(spark, d).where("is_active").groupBy(F.col("store").alias("shop")).agg(F.sum("qty").cast("double").alias("stock"))
    out = s.join(b, "shop", "left").join(m, "shop", "left")
    return out.select("store", "company", F.coalesce("codes", F.lit(0)).alias("codes"), F.coalesce("stock", F.lit(0.0)).alias("stock"))


@query("WITH s AS (SELECT s_suppkey AS id, lower(s_name) AS name_key, 'c' || s_nationkey AS code_key FROM supplier), a AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) ELSE 'c' || s_suppkey % 40 END AS key, 'A' || s_suppkey AS alias FROM supplier), f AS (SELECT id, alias, 0 AS p FROM s JOIN a ON key = name_key UNION ALL SELECT id, alias, 1 FROM s JOIN a ON key = code_key) SELECT s.id, b.alias FROM s LEFT JOIN (SELECT id, alias FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, alias) AS k FROM f) WHERE k = 1) b USING (id)")
def jn_left_optional_alias(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    names = s.select(k.alias("id"), F.lower("s_name").alias("name_key"), F.concat(F.lit("c"), "s_nationkey").alias("code_key"))
    aliases = s.select(F.when(k % 3 == 0, F.lower("s_name")).otherwise(F.concat(F.lit("c"), k % 40)).alias("key"), F.concat(F.lit("A"), k).alias("alias"))
    return M.optional_alias(names, aliases).select("id", "alias")


@query("SELECT supplier, name, id FROM (SELECT *, row_number() OVER (PARTITION BY supplier, name ORDER BY size % 2 DESC, size DESC, id DESC) AS k FROM goods) WHERE k = 1")
def jn_lateral_best_dict(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary row of each supplier and name: approved first, then the surest, then the newest."""
    g = goods(spark, d)
    asked = g.select("supplier", "name").distinct()
    best = M.best_rows(g, ["supplier", "name"], [F.desc(F.col("size") % 2), F.desc("size"), F.desc("id")])
    return asked.join(best.select("supplier", "name", "id"), ["supplier", "name"], "left")


@query("SELECT s_suppkey AS id, alias FROM supplier, (SELECT unnest(['미박앞다리', '미박 앞다리살', '껍데기 앞다리']) AS alias)")
def jn_cross_unnest(spark: SparkSession, d: str) -> DataFrame:
    aliases = F.array(*map(F.lit, ("미박앞다리", "미박 앞다리살", "껍데기 앞다리")))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(aliases).alias("alias"))


@query("SELECT p_partkey AS id, risk FROM part JOIN (VALUES ('STANDARD', 'low'), ('PROMO', 'high'), ('ECONOMY', 'mid')) v(word, risk) ON split_part(p_type, ' ', 1) = word")
def jn_values_cte(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES ('STANDARD', 'low'), ('PROMO', 'high'), ('ECONOMY', 'mid') AS v(word, risk)")
    return read(spark, d, "part").withColumn("word", F.split_part("p_type", F.lit(" "), F.lit(1))).join(rules, "word").select(F.col("p_partkey").alias("id"), "risk")


@query("SELECT id, coalesce(b.product, '-') AS product, coalesce(n_name, '-') AS shop FROM sales s LEFT JOIN (SELECT key, max(product) AS product FROM barcodes GROUP BY 1) b ON b.key = code LEFT JOIN nation ON n_nationkey = s.store")
def jn_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = barcodes(spark, d).groupBy(F.col("key").alias("code")).agg(F.max("product").alias("product"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("store"), "n_name")
    s = sales(spark, d).join(b, "code", "left").join(n, "store", "left")
    return s.select("id", F.coalesce("product", F.lit("-")).alias("product"), F.coalesce("n_name", F.lit("-")).alias("shop"))


@query("""WITH p AS (SELECT id AS product, list_distinct(list_filter(string_split(lower(source), ' '), lambda w: w <> '')) AS b FROM learned_rules), l AS (SELECT id AS line, list_distinct(list_filter(string_split(lower(name), ' '), lambda w: w <> '')) AS a FROM asked_names),
 s AS (SELECT line, product, len(list_intersect(a, b)) AS c, len(a) + len(b) AS n FROM l, p WHERE list_has_any(a, b))
 SELECT line, product, CAST(floor(100 * c / (n - c) + 0.5) AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, product) <= 5""")
def jn_product_candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.word_candidates(asked_names(spark, d).select(F.col("id").alias("line"), F.col("name").alias("text")), learned_rules(spark, d).select(F.col("id").alias("product"), F.col("source").alias("name")))


LABELS = (("name", "red"), ("price", "blue"), ("amount", "green"))


@query("SELECT doc, \"column\", token FROM (SELECT *, row_number() OVER (PARTITION BY doc, \"column\" ORDER BY confidence DESC, token) AS k FROM (SELECT DISTINCT p_brand AS doc, p_partkey AS token, p_size AS confidence, c AS \"column\" FROM part, (VALUES ('name', 'red'), ('price', 'blue'), ('amount', 'green')) v(c, w) WHERE contains(p_name, w))) WHERE k = 1")
def jn_header_text(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("token"), F.col("p_name").alias("text"), F.col("p_size").alias("confidence"))
    return M.header_columns(t, LABELS).select("doc", "column", "token")


@query("SELECT doc, CAST(sum(CASE WHEN k = n THEN w - coalesce(b, 0) ELSE s END) AS DOUBLE) AS allocated FROM (SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT doc, row, row AS k, count(*) OVER (PARTITION BY doc) AS n, CAST(100 AS DECIMAL(18,2)) AS w, CAST(round(100::DOUBLE * price / sum(price) OVER (PARTITION BY doc), 2) AS DECIMAL(18,2)) AS s FROM invoice_lines)) GROUP BY 1")
def win_residual_last(spark: SparkSession, d: str) -> DataFrame:
    l = invoice_lines(spark, d).select("doc", "row", "price", F.lit(100).cast("decimal(18,2)").alias("total"))
    return L.allocate(l, "doc", ["row"], "price", "total").groupBy("doc").agg(F.sum("allocated").cast("double").alias("allocated"))


@query("""WITH t AS (SELECT doc, id, y, greatest(12, CASE WHEN median(h) OVER d > 0 THEN median(h) OVER d * 0.75 ELSE 16 END) AS reach, row_number() OVER (PARTITION BY doc ORDER BY y, x, id, text, w, h, confidence) AS k FROM page_tokens WINDOW d AS (PARTITION BY doc)),
 r AS (SELECT doc, k, id, y, CAST(1 AS BIGINT) AS line, CAST(y AS DOUBLE) AS s, 1 AS n FROM t WHERE k = 1 UNION ALL SELECT t.doc, t.k, t.id, t.y, CASE WHEN abs(s / n - t.y) <= reach THEN line ELSE line + 1 END, CASE WHEN abs(s / n - t.y) <= reach THEN s + t.y ELSE t.y END, CASE WHEN abs(s / n - t.y) <= reach THEN n + 1 ELSE 1 END FROM r JOIN t ON t.doc = r.doc AND t.k = r.k + 1)
 SELECT doc, id, CAST(y AS DOUBLE) AS y, line FROM r""")
def win_line_cluster(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.operators.layout import line_clusters
    from stockloom.sources.adapters import page_tokens

    return line_clusters(page_tokens(spark, d)).select("doc", "id", "y", "line")


@query("SELECT id, action FROM (SELECT id, [\'HOLD\', \'ORDER\', \'REVIEW\', \'REDUCE\'][size % 4 + 1] AS action, size FROM goods) ORDER BY CASE action WHEN 'ORDER' THEN 0 WHEN 'REDUCE' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END, size DESC, id LIMIT 50")
def srt_action_rank(spark: SparkSession, d: str) -> DataFrame:
    action = F.get(F.array(*map(F.lit, ("HOLD", "ORDER", "REVIEW", "REDUCE"))), F.col("size") % 4)
    g = goods(spark, d).withColumn("action", action)
    return g.orderBy(S.action_rank(F.col("action")), F.desc("size"), "id").limit(50).select("id", "action")


KO_NAMES = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey % 100 AS STRING) || '번' WHEN 2 THEN upper(p_name) ELSE {} END"


@query(f"SELECT id, name, row_number() OVER (ORDER BY name COLLATE ko, name, id) AS place FROM (SELECT p_partkey AS id, {KO_NAMES.format(picked(PIECES, 'p_partkey * 5 % 24', True))} AS name FROM part) ORDER BY place LIMIT 400")
def srt_locale_ko(spark: SparkSession, d: str) -> DataFrame:
    """The first names in Korean order: digits, Hangul, then Latin letters, capitals behind small ones."""
    names = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(KO_NAMES.format(picked(PIECES, "p_partkey * 5 % 24", False))).alias("name"))
    first = M.korean_order(names, ["name", "id"]).limit(400)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.collate("name", "ko"), "name", "id")))


@query("WITH b AS (SELECT p_brand AS doc, p_partkey AS id, p_partkey % 10 * 100 AS x, p_size % 5 * 100 AS y, p_size AS confidence FROM part), h AS (SELECT DISTINCT a.doc, a.id FROM b a JOIN b c ON a.doc = c.doc AND a.id <> c.id AND greatest(0, least(a.x, c.x) + 110 - greatest(a.x, c.x)) * greatest(0, least(a.y, c.y) + 110 - greatest(a.y, c.y)) / 12100 >= 0.65) SELECT doc, id FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence, id) AS k FROM b ANTI JOIN h USING (doc, id)) WHERE k <= 3")
def lim_zoom_targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    b = read(spark, d, "part").select(F.col("p_brand").alias("doc"), k.alias("id"), (k % 10 * 100).alias("x"), (F.col("p_size") % 5 * 100).alias("y"), F.lit(110).alias("w"), F.lit(110).alias("h"), F.col("p_size").alias("confidence"))
    box = lambda n: {s: F.col(f"{n}.{s}").cast("double") for s in "xywh"}
    return M.apart_boxes(b, S.overlap(box("a"), box("b"))).select("doc", "id")


@query("SELECT id, greatest(0, least(x + 100, 200) - greatest(x, 50)) * 80.0 / least(8000, 12000) AS share FROM (SELECT p_partkey AS id, p_partkey % 200 AS x FROM part)")
def mth_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("p_partkey") % 200).cast("double")
    a = {"x": x, "y": F.lit(0.0), "w": F.lit(100.0), "h": F.lit(80.0)}
    b = {"x": F.lit(50.0), "y": F.lit(0.0), "w": F.lit(150.0), "h": F.lit(80.0)}
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.overlap(a, b).alias("share"))


@query("SELECT doc, row FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence, price DESC, row) AS k FROM invoice_lines) WHERE k <= 2")
def lim_region_priority(spark: SparkSession, d: str) -> DataFrame:
    """The two lines of each document most in need of a second look: the least sure, then the dearest; in reading order."""
    return M.best_rows(invoice_lines(spark, d), ["doc"], [F.asc("confidence"), F.desc("price"), F.asc("row")], 2).select("doc", "row")


POOLS = "VALUES ('hot', 'pork', 0, '냉채'), ('hot', 'beef', 0, '소금구이'), ('cold', 'pork', 0, '수육'), ('cold', 'beef', 1, '곰탕'), ('cold', 'pork', 1, '김치찌개'), ('weekend', 'pork', 0, '바비큐'), ('weekend', 'beef', 1, '스테이크'), ('autumn', 'beef', 0, '불고기'), ('autumn', 'pork', 0, '버섯구이')"


@query(f"""WITH s AS (SELECT DISTINCT store, CAST(sale_date AS VARCHAR) AS day, CASE WHEN hour(sold_at) < 12 THEN 'morning' WHEN hour(sold_at) < 18 THEN 'afternoon' ELSE 'evening' END AS part, ['hot', 'cold', 'weekend', 'autumn'][day(sale_date) % 4 + 1] AS context FROM sales), p(context, species, position, menu) AS ({POOLS}),
 c AS (SELECT *, 100 - position * 3 + CASE WHEN context = 'hot' AND regexp_matches(menu, '(냉채|무침|소금구이|채소)') OR context = 'cold' AND regexp_matches(menu, '(찌개|전골|탕|곰탕|감자탕|백숙)') OR context = 'weekend' AND regexp_matches(menu, '(구이|바비큐|스테이크|수육|보쌈)') OR context = 'autumn' AND regexp_matches(menu, '(버섯|구이|불고기|찜)') THEN 24 ELSE 0 END
  + CASE WHEN part = 'morning' AND regexp_matches(menu, '(찌개|국|탕|백숙|곰탕)') OR part = 'afternoon' AND regexp_matches(menu, '(구이|볶음|불고기|냉채|무침)') OR part = 'evening' AND regexp_matches(menu, '(구이|찜|전골|수육|보쌈|바비큐)') THEN 12 ELSE 0 END AS score,
  list_reduce(list_prepend(CAST(7 AS BIGINT), list_transform(string_split(day || '|' || part || '|' || store || '|' || menu, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS tie FROM s JOIN p USING (context))
 SELECT store, day, part, menu, score FROM (SELECT *, row_number() OVER (PARTITION BY store, day, part ORDER BY score DESC, tie DESC, menu) AS k FROM c) WHERE k = 1""")
def an_menu_rank(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    part = F.when(F.hour("sold_at") < 12, "morning").when(F.hour("sold_at") < 18, "afternoon").otherwise("evening")
    context = F.get(F.array(*map(F.lit, ("hot", "cold", "weekend", "autumn"))), F.dayofmonth("sale_date") % 4)
    stores = s.select("store", F.col("sale_date").cast("string").alias("day"), part.alias("part"), context.alias("context")).distinct()
    return M.menus(stores, spark.sql(f"SELECT * FROM {POOLS} AS p(context, species, position, menu)")).select("store", "day", "part", "menu", "score")


@query("SELECT species, menu FROM (SELECT species, menu, row_number() OVER (PARTITION BY species ORDER BY n DESC, menu) AS k FROM (SELECT ['beef', 'pork'][id % 2 + 1] AS species, name AS menu, count(*) AS n FROM goods GROUP BY 1, 2)) WHERE k = 1")
def lim_rank_menu(spark: SparkSession, d: str) -> DataFrame:
    g = goods(spark, d).groupBy(F.when(F.col("id") % 2 == 0, "beef").otherwise("pork").alias("species"), F.col("name").alias("menu")).agg(F.count("*").alias("n"))
    return M.best_rows(g, ["species"], [F.desc("n"), F.asc("menu")]).select("species", "menu")


@query("SELECT id, name, priority FROM (SELECT id, name, CASE WHEN size % 2 = 0 THEN 300 ELSE 100 END AS priority FROM goods WHERE size < 20 UNION ALL SELECT id, name, 400 FROM goods WHERE size >= 40 UNION ALL SELECT id, name, 200 FROM goods WHERE size BETWEEN 20 AND 30)")
def set_concat_rules(spark: SparkSession, d: str) -> DataFrame:
    g = goods(spark, d)
    own = g.where("size < 20").withColumn("priority", F.when(F.col("size") % 2 == 0, 300).otherwise(100))
    return own.unionByName(g.where("size >= 40").withColumn("priority", F.lit(400))).unionByName(g.where("size BETWEEN 20 AND 30").withColumn("priority", F.lit(200))).select("id", "name", "priority")


@query("SELECT id, list_sort(list_distinct(list_concat([name, supplier], [unit, name]))) AS labels FROM goods")
def set_distinct_merge(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", F.array_sort(F.array_union(F.array("name", "supplier"), F.array("unit", "name"))).alias("labels"))


@query("SELECT key FROM (SELECT code AS key FROM sales WHERE needs_mapping UNION SELECT key FROM barcodes UNION SELECT lpad(CAST(p_size AS VARCHAR), 6, '0') FROM part) WHERE regexp_full_match(key, '[0-9]{6}')")
def set_observed_keys(spark: SparkSession, d: str) -> DataFrame:
    seen = sales(spark, d).where("needs_mapping").select(F.col("code").alias("key")).unionByName(barcodes(spark, d).select("key"))
    tested = read(spark, d, "part").select(F.lpad(F.col("p_size").cast("string"), 6, "0").alias("key"))
    return seen.unionByName(tested).where(F.col("key").rlike("^[0-9]{6}$")).distinct()


@query("SELECT id, list_filter(['name', 'qty', 'price'], lambda c: NOT list_contains(found, c)) AS missing, CAST(round(100 * len(found) / 3.0) AS BIGINT) AS coverage FROM (SELECT id, list_filter([CASE WHEN id % 2 = 0 THEN 'name' END, CASE WHEN id % 3 = 0 THEN 'qty' END, CASE WHEN id % 5 = 0 THEN 'price' END], lambda x: x IS NOT NULL) AS found FROM goods)")
def set_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    found = F.array_compact(F.array(F.when(k % 2 == 0, "name"), F.when(k % 3 == 0, "qty"), F.when(k % 5 == 0, "price")))
    return goods(spark, d).select("id", F.array_except(F.array(F.lit("name"), F.lit("qty"), F.lit("price")), found).alias("missing"), M.percent(F.size(found), F.lit(3)).alias("coverage"))


@query("SELECT id, strftime(sold_at, '%Y-%m') AS ym FROM sales")
def dt_ym(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).select("id", F.date_format("sold_at", "yyyy-MM").alias("ym"))


HOLIDAYS = ("1995-01-02", "1995-05-05", "1996-12-25")


@query("""SELECT doc, (SELECT d FROM (SELECT CAST(day + CAST(i AS INTEGER) AS DATE) AS d, row_number() OVER (ORDER BY i) AS k FROM range(1, 27) r(i) WHERE dayofweek(CAST(day + CAST(i AS INTEGER) AS DATE)) BETWEEN 1 AND 5 AND CAST(day + CAST(i AS INTEGER) AS DATE) NOT IN (DATE '1995-01-02', DATE '1995-05-05', DATE '1996-12-25')) WHERE k = 3) AS due FROM (SELECT o_orderkey AS doc, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def dt_business_day_add(spark: SparkSession, d: str) -> DataFrame:
    days = F.array(*(F.lit(h).cast("date") for h in HOLIDAYS))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), M.business_days(F.to_date("o_orderdate"), 3, days).alias("due"))


@query("SELECT p_partkey AS id, p_size * (1000 * 0.3 + 500 * 2.5) / 1000000 AS cost FROM part")
def mth_token_cost(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.token_cost(F.col("p_size"), 1000, 500, 0.3, 2.5).alias("cost"))


@query("SELECT id, CAST(list_sum(list_transform(range(1, 11), lambda i: CASE (id + i) % 4 WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 1 ELSE 0 END)) AS BIGINT) AS total, CAST(len(list_filter(range(1, 11), lambda i: (id + i) % 4 > 0)) AS BIGINT) AS rated FROM goods")
def arr_score_items(spark: SparkSession, d: str) -> DataFrame:
    ratings = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when((F.col("id") + i) % 4 > 0, (F.col("id") + i) % 4))
    g = goods(spark, d).withColumn("items", M.scored_items(ratings))
    return g.select("id", F.expr("aggregate(items, 0L, (a, x) -> a + x.points)").alias("total"), F.size(F.filter("items", lambda x: x["rating"].isNotNull())).cast("long").alias("rated"))


@query("""SELECT id, CASE WHEN size > 20 THEN '{"name":"' || supplier || '","size":' || size || '}' ELSE '{"name":"' || supplier || '"}' END AS j FROM goods""")
def json_strip_nulls(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", F.to_json(F.struct(F.col("supplier").alias("name"), F.when(F.col("size") > 20, F.col("size")).alias("size"))).alias("j"))


@query("SELECT id, supplier AS a, CASE WHEN size > 20 THEN 'new' ELSE 'old' END AS b FROM goods")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the second object win."""
    old = F.create_map(F.lit("a"), F.col("supplier"), F.lit("b"), F.lit("old"))
    new = F.when(F.col("size") > 20, F.create_map(F.lit("b"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("x")))
    keep = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return goods(spark, d).select("id", F.map_concat(keep, new).alias("m")).select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("""SELECT supplier, '[' || string_agg('{"unit":"' || unit || '","n":' || n || '}', ',' ORDER BY unit) || ']' AS j FROM (SELECT supplier, unit, count(*) AS n FROM goods GROUP BY 1, 2) GROUP BY 1""")
def json_build_agg(spark: SparkSession, d: str) -> DataFrame:
    c = goods(spark, d).groupBy("supplier", "unit").agg(F.count("*").alias("n"))
    return c.groupBy("supplier").agg(F.to_json(F.array_sort(F.collect_list(F.struct("unit", "n")))).alias("j"))


@query("SELECT id, CASE WHEN size <= price * 0.01 THEN 'danger' WHEN size < price * 0.02 THEN 'warn' ELSE 'ok' END AS status FROM goods")
def an_stock_status(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", S.stock_status(F.col("size"), F.col("price") * F.lit("0.02").cast("decimal(3,2)")).alias("status"))


@query("SELECT id, list_filter([CASE WHEN size % 10 > 5 THEN 'FRIDGE_ABOVE_5' END, CASE WHEN size % 30 - 40 > -18 THEN 'FREEZER_ABOVE_-18' END], lambda x: x IS NOT NULL) AS warnings, CASE WHEN id % 3 = 0 THEN '아직 1개 항목이 남았어요.' WHEN id % 3 = 1 THEN '먼저 챙겨볼 곳: 바닥 · 한 번 더 살펴볼 곳: 칼' ELSE '한 번 더 살펴볼 곳: 바닥, 칼' END AS advice FROM goods WHERE NOT (size % 10 > 5 OR size % 30 - 40 > -18) UNION ALL SELECT id, w, CASE WHEN id % 3 = 0 THEN '아직 1개 항목이 남았어요.' WHEN id % 3 = 1 THEN '먼저 챙겨볼 곳: 바닥 · 한 번 더 살펴볼 곳: 칼 · ' ELSE '한 번 더 살펴볼 곳: 바닥, 칼 · ' END || CASE WHEN id % 3 = 0 THEN '' ELSE array_to_string(w, ', ') END FROM (SELECT id, size, list_filter([CASE WHEN size % 10 > 5 THEN 'FRIDGE_ABOVE_5' END, CASE WHEN size % 30 - 40 > -18 THEN 'FREEZER_ABOVE_-18' END], lambda x: x IS NOT NULL) AS w FROM goods) WHERE len(w) > 0")
def an_sanitation_advice(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("id") % 3, F.col("size")
    warnings = S.temperature_issues(size % 10, size % 30 - 40)
    ratings = F.array(F.when(k == 0, F.lit(None).cast("int")).when(k == 1, 3).otherwise(2), F.lit(2))
    return goods(spark, d).select("id", warnings.alias("warnings"), M.advice(ratings, F.array(F.lit("바닥"), F.lit("칼")), warnings).alias("advice"))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'incomplete' WHEN t >= 90 THEN 'excellent' WHEN t >= 80 THEN 'good' WHEN t >= 60 THEN 'caution' ELSE 'urgent' END AS band, CAST(list_sum(list_transform(string_split('s' || id || ':' || t, ''), lambda c: unicode(c))) AS BIGINT) % 5 AS number FROM (SELECT id, size * 2 AS t FROM goods)")
def an_sanitation_message(spark: SparkSession, d: str) -> DataFrame:
    x = M.sanitation_group(F.col("size") * 2, F.col("id") % 5 != 0, F.concat(F.lit("s"), "id"))
    return goods(spark, d).select("id", x.alias("x")).select("id", "x.*")


HEARD = "heard AS (SELECT store, max(sold_at) AS seen FROM sales WHERE store < 8 GROUP BY 1), stores AS (SELECT DISTINCT store FROM sales)"


@query(f"WITH {HEARD} SELECT store, CASE WHEN seen IS NULL THEN 'NEVER' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(seen) > 900000000 THEN 'OFFLINE' ELSE 'ONLINE' END AS status FROM stores LEFT JOIN heard USING (store)")
def an_health_status(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    heard = s.where("store < 8").groupBy("store").agg(F.max(F.col("sold_at").cast("timestamp")).alias("seen"))
    return s.select("store").distinct().join(heard, "store", "left").select("store", P.health(F.col("seen"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("status"))


@query(f"WITH {HEARD} SELECT store, seen FROM stores LEFT JOIN heard USING (store) ORDER BY seen DESC NULLS LAST, store")
def pst_health_view(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    heard = P.heartbeats(s.where("store < 8"), ["store"], "sold_at", []).withColumnRenamed("sold_at", "seen")
    return s.select("store").distinct().join(heard, "store", "left").orderBy(F.desc_nulls_last("seen"), "store").select("store", "seen")


@query("SELECT store FROM (SELECT store, max(sold_at) AS seen FROM sales GROUP BY 1) WHERE epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(seen) > 900000000")
def stm_heartbeat_stale(spark: SparkSession, d: str) -> DataFrame:
    h = P.heartbeats(sales(spark, d).withColumn("sold_at", F.col("sold_at").cast("timestamp")), ["store"], "sold_at", [])
    return h.where(P.health(F.col("sold_at"), F.lit("2024-01-31 00:00:00").cast("timestamp")) == "OFFLINE").select("store")


@query("SELECT id, CASE size % 4 WHEN 0 THEN '임박·예상 손실 재고가 있어 새 발주보다 기존 재고 소진이 우선입니다.' WHEN 1 THEN '학습 데이터가 아직 부족해 수량은 참고값입니다. 실사와 납기를 확인해 주세요.' WHEN 2 THEN '현재 가용재고가 소비기한 내 목표재고를 충족해 발주를 보류합니다.' ELSE '리드타임 수요와 안전재고를 반영해 ' || size || 'kg 발주를 제안합니다.' END AS text FROM goods")
def an_explain(spark: SparkSession, d: str) -> DataFrame:
    action = F.get(F.array(*map(F.lit, ("REDUCE", "REVIEW", "HOLD", "ORDER"))), F.col("size") % 4)
    return goods(spark, d).select("id", M.explanation(action, F.col("size")).alias("text"))


@query("SELECT store, day, '어제 매출 ' || format('{:,}', CAST(floor(y + 0.5) AS BIGINT)) || '원' || CASE WHEN w > 0 THEN ' (지난주 같은 요일 대비 ' || CASE WHEN r >= 0 THEN '▲' ELSE '▼' END || abs(r) || '%)' ELSE '' END || chr(10) || '이번 달 매출 ' || format('{:,}', CAST(floor(m + 0.5) AS BIGINT)) || '원' AS text FROM (SELECT *, CAST(floor((y - w) / w * 100 + 0.5) AS BIGINT) AS r FROM (SELECT store, DATE '2024-01-15' AS day, coalesce(sum(amount) FILTER (sale_date = DATE '2024-01-14'), 0)::DOUBLE AS y, coalesce(sum(amount) FILTER (sale_date = DATE '2024-01-07'), 0)::DOUBLE AS w, coalesce(sum(amount) FILTER (sale_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'), 0)::DOUBLE AS m FROM sales WHERE NOT is_cancelled AND sale_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' GROUP BY 1))")
def an_brief_text(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    s = L.active(sales(spark, d)).where(F.col("sale_date").between(F.lit("2024-01-01").cast("date"), day))
    on = lambda n, a: L.amount(F.when(F.col("sale_date") == F.date_sub(day, n), F.col("amount"))).alias(a)
    b = s.groupBy("store").agg(on(1, "yesterday"), on(8, "last_week_same_day"), L.amount(F.col("amount")).alias("month_sales"))
    none = {c: F.lit(0) for c in ("deposits_n", "deposits", "month_purchases", "unmapped_n", "expiring_n")}
    return M.brief_lines(b.withColumns({"day": day} | none))
