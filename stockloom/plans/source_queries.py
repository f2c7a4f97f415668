"""Queries of sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import names as N
from stockloom.functions import texts as T
from stockloom.operators.ledger import amount, latest_per_key
from stockloom.sources import readers as R
from stockloom.sources import sinks as K
from stockloom.sources.adapters import barcodes, cards, goods, invoice_lines, movements, read, sales

from .registry import query


@query("SELECT doc, supplier, expiry FROM movements WHERE is_active AND (product LIKE '%red%' OR supplier LIKE '%7') AND qty >= 10 AND qty < 40")
def src_rest_predicates(spark: SparkSession, d: str) -> DataFrame:
    where = [("is_active", "eq", True), ("qty", "gte", 5), ("qty", "gte", 10), ("qty", "lt", 40)]
    return R.rest_scan(movements(spark, d, supplier=True), ["doc", "supplier", "expiry"], where, [("product", "like", "%red%"), ("supplier", "like", "%7")])


@query("SELECT id, channel FROM sales WHERE channel IN ('STORE', 'ETC') AND NOT needs_mapping ORDER BY sold_at DESC, id LIMIT 100")
def src_rest_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.rest_scan(sales(spark, d), ["id", "channel"], [("channel", "in", ("STORE", "ETC")), ("needs_mapping", "eq", False)], order=[("sold_at", False), ("id", True)], limit=100)


@query("SELECT row, part FROM invoice_lines WHERE doc = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def src_line_items(spark: SparkSession, d: str) -> DataFrame:
    l = invoice_lines(spark, d)
    last = l.agg(F.max("doc")).first()[0]
    return R.children(l, "doc", last, "row").select("row", "part")


@query("SELECT CAST(p_partkey % 1000000 AS VARCHAR) AS code, p_name AS name, round(p_retailprice, 2) AS price FROM part")
def src_csv_paste(spark: SparkSession, d: str) -> DataFrame:
    """The part table as someone pastes it: no header, prices with separators."""
    line = F.concat_ws("\t", F.col("p_name"), F.format_number(F.round("p_retailprice", 2), 2), (F.col("p_partkey") % 1000000).cast("string"))
    return R.pasted(read(spark, d, "part").select((F.col("p_partkey") + 1).alias("n"), line.alias("line")), 3)


@query("SELECT id, name FROM goods")
def src_encoding_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Names as bytes: every second one in UTF-8, the others in EUC-KR."""
    g = goods(spark, d)
    raw = F.when(F.col("id") % 2 == 0, F.encode("name", "UTF-8")).otherwise(T.korean_bytes("name"))
    return g.select("id", T.decoded(raw).alias("name"))


@query("SELECT CASE WHEN m.key IS NULL THEN 'unmatched' ELSE 'imported' END AS status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM sales s LEFT JOIN (SELECT DISTINCT key FROM barcodes WHERE weigh <> 'MANUAL') m ON m.key = s.code GROUP BY 1")
def src_pos_csv_import(spark: SparkSession, d: str) -> DataFrame:
    known = barcodes(spark, d).where("weigh <> 'MANUAL'").select(F.col("key").alias("code")).distinct().withColumn("known", F.lit(True))
    s = sales(spark, d).join(known, "code", "left")
    return s.groupBy(F.when(F.col("known"), "imported").otherwise("unmatched").alias("status")).agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


@query("SELECT key, status FROM (SELECT CASE WHEN id % 3 > 0 THEN 'm|' || id % 5000 ELSE 'm|' || card || '_' || sale_date || '_' || amount END AS key, CASE WHEN deposit_date <= DATE '1995-06-01' THEN 'PAID' ELSE 'SCHEDULED' END AS status, row_number() OVER (PARTITION BY CASE WHEN id % 3 > 0 THEN 'm|' || id % 5000 ELSE 'm|' || card || '_' || sale_date || '_' || amount END ORDER BY id DESC) AS k FROM cards) WHERE k = 1")
def src_card_collect_b(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a card feed by approval number, or where it is missing by what they say; the last one of a key counts."""
    own = F.concat_ws("_", "card", F.col("sale_date").cast("string"), F.col("amount").cast("string"))
    key = F.concat_ws("|", F.lit("m"), F.when(F.col("id") % 3 > 0, (F.col("id") % 5000).cast("string")).otherwise(own))
    status = F.when(F.col("deposit_date") <= F.lit("1995-06-01").cast("date"), "PAID").otherwise("SCHEDULED")
    return latest_per_key(cards(spark, d).withColumn("key", key).withColumn("state", status), ["key"], [F.desc("id")]).select("key", F.col("state").alias("status"))


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS origin, NULL AS grade FROM part")
def src_xml_flatten(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<r><name>"), "p_name", F.lit("</name><origin> "), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("</origin><origin>"), "p_type", F.lit("</origin><grade> </grade></r>"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.xml_values(body, ("name", "origin", "grade")).alias("x")).select("id", "x.*")


@query("SELECT p_partkey AS id, p_brand AS supplier, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS total FROM part")
def src_json_schema_out(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("p_brand").alias("supplier"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("total")))
    text = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.fenced_json(text, "supplier string, total int", {"supplier": F.lit(""), "total": F.lit(0)}).alias("x")).select("id", "x.*")


@query("SELECT p_brand AS doc, p_partkey AS row, p_name AS name, CAST(p_size AS VARCHAR) AS quantity FROM part WHERE p_partkey % 10 > 0")
def src_clova_table(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    cell = lambda c, text: F.struct(F.lit(c).alias("col"), text.cast("string").alias("text"))
    name = F.when(F.col("p_partkey") % 10 == 0, "합계").otherwise(F.col("p_name"))
    body = p.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("row"), F.explode(F.array(cell(0, name), cell(1, F.col("p_size")), cell(2, F.lit(" ")))).alias("x")).select("doc", "row", "x.*").where("row > 0")
    heads = p.select(F.col("p_brand").alias("doc")).distinct().select("doc", F.lit(0).cast("long").alias("row"), F.explode(F.array(cell(0, F.lit("품 명")), cell(1, F.lit("수량(kg)")), cell(2, F.lit("비고")))).alias("x")).select("doc", "row", "x.*")
    return R.table_rows(heads.unionByName(body), (("name", r"품\s*명|상품"), ("quantity", "수량|중량")))


@query("SELECT doc, 'A-' || doc AS order_id, CAST(floor(total) AS DOUBLE) AS amount FROM invoices WHERE doc % 3 > 0 AND floor(total) > 0")
def src_receipt_parse(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.sources.adapters import invoices

    text = F.concat(F.lit("\x1b@배달\n주문번호: A-"), "doc", F.lit("\n결제금액 : "), F.format_number("total", 0), F.lit("원\n"))
    raw = T.korean_bytes(F.when(F.col("doc") % 3 > 0, text).otherwise("주문 없음"))
    i = invoices(spark, d).withColumn("total", F.floor("total"))
    return i.select("doc", T.receipt(T.printed(T.decoded(raw))).alias("x")).where("x IS NOT NULL").select("doc", "x.*")


@query("SELECT id, barcode, 'P' || code AS name, CASE WHEN id % 2 = 0 THEN 0.35 ELSE 1.2 END::DOUBLE AS kilograms, CAST(id % 90 * 100 AS DOUBLE) AS price, CAST(id % 70 * 1000 AS DOUBLE) AS amount FROM sales WHERE id % 5 > 0")
def src_label_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    text = F.concat(F.lit("품명 : P"), "code", F.lit("\n중량: "), F.when(k % 2 == 0, "350 g").otherwise("1.2kg"), F.lit("\n단가: "), F.format_number(k % 90 * 100, 0), F.lit("\n금액: "), F.format_number(k % 70 * 1000, 0), F.lit("\n"), F.when(k % 5 > 0, F.col("barcode")).otherwise("123"), F.lit("\n"))
    return sales(spark, d).select("id", T.label_signal(text).alias("x")).where("x IS NOT NULL").select("id", "x.*")


@query("SELECT supplier, id, name FROM goods")
def src_json_recordset(spark: SparkSession, d: str) -> DataFrame:
    staged = goods(spark, d).groupBy("supplier", (F.col("id") % 100).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("body"))
    return staged.select("supplier", F.explode(R.recordset(F.col("body"), "id long, name string")).alias("x")).select("supplier", "x.*")


@query("SELECT id, regexp_replace(name, '삼겸', '삼겹', 'g') AS name, CASE WHEN contains(name, '삼겸') THEN 'fixed' ELSE 'raw' END AS state FROM goods")
def snk_regex_rewrite(spark: SparkSession, d: str) -> DataFrame:
    g = goods(spark, d).withColumn("meta", F.create_map(F.lit("state"), F.lit("raw")))
    return K.rewritten(g, "name", "삼겸", "삼겹", {"state": "fixed"}).select("id", "name", F.col("meta")["state"].alias("state"))


@query("SELECT key, greatest(CASE WHEN key % 3 > 0 THEN s END, 0) AS pending, checked FROM (SELECT p_partkey AS key, p_size + CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END AS s, p_partkey % 5 = 0 AND p_partkey % 3 > 0 AS checked FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0) WHERE key % 3 > 0 UNION ALL SELECT p_partkey, p_size + 100, false FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def snk_merge_keep_flag(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("pending"))
    old = p.where("key % 3 > 0").withColumn("checked", F.col("key") % 5 == 0)
    new = p.where("key % 2 = 0").select("key", (F.col("pending") + 100).alias("pending")).withColumn("checked", F.lit(None).cast("boolean"))
    return K.merged_keeping(old, new, "key", "checked", ["pending"])


@query("SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM movements GROUP BY 1")
def snk_partition_ddl(spark: SparkSession, d: str) -> DataFrame:
    months = K.write_months(movements(spark, d).select("doc", "line", "day"), "day", K.folder(spark))
    return months.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM movements WHERE day < DATE '1997-01-01' GROUP BY 1")
def snk_partition_archive(spark: SparkSession, d: str) -> DataFrame:
    months = K.write_months(movements(spark, d).select("doc", "line", "day"), "day", K.folder(spark))
    return K.archived(months, "2002-01-20").select(F.col("month").cast("string").alias("month"), "n")


@query("SELECT store, count(*) AS n FROM sales GROUP BY 1")
def snk_migrate_verify(spark: SparkSession, d: str) -> DataFrame:
    return K.migrated(sales(spark, d).select("id", "store"), K.folder(spark)).groupBy("store").agg(F.count("*").alias("n"))


@query("SELECT id, store FROM sales WHERE id % 10 = 0 OR id % 10 = 1 ORDER BY sold_at DESC, id LIMIT 30")
def snk_audit_event(spark: SparkSession, d: str) -> DataFrame:
    path, s = K.folder(spark), sales(spark, d).select("id", "store", "sold_at")
    K.appended(s.where("id % 10 = 0"), path)
    return K.appended(s.where("id % 10 = 1"), path).orderBy(F.desc("sold_at"), "id").limit(30).select("id", "store")


@query("SELECT s_suppkey AS subscription, s_name || ': ' || s_nationkey AS text FROM supplier WHERE s_suppkey % 4 > 0")
def snk_message(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").withColumn("subscription", F.col("s_suppkey"))
    sent = s.where("s_suppkey % 4 = 0").select("subscription", F.lit("2024-01-15").cast("date").alias("day")).unionByName(s.where("s_suppkey % 4 = 1").select("subscription", F.lit("2024-01-14").cast("date").alias("day")))
    return K.due_messages(s, sent, "2024-01-15", F.concat_ws(": ", "s_name", F.col("s_nationkey").cast("string")))


@query("SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN company END, store) AS company, CASE WHEN id % 4 > 0 THEN store ELSE first END AS store FROM sales JOIN (SELECT company AS c, min(store) AS first FROM sales GROUP BY 1) ON c = company")
def prj_fill_company_store(spark: SparkSession, d: str) -> DataFrame:
    """Missing companies take the tenant (here the store), missing stores the company's first one."""
    s = sales(spark, d)
    first = s.groupBy("company").agg(F.min("store").alias("first"))
    x = s.join(first, "company")
    return x.select("id", F.coalesce(F.when(F.col("id") % 3 > 0, F.col("company")), "store").alias("company"), F.coalesce(F.when(F.col("id") % 4 > 0, F.col("store")), "first").alias("store"))


@query("SELECT id FROM goods WHERE (contains(lower(regexp_replace(name, '\\s+', '', 'g')), '삼겹') OR contains(lower(regexp_replace(supplier, '\\s+', '', 'g')), 'brand#1')) AND unit = 'box'")
def flt_multi_search(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).where(searched(("name", "supplier"), ("삼겹", "brand#1")) & (F.col("unit") == "box")).select("id")


def searched(columns: tuple[str, ...], words: tuple[str, ...]):
    """Whether any of the columns has its word, white space and case apart."""
    hit = F.lit(False)
    for c, w in zip(columns, words, strict=True):
        hit = hit | F.contains(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(w))
    return hit


@query("SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY name, supplier) AS n FROM goods) WHERE n > 1 AND unit = '돈육' AND price >= 950")
def flt_source_facets(spark: SparkSession, d: str) -> DataFrame:
    """Repeated source rows of one unit and a least price; repetition is counted by a join on the keys that repeat."""
    g = goods(spark, d)
    again = g.groupBy("name", "supplier").agg(F.count("*").alias("n")).where("n > 1").select("name", "supplier")
    return R.rest_scan(g.join(again, ["name", "supplier"], "left_semi"), ["id"], [("unit", "eq", "돈육"), ("price", "gte", 950)])


@query("SELECT id, CASE WHEN contains(t, '돈육') OR contains(t, '돼지') OR contains(t, '삼겹') OR contains(t, '전지') THEN '돼지' WHEN contains(t, '우육') OR contains(t, '한우') OR contains(t, '우') THEN '소' WHEN contains(t, '닭') THEN '닭' ELSE '기타' END AS species, CASE WHEN contains(name, '냉동') THEN '냉동' WHEN contains(name, '냉장') THEN '냉장' ELSE '미표기' END AS storage, unit = 'box' AS cost, CASE WHEN size > 20 THEN 'MAPPED' ELSE 'PENDING' END AS mapping FROM (SELECT *, unit || ' ' || name AS t FROM goods)")
def prj_source_row_normalise(spark: SparkSession, d: str) -> DataFrame:
    mapping = F.coalesce(F.when(F.col("size") > 20, "MAPPED"), F.lit("PENDING"))
    return goods(spark, d).select("id", N.species(F.col("unit"), F.col("name")).alias("species"), N.stated_storage(F.col("name")).alias("storage"), (F.col("unit") == "box").alias("cost"), mapping.alias("mapping"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS supplier, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS total FROM part")
def prj_document_map(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name their fields in either of two ways."""
    body = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("supplierName"), F.col("p_type").alias("supplier_name"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("total_amount")))
    either = lambda *keys: F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in keys))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), either("supplierName", "supplier_name").alias("supplier"), either("totalAmount", "total_amount").alias("total"))


@query("SELECT s_suppkey AS id, ['owner', 'manager', 'viewer', 'staff', 'staff'][s_suppkey % 5 + 1] AS role FROM supplier")
def prj_role_map(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("OWNER", "admin", "READ_ONLY", "clerk", ""))), (F.col("s_suppkey") % 5).cast("int"))
    r = F.lower(raw)
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(r == "owner", "owner").when(r.isin("admin", "manager"), "manager").when(r.isin("read_only", "viewer"), "viewer").otherwise("staff").alias("role"))


@query("SELECT p_partkey AS id, p_name AS name, p_size::DOUBLE AS quantity, CASE WHEN p_partkey % 2 = 0 THEN 'L' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 12, '7') END AS domestic, CASE WHEN p_partkey % 2 = 1 THEN lpad(CAST(p_partkey % 1000000 AS VARCHAR), 12, '7') END AS imported FROM part")
def prj_vision_normalise(spark: SparkSession, d: str) -> DataFrame:
    """A model's lines: trace numbers with L before them are domestic, others of imports."""
    k = F.lpad((F.col("p_partkey") % 1000000).cast("string"), 12, "7")
    body = F.to_json(F.struct(F.col("p_name").alias("productName"), F.format_number("p_size", 0).alias("qty"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("L-"), k)).otherwise(k).alias("trace")))
    x = F.from_json(body, "productName string, qty string, trace string")
    trace = T.trace_key(x["trace"])
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), x["productName"].alias("name"), T.money(x["qty"]).alias("quantity"), F.when(trace.startswith("L"), trace).alias("domestic"), F.when(~trace.startswith("L"), trace).alias("imported"))


@query("SELECT p_partkey AS doc, p_brand AS text, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size <= 1 THEN p_size * 100 ELSE p_size END ELSE p_size / 50.0 * 100 END::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'x', 50 FROM part WHERE p_partkey % 3 = 2")
def prj_provider_normalise(spark: SparkSession, d: str) -> DataFrame:
    p, share = read(spark, d, "part"), F.round(F.col("p_size") / 50, 2)
    word = lambda t, c, tn, cn: F.struct(t.alias(tn), c.cast("double").alias(cn))
    a = F.to_json(F.struct(F.array(word(F.col("p_brand"), F.col("p_size"), "text", "conf")).alias("words")))
    b = F.to_json(F.struct(F.array(word(F.col("p_brand"), share, "inferText", "inferConfidence")).alias("fields")))
    c = F.to_json(F.struct(F.array(F.struct(F.array(word(F.col("p_brand"), share, "t", "c"), word(F.lit("x"), F.lit(0.5), "t", "c")).alias("lines"))).alias("blocks")))
    k = F.col("p_partkey") % 3
    payload = p.select(F.col("p_partkey").alias("doc"), F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("provider"), F.when(k == 0, a).when(k == 1, b).otherwise(c).alias("body"))
    return R.provider_words(payload)


@query("SELECT p_partkey AS id, 2 AS items, p_name AS first, CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE p_size * 2 END AS score FROM part")
def prj_local_ocr_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Two shapes of a local reader's result: lines with a score, or a flat list without."""
    one = F.to_json(F.struct(F.struct(F.array("p_name", "p_brand").alias("lines"), F.lit(90).alias("score")).alias("result")))
    two = F.to_json(F.struct(F.array("p_name", "p_brand").alias("items"), (F.col("p_size") * 2).alias("confidence")))
    body = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two)
    x = F.from_json(body, "result struct<lines:array<string>,score:int>, items array<string>, confidence int")
    items = F.coalesce(x["result"]["lines"], x["items"])
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(items).alias("items"), F.get(items, F.lit(0)).alias("first"), F.coalesce(x["result"]["score"], x["confidence"]).alias("score"))
