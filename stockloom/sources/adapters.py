"""Logical tables over the given Parquet tables: sales, stock movements, invoices, deliveries, cards, barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types and the sales channels they stand for.
CHANNELS = {"view": "STORE", "click": "COUPANG", "purchase": "BAEMIN", "signup": "MEATBONGA"}
WEIGH = ("MANUAL", "PRICE_EMBED", "WEIGHT_EMBED", "FIXED")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(x: Column | str) -> Column:
    """Two decimals, half away from zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 2).cast("decimal(18,2)")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    channel = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in CHANNELS.items()), F.lit("ETC"))
    code = F.lpad(F.col("user_id").cast("string"), 6, "0")
    cents = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(100000))
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("company"), (F.col("user_id") % 10).alias("store"), F.col("ts").alias("sold_at"), F.to_date("ts").alias("sale_date"),
        channel.alias("channel"), money("value").alias("amount"), (F.col("event_id") % 17 == 0).alias("is_cancelled"), (F.col("user_id") % 7 == 0).alias("needs_mapping"),
        code.alias("code"), F.concat(F.lit("2"), code, F.lpad(cents.cast("string"), 5, "0"), F.lit("0")).alias("barcode"),
        F.when(F.col("event_id") % 2 == 0, "local-agent").otherwise("web-scan").alias("source"),
        F.concat(F.lit("T"), F.when(F.col("event_id") % 5 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))).alias("txn"),
    )


def movements(spark: SparkSession, sf_dir: str, supplier: bool = False) -> DataFrame:
    """Stock movements; the supplier's name only where it is asked for, as an inner join is paid for even if nothing of it is used."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product"), F.col("p_brand").alias("origin"), "p_size")
    l = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    if supplier:
        l = l.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier")), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_returnflag") == "N", "OUT").when(F.col("l_returnflag") == "R", "IN").otherwise("ADJUST")
    day = F.to_date("l_shipdate")
    return l.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("company"), (F.col("l_suppkey") % 10).alias("store"), kind.alias("kind"),
        "product", "origin", *(["supplier"] if supplier else []), F.col("l_quantity").cast("decimal(18,3)").alias("qty"), money(money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("amount"), day.alias("day"),
        (F.col("l_linestatus") == "O").alias("is_active"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3), "판매취소 재고원복 T1").alias("memo"), F.date_add(day, F.col("p_size")).alias("expiry"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 3).alias("company"), (F.col("o_custkey") % 10).alias("store"), F.when(F.col("o_orderstatus") == "F", "POSTED").otherwise("DRAFT").alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("invoice_date"), F.col("o_orderdate").alias("created_at"), money("o_totalprice").alias("total"),
    )


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of item keys, for one store or (null) for all; some were made a second time, with another price."""
    kind = F.element_at(F.array(*map(F.lit, WEIGH)), F.col("p_size") % 4 + 1)
    code = F.col("p_partkey").cast("string")
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code).alias("key"), F.col("p_name").alias("product"), money("p_retailprice").alias("price"),
        kind.alias("weigh"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 10).alias("store"), F.col("p_size").cast("long").alias("updated"),
    )
    again = p.where("part % 4 = 1").withColumn("price", (F.col("price") + 1).cast("decimal(18,2)")).withColumn("updated", F.col("updated") + 10 * (F.col("part") % 3) - 10)
    return p.unionByName(again).drop("part")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("card"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lag = F.substring("o_orderpriority", 1, 1).cast("int")
    fee = money(F.col("o_totalprice") * 0.015)
    return o.select(F.col("o_orderkey").alias("id"), "card", F.to_date("o_orderdate").alias("sale_date"), lag.alias("lag"), F.date_add(F.to_date("o_orderdate"), lag).alias("deposit_date"), money("o_totalprice").alias("amount"), fee.alias("fee"), F.when(F.col("o_orderkey") % 3 == 0, "PAID").otherwise("SCHEDULED").alias("status"))


#: Raw product names as suppliers print them; parts take them in turn.
GOODS = (
    "냉장 삼겸 국내산", "미박 삼겹살(국내)", "넥장 황창 [A]", "소목심 1++ 한우", "돼지갈비 냉동", "항정살　냉동", "등갈비 BOX", "우삼겹 미국산", "미빅 앞다리살", "박피 뒷다리", "채끝살 한우", "부체살",
    "닭가슴살 ２kg", "가브릿살", "계육다리살", "오겹살 냉장", "목심", "다짐육", "특수 안심", "양념 갈비 소스", "frozen belly", "LA갈비 100g", "뽈살", "사골 5,000원",
)


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names as they were read: id, name, supplier, unit, price, size."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.get(F.array(*map(F.lit, GOODS)), (F.col("p_partkey") % len(GOODS)).cast("int")).alias("name"), F.col("p_brand").alias("supplier"),
        F.when(F.col("p_size") % 3 == 0, "돈육").when(F.col("p_size") % 3 == 1, "우육").otherwise("box").alias("unit"), money("p_retailprice").alias("price"), F.col("p_size").alias("size"),
    )


def invoice_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Lines as they were read from documents: doc, row, part, quantity (some missing), price, amount (some wrong), confidence, trace; dealt out to so many partitions."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("long").alias("part")).repartition(*([parts] if parts else []), "doc").distinct()  # dealt out once, for the window too
    part, number = F.col("part"), F.row_number().over(Window.partitionBy("doc").orderBy("line", "part"))
    quantity, price = part % 40 + 1, part % 9000 + 1000
    return l.select(
        "doc", number.cast("long").alias("row"), "part", F.when(part % 23 != 0, quantity).alias("quantity"), price.alias("price"), (quantity * price + F.when(part % 11 == 0, 5).otherwise(0)).alias("amount"),
        (60 + part % 41).alias("confidence"), F.when(part % 4 > 0, F.concat(F.lit("L"), F.lpad((part % 1000000).cast("string"), 12, "7"))).otherwise("").alias("trace"),
    )


def invoice_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents say about themselves: doc, supplier, invoice_date, supply, tax, total, business_no; some of it missing or wrong."""
    sums = invoice_lines(spark, sf_dir).groupBy("doc").agg(F.sum("amount").alias("s"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("day")).join(sums, "doc", "left")
    doc, s = F.col("doc"), F.coalesce("s", F.lit(0))
    supply = F.when(doc % 13 != 0, s + F.when(doc % 5 == 0, 100).otherwise(0))
    return o.select(
        "doc", F.when(F.col("c") % 9 > 0, F.concat(F.lit("S"), "c")).alias("supplier"), F.when(doc % 8 > 0, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy/MM/dd")).alias("invoice_date"),
        supply.alias("supply"), F.lit(0).cast("long").alias("tax"), (F.coalesce(supply, F.lit(0)) + F.when(doc % 7 == 0, 9).otherwise(0)).alias("total"),
        F.when(doc % 6 > 0, "123-45-67890").otherwise("1234567890").alias("business_no"),
    )


#: Words that product names are put together from, with the cut and category that each third one means.
STORED = ("", "냉장 ", "냉동 ", "")
MARKS = ("", "한돈 ", "한우 ", "국내산 ", "무항생제 ", "제주 ", "숙성 ")
PIECES = (
    "삼겹살", "목살", "앞다리살", "뒷다리살", "항정살", "가브리살", "갈매기살", "등심", "안심", "등갈비", "쪽갈비", "돼지갈비",
    "차돌박이", "부채살", "채끝", "우삼겹", "사태", "도가니", "사골", "우족", "닭가슴살", "닭다리살", "오겹살", "이겹살",
)
USES = ("", " 구이용", " 찌개용", " 수육용", " 불고기", " 슬라이스", " 통덩이", " 칼집", " 양념")


def picked(words: tuple[str, ...], place: str, duck: bool) -> str:
    """SQL for the word at a place counted from 0, for Spark or DuckDB."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_value({listed})[CAST({place} AS INT) + 1]" if duck else f"element_at(array({listed}), CAST({place} AS INT) + 1)"


def name_sql(duck: bool) -> tuple[str, str]:
    """Select lists over part for learned rules and for names that are asked for: the latter are sources of rules, as they are, misread, cut short, with a vendor's name or by another supplier."""
    k = "p_partkey"
    more = f"CAST(floor({k} / 504) AS BIGINT)"
    source = " || ".join((picked(STORED, f"{k} * 7 % 4", duck), picked(MARKS, f"({k} * 13 + {more}) % 7", duck), picked(PIECES, f"{k} * 5 % 24", duck), picked(USES, f"({k} * 11 + {more}) % 9", duck), f"CASE WHEN {k} % 4 = 0 THEN ' ' || CAST({k} % 97 AS STRING) || '호' ELSE '' END"))
    target = f"CASE WHEN {k} % 10 = 0 THEN {picked(PIECES, f'({k} + 1) * 5 % 24', duck)} ELSE {picked(PIECES, f'{k} * 5 % 24', duck)} END"
    kind = f"CASE WHEN {k} * 5 % 24 IN (0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 22, 23) THEN '돼지고기' WHEN {k} * 5 % 24 IN (20, 21) THEN '닭고기' ELSE '소고기' END"
    rule = f"{k} AS id, CASE WHEN {k} % 3 > 0 THEN 'S' || CAST({k} % 25 AS STRING) END AS supplier, {source} AS source, {target} AS target, {kind} AS category, {picked(('냉장', '냉동', ''), f'{k} % 3', duck)} AS storage, {k} % 600 AS priority, 80 + {k} % 20 AS confidence, {k} % 1200 AS success, {k} % 400 AS day"
    n = "length(source)"
    asked = f"id, CASE WHEN id % 6 < 5 THEN 'S' || CAST((id + CASE WHEN id % 12 = 4 THEN 1 ELSE 0 END) % 25 AS STRING) END AS supplier, CASE id % 6 WHEN 1 THEN left(source, {n} - 2) || '쌀' || substr(source, {n}) WHEN 2 THEN left(source, CAST(floor({n} / 2) AS INT)) || substr(source, CAST(floor({n} / 2) AS INT) + 2) WHEN 3 THEN source || ' 농협 LPC' || CAST(id % 7 AS STRING) ELSE source END AS name, CASE WHEN id % 9 = 0 THEN '돈육' END AS hint"
    return rule, asked


#: What a token of a page says: headers of a table, or numbers.
SAYS = ("품명", "수량", "단 가", "금액", "공급가액", "이력번호(묶음)", "부위명", "등급", "비고", "규격", "합", "QTY")


def token_sql(duck: bool) -> str:
    """Select list over lineitem for the tokens of pages: every eighth order's lines share a page, whose header stands at two heights."""
    k, n = "l_orderkey", "l_linenumber"
    head = f"(l_partkey + {n}) % 12"
    kind = f"{k} % 3 = 0"
    return f"CAST(floor({k} / 8) AS BIGINT) AS doc, (({k} * 10 + {n}) * 100000 + l_partkey) * 10000 + l_suppkey AS id, CASE WHEN {kind} THEN {picked(SAYS, head, duck)} ELSE CAST(l_partkey AS STRING) END AS text, l_suppkey * 37 % 900 AS x, CASE WHEN {kind} THEN 40 + l_suppkey % 2 * 260 + l_partkey % 5 * 4 ELSE l_partkey * 7919 % 400 END AS y, CAST(l_quantity AS BIGINT) % 40 + 10 AS w, l_partkey % 30 + 5 AS h, 60 + l_partkey % 41 AS confidence"


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as a reader of pages gives them: doc, id, text, x, y, w, h, confidence."""
    return read(spark, sf_dir, "lineitem").selectExpr(*split_list(token_sql(False))).distinct()


def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned names: id, supplier (null: for all), source, target, category, storage, priority, confidence, success, day."""
    return read(spark, sf_dir, "part").selectExpr(*split_list(name_sql(False)[0]))


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as suppliers print them: id, supplier, name, hint (of the category)."""
    return learned_rules(spark, sf_dir).selectExpr(*split_list(name_sql(False)[1]))


def split_list(items: str) -> list[str]:
    """The items of a select list: commas within brackets and quotes don't divide."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(items):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(items[start:i])
            start = i + 1
    return [*out, items[start:]]
