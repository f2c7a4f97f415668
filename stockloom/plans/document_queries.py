"""Queries of document checks, repair, merging and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.operators import documents as D
from stockloom.operators import stock as S
from stockloom.sources.adapters import goods, invoice_heads, invoice_lines, read, sales

from .registry import query

FLAGS = """flags AS (SELECT *, coalesce(quantity > 0, false) AND price > 0 AND amount > 0 AS whole FROM invoice_lines),
 sums AS (SELECT doc, count(*) AS lines, count(*) FILTER (NOT whole) AS holes, count(*) FILTER (NOT (whole AND coalesce(abs(quantity * price - amount) <= 1, false))) AS wrong, sum(amount) AS s, avg(confidence) AS ocr FROM flags GROUP BY 1),
 docs AS (SELECT h.doc, supplier, invoice_date, business_no, coalesce(supply, 0) AS supply, tax, total, coalesce(lines, 0) AS lines, coalesce(holes, 0) AS holes, coalesce(wrong, 0) AS wrong, coalesce(s, 0) AS s, coalesce(ocr, 0) AS ocr FROM invoice_heads h LEFT JOIN sums USING (doc)),
 coded AS (SELECT *, list_filter([CASE WHEN lines = 0 THEN 'NO_LINE_ITEMS' END, CASE WHEN holes > 0 THEN 'NUMERIC_FIELD_MISSING' END, CASE WHEN wrong > 0 THEN 'LINE_ITEM_AMOUNT_MISMATCH' END, CASE WHEN supply <= 0 THEN 'SUPPLY_AMOUNT_MISSING' END, CASE WHEN total <= 0 THEN 'TOTAL_AMOUNT_MISSING' END,
  CASE WHEN supply > 0 AND s > 0 AND s <> supply THEN 'SUPPLY_AMOUNT_MISMATCH' END, CASE WHEN total > 0 AND supply > 0 AND supply + tax <> total THEN 'TOTAL_AMOUNT_MISMATCH' END], lambda x: x IS NOT NULL) AS numeric FROM docs),
 judged AS (SELECT *, list_concat(numeric, list_filter([CASE WHEN NOT regexp_full_match(business_no, '[0-9]{3}-[0-9]{2}-[0-9]{5}') THEN 'BUSINESS_NO_FORMAT' END, CASE WHEN NOT regexp_full_match(invoice_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'INVOICE_DATE_FORMAT' END], lambda x: x IS NOT NULL)) AS issues,
  lines > 0 AND len(numeric) = 0 AS integrity, supply > 0 AND total > 0 AND abs(supply + tax - total) <= 1 AS totals_ok FROM coded),
 checked AS (SELECT *, CAST(floor(ocr * 0.25::DOUBLE + least(100, 60 + lines * 5) * 0.2::DOUBLE + CASE WHEN integrity THEN 100 ELSE 30 END * 0.25::DOUBLE + least(100, 33 * (CAST(supplier IS NOT NULL AS INTEGER) + 1 + CAST(total > 0 AS INTEGER))) * 0.15::DOUBLE + CASE WHEN supplier IS NOT NULL THEN 84 ELSE 44 END * 0.15::DOUBLE + 0.5) AS BIGINT) AS score,
  CASE WHEN totals_ok AND integrity THEN 'PASS' WHEN len(issues) > 0 THEN 'REVIEW' ELSE 'UNKNOWN' END AS status FROM judged)"""


def checked(spark: SparkSession, d: str) -> DataFrame:
    return D.validated(invoice_heads(spark, d), invoice_lines(spark, d))


@query(f"WITH {FLAGS} SELECT doc, lines, issues, integrity, totals_ok, integrity AND totals_ok AS posting FROM checked")
def doc_validate(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).drop("score", "status")


@query(f"WITH {FLAGS} SELECT doc, score FROM checked")
def doc_score(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select("doc", "score")


@query(f"WITH {FLAGS} SELECT status, count(*) AS n FROM checked GROUP BY 1")
def doc_status(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {FLAGS}, t AS (SELECT doc, count(*) FILTER (trace <> '') AS traces, count(*) FILTER (confidence >= 80) AS known FROM invoice_lines GROUP BY 1) SELECT doc, supplier IS NOT NULL AND total > 0 AND lines > 0 AS complete, integrity AS arithmetic, integrity AND totals_ok AS exact, coalesce(traces, 0) > 0 AS trace, CAST(CASE WHEN lines > 0 THEN floor(100 * known / lines + 0.5) ELSE 0 END AS BIGINT) AS matched, CASE WHEN lines > 0 THEN least(100, 70 + lines * 4) ELSE 0 END AS \"table\" FROM checked LEFT JOIN t USING (doc)")
def doc_vision_signals(spark: SparkSession, d: str) -> DataFrame:
    return D.signals(checked(spark, d), invoice_heads(spark, d), invoice_lines(spark, d), F.col("confidence") >= 80)


ROUTED = f"{FLAGS}, t AS (SELECT doc, count(*) FILTER (trace <> '') AS traces, count(*) FILTER (confidence >= 80) AS known FROM invoice_lines GROUP BY 1), routed AS (SELECT *, CASE WHEN lines > 0 THEN least(100, 70 + lines * 4) ELSE 0 END AS tab FROM checked LEFT JOIN t USING (doc))"


@query(f"WITH {ROUTED} SELECT doc, CASE WHEN integrity AND tab >= 95 THEN 'LOCAL_ACCEPT' WHEN doc % 4 > 0 AND tab >= 80 AND doc % 5000 < 3000 THEN 'SELECTIVE_COMPARE' WHEN (doc % 4 = 0 OR tab < 80) AND doc % 20000 * 0.01 <= 100 THEN 'EXTERNAL_LAYOUT_COMPARE' ELSE 'REVIEW_REQUIRED' END AS route FROM routed")
def doc_route_local(spark: SparkSession, d: str) -> DataFrame:
    s = D.signals(checked(spark, d), invoice_heads(spark, d), invoice_lines(spark, d), F.col("confidence") >= 80)
    doc = F.col("doc")
    return s.select("doc", D.local_route(F.col("table"), F.col("arithmetic"), doc % 4 == 0, F.lit(100), doc % 5000, doc % 20000, 0.01).alias("route"))


@query(f"WITH {ROUTED} SELECT doc, CASE WHEN supplier IS NOT NULL AND total > 0 AND lines > 0 AND integrity AND totals_ok AND coalesce(traces, 0) > 0 AND floor(100 * known / lines + 0.5) >= 80 THEN 'APPROVAL_CANDIDATE' WHEN doc % 2 = 0 THEN 'GEMINI_COMPARE' ELSE 'REVIEW_REQUIRED' END AS route FROM routed")
def doc_route_vision(spark: SparkSession, d: str) -> DataFrame:
    s = D.signals(checked(spark, d), invoice_heads(spark, d), invoice_lines(spark, d), F.col("confidence") >= 80)
    return s.select("doc", D.vision_route(*map(F.col, ("complete", "arithmetic", "exact", "trace", "matched")), F.col("doc") % 2 == 1).alias("route"))


@query(f"WITH {FLAGS} SELECT doc, CASE WHEN doc % 6 > 0 THEN supply END AS supply, CASE WHEN doc % 6 > 0 THEN total END AS total, CASE WHEN doc % 6 = 0 THEN CASE WHEN doc % 12 = 0 THEN ['PARTIAL_DOCUMENT', 'DOCUMENT_CROPPED'] ELSE ['PARTIAL_DOCUMENT'] END ELSE [] END AS reasons FROM invoice_heads")
def doc_completeness(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc")
    return D.withheld(invoice_heads(spark, d), {"PARTIAL_DOCUMENT": doc % 6 == 0, "DAMAGED_DOCUMENT": F.lit(False), "DOCUMENT_CROPPED": doc % 12 == 0}).select("doc", F.when(doc % 6 == 0, F.col("supply")).otherwise(F.col("supply")).alias("supply"), "total", "reasons")


#: Each line's required fields: a status that depends on line and field, sums derived.
FIELDS = ("species", "part", "productName", "grade", "condition", "unit", "quantity", "unitPrice", "supplyAmount", "taxAmount", "totalAmount", "traceOrImportNo")


def evidence_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines (doc, row, treatment, fields), fields as an array of (field, value, status, formula); statuses vary by part and field."""
    l = invoice_lines(spark, d)
    q = F.coalesce("quantity", F.lit(0))
    values = {
        "species": F.lit("소"), "part": F.lit("등심"), "productName": F.lit("등심"), "grade": F.when(F.col("part") % 19 != 0, "1"), "condition": F.lit("냉장"), "unit": F.lit("kg"), "quantity": q.cast("string"),
        "unitPrice": F.col("price").cast("string"), "supplyAmount": (q * F.col("price") + F.when(F.col("part") % 17 == 0, 800).otherwise(0)).cast("string"), "taxAmount": F.lit("0"), "totalAmount": (q * F.col("price") + F.when(F.col("part") % 17 == 0, 800).otherwise(0)).cast("string"), "traceOrImportNo": F.col("trace"),
    }
    status = {n: F.lit("OBSERVED") for n in values} | {n: F.lit("DERIVED") for n in D.DERIVABLE} | {"quantity": F.when(F.col("part") % 13 == 0, "INFERRED").otherwise("OBSERVED")}
    rows = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value"), status[n].alias("status"), F.when(status[n] == "DERIVED", "f").alias("formula")) for n, v in values.items()))
    return l.select("doc", "row", F.when(F.col("part") % 7 > 0, "EXEMPT").otherwise("TAXABLE").alias("treatment"), rows.alias("fields"))


EVIDENCE = """e AS (SELECT doc, row, part, coalesce(quantity, 0) AS q, coalesce(quantity, 0) * price + CASE WHEN part % 17 = 0 THEN 800 ELSE 0 END AS s, price, trace, part % 13 = 0 AS inf FROM invoice_lines),
 j AS (SELECT doc, row, s, list_concat(list_sort(list_filter([CASE WHEN part % 19 = 0 THEN 'REQUIRED_FIELD_MISSING:grade' END, CASE WHEN trace = '' THEN 'REQUIRED_FIELD_MISSING:traceOrImportNo' END, CASE WHEN inf THEN 'CRITICAL_FIELD_INFERRED:quantity' END], lambda x: x IS NOT NULL)),
  list_filter([CASE WHEN NOT (q > 0 AND abs(q * price - s) <= 1) THEN 'QUANTITY_UNIT_PRICE_SUPPLY_MISMATCH' END, CASE WHEN inf THEN 'DERIVED_EVIDENCE_NOT_PROVEN:supplyAmount' END, CASE WHEN part % 7 = 0 THEN 'DERIVED_EVIDENCE_NOT_PROVEN:taxAmount' END], lambda x: x IS NOT NULL)) AS issues FROM e)"""


@query(f"WITH {EVIDENCE} SELECT doc, row, issues, len(issues) = 0 AS posting FROM j")
def doc_evidence_map(spark: SparkSession, d: str) -> DataFrame:
    return D.line_evidence(evidence_fields(spark, d)).select("doc", "row", "issues", "posting")


@query(f"""WITH {EVIDENCE}, g AS (SELECT doc, count(*) AS lines, sum(len(issues)) AS n, sum(s) AS s FROM j GROUP BY 1) SELECT h.doc, coalesce(lines, 0) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS line_issues,
 list_filter([CASE WHEN lines IS NULL THEN 'NO_LINE_ITEMS' END, CASE WHEN supply IS NULL THEN 'DOCUMENT_TOTALS_MISSING' END, CASE WHEN abs(supply - s) > 1 THEN 'DOCUMENT_SUPPLY_SUM_MISMATCH' END, CASE WHEN abs(total - s) > 1 THEN 'DOCUMENT_TOTAL_SUM_MISMATCH' END], lambda x: x IS NOT NULL) AS issues,
 lines IS NOT NULL AND n = 0 AND supply IS NOT NULL AND abs(supply - s) <= 1 AND abs(total - s) <= 1 AS posting FROM invoice_heads h LEFT JOIN g USING (doc)""")
def doc_evidence_validate(spark: SparkSession, d: str) -> DataFrame:
    return D.evidence(D.line_evidence(evidence_fields(spark, d)), invoice_heads(spark, d))


#: Lines with a row of numbers read twice (every fifth document) or slipped (every seventh).
SLIPPED = """whole AS (SELECT doc, row, part, part % 40 + 1 AS quantity, price, (part % 40 + 1) * price AS amount, trace, confidence FROM invoice_lines),
 slipped AS (SELECT doc, row, 'N' || part AS name, CASE WHEN doc % 5 = 0 AND row >= 3 THEN lag(quantity) OVER w ELSE quantity END AS quantity, CASE WHEN doc % 5 = 0 AND row >= 3 THEN lag(price) OVER w ELSE price END AS price,
  CASE WHEN doc % 5 = 0 AND row >= 3 THEN lag(amount) OVER w WHEN doc % 7 = 0 AND row = 2 THEN coalesce(lead(amount) OVER w, amount) ELSE amount END AS amount, CASE WHEN doc % 5 = 0 AND row >= 3 THEN lag(trace) OVER w ELSE trace END AS trace, confidence FROM whole WINDOW w AS (PARTITION BY doc ORDER BY row))"""


def slipped(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("row")
    l = invoice_lines(spark, d).withColumn("quantity", F.col("part") % 40 + 1).withColumn("amount", (F.col("part") % 40 + 1) * F.col("price"))
    late = (F.col("doc") % 5 == 0) & (F.col("row") >= 3)
    back = lambda c: F.when(late, F.lag(c).over(w)).otherwise(F.col(c)).alias(c)
    amount = F.when(late, F.lag("amount").over(w)).when((F.col("doc") % 7 == 0) & (F.col("row") == 2), F.coalesce(F.lead("amount").over(w), "amount")).otherwise(F.col("amount")).alias("amount")
    return l.select("doc", "row", F.concat(F.lit("N"), "part").alias("name"), back("quantity"), back("price"), amount, back("trace"), "confidence")


@query(f"""WITH {SLIPPED}, m AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc) AS n, abs(quantity * price - amount) AS off FROM slipped WINDOW w AS (PARTITION BY doc ORDER BY row)),
 r AS (SELECT *, max(off) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 1 AS ok, coalesce((quantity, price, amount, trace) = lag((quantity, price, amount, trace)) OVER w, false) AS same, lead(amount) OVER w AS na FROM m WINDOW w AS (PARTITION BY doc ORDER BY row)),
 f AS (SELECT *, i > 1 AND i < n AND n >= 3 AND same AND ok AS t, i > 1 AND i < n AND n >= 3 AND abs(na - amount) <= 1 AND off > 1 AND lead(ok) OVER (PARTITION BY doc ORDER BY row) AS s FROM r),
 a AS (SELECT *, min(i) FILTER (t) OVER (PARTITION BY doc) AS ta, min(i) FILTER (s) OVER (PARTITION BY doc) AS sa FROM f),
 b AS (SELECT *, coalesce(i >= coalesce(ta, sa), false) AS moved, CASE WHEN ta IS NOT NULL THEN 'INSERTED_DUPLICATE_NUMERIC_ROW' WHEN sa IS NOT NULL THEN 'SHIFTED_NUMERIC_COLUMNS' END AS reason FROM a),
 c AS (SELECT doc, i AS row, name, CASE WHEN moved THEN lead(quantity) OVER w ELSE quantity END AS quantity, CASE WHEN moved THEN lead(price) OVER w ELSE price END AS price, CASE WHEN moved THEN lead(amount) OVER w ELSE amount END AS amount, CASE WHEN moved THEN lead(trace) OVER w ELSE trace END AS trace,
  CASE WHEN moved THEN least(80, confidence, lead(confidence) OVER w) ELSE confidence END AS confidence, reason, coalesce(ta, sa) IS NOT NULL AND i = n AS gone FROM b WINDOW w AS (PARTITION BY doc ORDER BY row))
 SELECT * EXCLUDE gone FROM c WHERE NOT gone""")  # fmt: skip
def doc_row_repair(spark: SparkSession, d: str) -> DataFrame:
    return D.repaired(slipped(spark, d))


@query(f"""WITH {SLIPPED}, m AS (SELECT doc, row, off, lead(amount) OVER w AS na, amount, (quantity, price, amount, trace) = lag((quantity, price, amount, trace)) OVER w AS same FROM (SELECT *, abs(quantity * price - amount) AS off FROM slipped) WINDOW w AS (PARTITION BY doc ORDER BY row))
 SELECT doc, row, CASE WHEN na IS NULL THEN amount ELSE na END AS next_amount FROM m WHERE coalesce(same, false)""")
def win_shift_repair(spark: SparkSession, d: str) -> DataFrame:
    """The rows that repeat the one before, with the amount that the row after offers."""
    return S.repeated_rows(slipped(spark, d), "doc", "row", ["quantity", "price", "amount", "trace"]).select("doc", "row", F.coalesce("next_amount", "amount").alias("next_amount"))


@query(f"WITH {SLIPPED} SELECT doc, row FROM (SELECT doc, row, (quantity, price, amount, trace) = lag((quantity, price, amount, trace)) OVER (PARTITION BY doc ORDER BY row) AS same FROM slipped) WHERE coalesce(same, false)")
def win_adjacent_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_rows(slipped(spark, d), "doc", "row", ["quantity", "price", "amount", "trace"]).select("doc", "row")


ISSUES = f"""{SLIPPED}, m AS (SELECT *, row_number() OVER w AS i, format('{{:.3f}}|{{:.2f}}|{{:.2f}}|{{}}', quantity::DOUBLE, price::DOUBLE, amount::DOUBLE, trace) AS sign FROM slipped WINDOW w AS (PARTITION BY doc ORDER BY row)),
 g AS (SELECT *, sum(CASE WHEN sign = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS run, sign = p AS twice FROM (SELECT *, lag(sign) OVER (PARTITION BY doc ORDER BY i) AS p FROM m)),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc, run ORDER BY i) AS pos FROM g)"""


@query(f"""WITH {ISSUES} SELECT doc, count(*) FILTER (abs(quantity * price - amount) > 1) AS wrong, count(*) FILTER (pos = 2) AS repeated, max(row) <> count(*) AS gap FROM k GROUP BY 1""")
def doc_row_issues(spark: SparkSession, d: str) -> DataFrame:
    l = slipped(spark, d).select("doc", F.col("row").alias("row_no"), "row", "quantity", F.col("price").alias("unit_price"), F.col("amount").alias("supply"), "trace", F.lit(0).alias("printed"))
    x = S.line_issues(l, "doc", ["row"], "printed")
    count = lambda p: F.size(F.filter("issues", lambda i: i.startswith(p))).cast("long")
    return x.select("doc", count("ROW_ARITHMETIC").alias("wrong"), count("ADJACENT").alias("repeated"), (count("ROW_NUMBER") > 0).alias("gap"))


@query("SELECT id, list_filter([CASE WHEN regexp_matches(name, '(^|\\s)(원산지|수량|중량|단가)(\\s|$|\\()') THEN 'PRODUCT_COLUMN_HEADER_CONTAMINATION' END, CASE WHEN regexp_full_match(name, '[\\s0-9,.+/원박스BOXkgKG-]+') THEN 'PRODUCT_COLUMN_NUMERIC_SHIFT' END, CASE WHEN regexp_full_match(name, '(?i)[0-9]*\\s*(box|kg|박스|팩|개)') THEN 'PRODUCT_COLUMN_UNIT_SHIFT' END, CASE WHEN id % 2 = 0 AND regexp_matches(name, '국내|미국산') THEN 'PRODUCT_COLUMN_ORIGIN_SHIFT' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT id, CASE id % 5 WHEN 0 THEN '수량 ' || name WHEN 1 THEN '12 box' WHEN 2 THEN '5,000원' ELSE name END AS name FROM goods)")
def doc_product_cell(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 5
    name = F.when(k == 0, F.concat(F.lit("수량 "), "name")).when(k == 1, "12 box").when(k == 2, "5,000원").otherwise(F.col("name"))
    return goods(spark, d).select("id", D.cell_issues(name, F.when(F.col("id") % 2 == 0, "국내산")).alias("issues"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'UNRESOLVED' WHEN id % 3 > 0 AND size >= 45 THEN 'AUTO_APPROVED' WHEN size >= 37.5 THEN 'SUGGESTED' ELSE 'UNRESOLVED' END AS decision FROM goods")
def er_product_decision(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", D.product_decision(F.col("id") % 7 != 0, F.col("size") / 50, F.col("id") % 3 == 0).alias("decision"))


#: A second reading of the same lines: some of other amounts or names, and one more line in every third document.
OTHER = """reading AS (SELECT doc, row, 'P' || part AS name, coalesce(quantity, 0) AS quantity, price, amount, confidence FROM invoice_lines),
 other AS (SELECT doc, row, 'Q' || part AS name, part % 40 + 1 AS quantity, price, (part % 40 + 1) * price AS amount, 130 - confidence AS confidence FROM invoice_lines UNION ALL SELECT doc, max(row) + 1, 'Qx', 1, 1000, 1000, 70 FROM invoice_lines WHERE doc % 3 = 0 GROUP BY doc)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Both readings of each line from one pass over the lines; of every third document the second one has a line more.

    Lines grow much wider here, so as many partitions as there are for shuffles take them: partitions joined by their bytes would be too large to sort in memory.
    """
    l = invoice_lines(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions")))
    l = l.withColumn("end", (F.col("row") == F.max("row").over(Window.partitionBy("doc"))) & (F.col("doc") % 3 == 0))
    q, one = F.col("part") % 40 + 1, F.lit(1).cast("long")
    line = lambda row, name, *numbers, second=True: F.struct(row.alias("row"), name.alias("name"), *(x.alias(c) for c, x in zip(("quantity", "price", "amount", "confidence"), numbers, strict=True)), F.lit(second).alias("second"))
    first = line(F.col("row"), F.concat(F.lit("P"), "part"), F.coalesce("quantity", F.lit(0)), F.col("price"), F.col("amount"), F.col("confidence"), second=False)
    other = line(F.col("row"), F.concat(F.lit("Q"), "part"), q, F.col("price"), q * F.col("price"), 130 - F.col("confidence"))
    more = line(F.col("row") + 1, F.lit("Qx"), one, one * 1000, one * 1000, one * 70)
    return l.select("doc", F.inline(F.when(F.col("end"), F.array(first, other, more)).otherwise(F.array(first, other))))


MET = f"{OTHER}, by_amount AS (SELECT doc, amount, min((row, name, quantity, price, confidence)) AS o FROM other WHERE amount > 0 GROUP BY 1, 2), met AS (SELECT r.*, coalesce(a.o[1], p.row) AS o_row, coalesce(a.o[2], p.name) AS o_name, coalesce(a.o[3], p.quantity) AS o_quantity, coalesce(a.o[4], p.price) AS o_price, CASE WHEN a.o IS NOT NULL THEN r.amount ELSE p.amount END AS o_amount, coalesce(a.o[5], p.confidence) AS o_confidence FROM reading r LEFT JOIN by_amount a ON a.doc = r.doc AND a.amount = r.amount LEFT JOIN other p ON p.doc = r.doc AND p.row = r.row)"


@query(f"WITH {MET} SELECT doc, row, o_row AS other_row, o_amount AS other_amount FROM met")
def jn_ensemble_align(spark: SparkSession, d: str) -> DataFrame:
    return D.aligned(readings(spark, d)).select("doc", "row", F.col("other.row").alias("other_row"), F.col("other.amount").alias("other_amount"))


@query(f"""WITH {MET}, u AS (SELECT *, quantity > 0 AND quantity * price = amount AS p_ok, o_quantity > 0 AND o_quantity * o_price = o_amount AS o_ok FROM met)
 SELECT doc, row, CASE WHEN o_confidence > confidence THEN o_name ELSE name END AS name, CASE WHEN o_ok AND NOT p_ok THEN o_quantity ELSE quantity END AS quantity, CASE WHEN o_ok AND NOT p_ok THEN o_price ELSE price END AS price, CASE WHEN o_ok AND NOT p_ok THEN o_amount ELSE amount END AS amount, greatest(confidence, o_confidence) AS confidence FROM u
 UNION ALL SELECT o.doc, o.row, name, quantity, price, amount, confidence FROM other o JOIN (SELECT doc, max(row) AS last FROM reading GROUP BY 1) USING (doc) WHERE o.row > last""")
def doc_ensemble_merge(spark: SparkSession, d: str) -> DataFrame:
    return D.ensemble(readings(spark, d))


RESULTS = "SELECT l_orderkey AS doc, CAST(l_suppkey AS BIGINT) AS provider, CAST(max(CASE WHEN l_quantity > 25 THEN 4 ELSE 0 END + CASE WHEN l_tax > 0.03 THEN 3 ELSE 0 END + 2 + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS INTEGER) AS rank, CAST(max(l_quantity * 2) AS BIGINT) AS score, count(*) AS lines, CAST(max(l_quantity) AS BIGINT) AS confidence FROM lineitem GROUP BY 1, 2"


def results(spark: SparkSession, d: str) -> DataFrame:
    r = D.rank(F.col("l_quantity") > 25, F.col("l_tax") > 0.03, F.lit(1), F.when(F.col("l_discount") > 0.05, 0).otherwise(1))
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").cast("long").alias("provider"))
    return g.agg(F.max(r).alias("rank"), F.max(F.col("l_quantity") * 2).cast("long").alias("score"), F.count("*").alias("lines"), F.max("l_quantity").cast("long").alias("confidence"))


@query(f"SELECT doc, rank, score, lines, provider, score < 92 OR lines = 0 OR rank < 4 AS again FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank DESC, score DESC, lines DESC, confidence DESC, provider) AS k FROM ({RESULTS})) WHERE k = 1")
def doc_better_result(spark: SparkSession, d: str) -> DataFrame:
    return D.best_results(results(spark, d), "doc")


@query(f"SELECT doc, provider, k FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank DESC, score DESC, lines DESC, confidence DESC, provider) AS k FROM ({RESULTS})) WHERE k <= 2")
def srt_validation_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy(F.desc("rank"), F.desc("score"), F.desc("lines"), F.desc("confidence"), "provider")
    return results(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 2").select("doc", "provider", "k")


@query("SELECT p_partkey AS id, list_filter([CASE WHEN p_size * 2 < 35 THEN 'LOW_QUALITY' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 900 < 500 THEN 'LOW_RESOLUTION' END, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 90 < 45 THEN 'LOW_BRIGHTNESS' END], lambda x: x IS NOT NULL) AS reasons, CASE WHEN p_size * 2 < 35 OR p_partkey % 3 = 0 AND p_partkey % 900 < 500 OR p_partkey % 5 = 0 AND p_partkey % 90 < 45 THEN 'RECAPTURE_PATH' WHEN p_size * 2 >= 85 THEN 'AUTO_PATH' ELSE 'REVIEW_PATH' END AS path FROM part")
def doc_intake_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    warnings = F.array_compact(F.array(F.when(k % 3 == 0, "LOW_RESOLUTION"), F.when(k % 5 == 0, "LOW_BRIGHTNESS")))
    x = D.intake(F.col("p_size") * 2, warnings, {"width": F.lit(2000), "height": k % 900, "brightness": k % 90, "contrast": F.lit(50), "dark": F.lit(0), "edges": F.lit(9)})
    return read(spark, d, "part").select(k.alias("id"), x.alias("x")).select("id", "x.*")


@query("SELECT doc, row, amount, CASE WHEN part % 5 = 0 THEN 'C' || part ELSE 'N' || part END AS name, CASE WHEN part % 5 = 0 THEN greatest(confidence, 95) ELSE confidence END AS confidence, part % 5 = 0 AS stabilised FROM invoice_lines")
def doc_stabilize(spark: SparkSession, d: str) -> DataFrame:
    l = invoice_lines(spark, d)
    key = F.concat(F.lit("S"), "part").alias("supplier")
    lines = l.select("doc", "row", key, F.coalesce("quantity", F.lit(0)).alias("quantity"), "price", "amount", F.concat(F.lit("N"), "part").alias("name"), "confidence")
    known = l.where("part % 5 = 0").select(key, F.coalesce("quantity", F.lit(0)).alias("quantity"), "price", "amount", F.concat(F.lit("C"), "part").alias("product"))
    return D.stabilised(lines, known).select("doc", "row", "amount", "name", "confidence", "stabilised")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'SMART_ZOOM_UNRESOLVED' WHEN id % 3 = 0 THEN 'SMART_ZOOM_SUGGESTED' ELSE 'SMART_ZOOM_VERIFIED' END AS source, CASE WHEN id % 4 > 0 AND id % 3 = 0 THEN name || ' 특' END AS suggestion, id % 4 = 0 OR id % 3 = 0 AS review FROM goods")
def doc_zoom_merge(spark: SparkSession, d: str) -> DataFrame:
    zoom = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" 특"))).otherwise(F.concat("name", F.lit(" ")))
    x = D.zoomed(F.col("name"), zoom, F.lit(0.97), F.when(F.col("id") % 4 > 0, "READABLE").otherwise("PARTIAL"))
    return goods(spark, d).select("id", x.alias("x")).select("id", "x.*")


@query("SELECT id, CASE WHEN f <> id THEN f END AS duplicate_of FROM (SELECT id, first_value(id) OVER (PARTITION BY code, sale_date, amount ORDER BY sold_at, id) AS f FROM sales)")
def doc_duplicate_mark(spark: SparkSession, d: str) -> DataFrame:
    return D.marked_duplicates(sales(spark, d), ["code", "sale_date", "amount"], ["sold_at"], "id").select("id", "duplicate_of")


@query("SELECT id, CASE WHEN size < 5 AND price < 1000 THEN ['TOO_SMALL', 'TOO_CHEAP'] WHEN size < 5 THEN ['TOO_SMALL'] WHEN price < 1000 THEN ['TOO_CHEAP'] WHEN k > 1 THEN ['DUPLICATE_CONTENT_HASH'] ELSE [] END AS errors FROM (SELECT *, row_number() OVER (PARTITION BY name, size, size < 5 OR price < 1000 ORDER BY id) AS k FROM goods)")
def doc_corpus_validate(spark: SparkSession, d: str) -> DataFrame:
    return D.eligible(goods(spark, d), {"TOO_SMALL": F.col("size") < 5, "TOO_CHEAP": F.col("price") < 1000}, F.sha2(F.concat_ws("|", "name", "size"), 256)).select("id", "errors")


@query("SELECT doc, row, 'P ' || part AS name, CAST(part % 40 + 1 AS DOUBLE) AS quantity, CASE WHEN part % 2 = 0 THEN 'box' ELSE 'kg' END AS unit, CAST(price AS DOUBLE) AS price, CAST(amount AS DOUBLE) AS amount FROM invoice_lines WHERE part % 3 > 0")
def doc_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines, of which every third lacks its numbers."""
    l, q = invoice_lines(spark, d), (F.col("part") % 40 + 1).cast("string")
    text = F.concat_ws(" ", F.lit("P"), F.col("part").cast("string"), q, F.when(F.col("part") % 2 == 0, "box"), F.format_number("price", 0), F.format_number("amount", 0))
    line = F.when(F.col("part") % 3 > 0, text).otherwise(F.concat_ws(" ", F.lit("합계 금액은 없음"), q))
    return l.select("doc", "row", F.inline(D.parsed_lines(line)))


@query("SELECT doc, row, CAST(CASE WHEN part % 2 = 0 THEN 7 ELSE part % 40 + 1 END AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price, CAST(amount AS DOUBLE) AS amount FROM invoice_lines")
def doc_region_items(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("part") % 2 == 0, "수량 3 / 7").otherwise("")
    both = F.concat((F.col("part") % 40 + 1).cast("string"), F.lit(" x "), F.format_number("price", 0))
    return invoice_lines(spark, d).select("doc", "row", D.region_item(both, q, F.lit(""), F.concat(F.lit("1 "), F.format_number("amount", 0))).alias("x")).select("doc", "row", "x.*")


@query("WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS page, CAST(sum(round(l_extendedprice)) AS BIGINT) AS subtotal, CAST(max(l_suppkey % 3) * 1000 AS BIGINT) AS displayed FROM lineitem GROUP BY 1, 2) SELECT doc, count(*) AS pages, CAST(sum(subtotal) AS DOUBLE) AS actual FROM s GROUP BY 1")
def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return S.page_summary(g.agg(F.sum(F.round("l_extendedprice")).cast("long").alias("subtotal"), (F.max(F.col("l_suppkey") % 3) * 1000).cast("long").alias("displayed")), "doc").select("doc", "pages", "actual")
