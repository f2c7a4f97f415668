"""The same logical tables as adapters.py, as DuckDB common table expressions for the oracle queries."""

from stockloom.sources.adapters import GOODS, name_sql, token_sql

NAMES = ", ".join(f"'{x}'" for x in GOODS)
VIEWS = {
    "invoice_lines": """invoice_lines AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line, part) AS row, part, CASE WHEN part % 23 <> 0 THEN part % 40 + 1 END AS quantity, part % 9000 + 1000 AS price,
  (part % 40 + 1) * (part % 9000 + 1000) + CASE WHEN part % 11 = 0 THEN 5 ELSE 0 END AS amount, 60 + part % 41 AS confidence, CASE WHEN part % 4 > 0 THEN 'L' || lpad(CAST(part % 1000000 AS VARCHAR), 12, '7') ELSE '' END AS trace
  FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS line, CAST(l_partkey AS BIGINT) AS part FROM lineitem))""",
    "invoice_heads": """invoice_heads AS (SELECT o_orderkey AS doc, CASE WHEN o_custkey % 9 > 0 THEN 'S' || o_custkey END AS supplier, CASE WHEN o_orderkey % 8 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS invoice_date,
  CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(s, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END END AS supply, 0 AS tax, coalesce(CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(s, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END END, 0) + CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 0 END AS total,
  CASE WHEN o_orderkey % 6 > 0 THEN '123-45-67890' ELSE '1234567890' END AS business_no FROM orders LEFT JOIN (SELECT doc, sum(amount) AS s FROM invoice_lines GROUP BY 1) ON doc = o_orderkey)""",
    "goods": f"""goods AS (SELECT p_partkey AS id, [{NAMES}][p_partkey % {len(GOODS)} + 1] AS name, p_brand AS supplier, CASE p_size % 3 WHEN 0 THEN '돈육' WHEN 1 THEN '우육' ELSE 'box' END AS unit,
  CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) AS price, p_size AS size FROM part)""",
    "sales": """sales AS (SELECT event_id AS id, user_id % 3 AS company, user_id % 10 AS store, ts AS sold_at, CAST(ts AS DATE) AS sale_date,
  CASE event_type WHEN 'view' THEN 'STORE' WHEN 'click' THEN 'COUPANG' WHEN 'purchase' THEN 'BAEMIN' WHEN 'signup' THEN 'MEATBONGA' ELSE 'ETC' END AS channel,
  CAST(round(value, 2) AS DECIMAL(18,2)) AS amount, event_id % 17 = 0 AS is_cancelled, user_id % 7 = 0 AS needs_mapping, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code,
  '2' || lpad(CAST(user_id AS VARCHAR), 6, '0') || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100000 AS VARCHAR), 5, '0') || '0' AS barcode,
  CASE WHEN event_id % 2 = 0 THEN 'local-agent' ELSE 'web-scan' END AS source, 'T' || CASE WHEN event_id % 5 = 1 THEN event_id - 1 ELSE event_id END AS txn FROM events)""",
    "movements": """movements AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_suppkey % 3 AS company, l_suppkey % 10 AS store,
  CASE l_returnflag WHEN 'N' THEN 'OUT' WHEN 'R' THEN 'IN' ELSE 'ADJUST' END AS kind, p_name AS product, p_brand AS origin, s_name AS supplier, CAST(l_quantity AS DECIMAL(18,3)) AS qty,
  CAST(round(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS day, l_linestatus = 'O' AS is_active, CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN '판매취소 재고원복 T1' END AS memo, CAST(l_shipdate AS DATE) + p_size AS expiry
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "invoices": """invoices AS (SELECT o_orderkey AS doc, o_custkey % 3 AS company, o_custkey % 10 AS store, CASE WHEN o_orderstatus = 'F' THEN 'POSTED' ELSE 'DRAFT' END AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date, o_orderdate AS created_at, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS total FROM orders)""",
    "barcodes": """first_codes AS (SELECT p_partkey AS part, CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END AS key, p_name AS product, CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) AS price,
  ['MANUAL', 'PRICE_EMBED', 'WEIGHT_EMBED', 'FIXED'][p_size % 4 + 1] AS weigh, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10 END AS store, CAST(p_size AS BIGINT) AS updated FROM part),
  barcodes AS (SELECT * EXCLUDE part FROM first_codes UNION ALL SELECT key, product, CAST(price + 1 AS DECIMAL(18,2)), weigh, store, updated + 10 * (part % 3) - 10 FROM first_codes WHERE part % 4 = 1),
  mapped AS (SELECT * FROM barcodes QUALIFY row_number() OVER (PARTITION BY key, store ORDER BY updated DESC, price DESC, product) = 1)""",
    "learned_rules": f"learned_rules AS (SELECT {name_sql(True)[0]} FROM part)",
    "page_tokens": f"page_tokens AS (SELECT DISTINCT {token_sql(True)} FROM lineitem)",
    "asked_names": f"asked_names AS (SELECT {name_sql(True)[1]} FROM learned_rules)",
    "cards": """cards AS (SELECT o_orderkey AS id, c_mktsegment AS card, CAST(o_orderdate AS DATE) AS sale_date, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS lag,
  CAST(o_orderdate AS DATE) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS deposit_date, CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS amount,
  CAST(round(o_totalprice * 0.015, 2) AS DECIMAL(18,2)) AS fee, CASE WHEN o_orderkey % 3 = 0 THEN 'PAID' ELSE 'SCHEDULED' END AS status FROM orders JOIN customer ON o_custkey = c_custkey)""",
}


def over(sql: str) -> str:
    """sql behind the views that it names."""
    used = [v for k, v in VIEWS.items() if k in sql or k == "barcodes" and "mapped" in sql or k == "invoice_lines" and "invoice_heads" in sql or k == "learned_rules" and "asked_names" in sql]
    sql = sql.strip()
    if not used:
        return sql
    if sql.startswith(("WITH ", ",")):  # its own tables follow the views
        sql = "," + sql.removeprefix("WITH").removeprefix(",")
    return "WITH RECURSIVE " + ",\n".join(used) + "\n" + sql
