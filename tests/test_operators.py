"""Golden values and edge cases of the operators."""

import datetime
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from stockloom.functions import names as N
from stockloom.functions import scalars as S
from stockloom.functions import texts as T
from stockloom.operators import delivery as V
from stockloom.operators import documents as D
from stockloom.operators import ledger as L
from stockloom.operators import posting as P
from stockloom.operators import resolution as E
from stockloom.operators import stock as K
from stockloom.operators import summaries as M
from stockloom.operators.neighbours import similar_pairs
from stockloom.plans.document_queries import readings
from stockloom.sources import readers as R
from stockloom.streaming import capture as C


def test_allocation_gives_the_residual_to_the_last_line(spark):
    rows = [(1, i, Decimal(w), Decimal(100)) for i, w in enumerate((33, 33, 34))] + [(2, i, Decimal(1), Decimal(100)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc int, line int, w decimal(18,2), total decimal(18,2)")
    got = {(r.doc, r.line): r.allocated for r in L.allocate(df, "doc", ["line"], "w", "total").collect()}
    assert [got[1, i] for i in range(3)] == [33, 33, 34]
    assert [got[2, i] for i in range(3)] == [Decimal("33.33"), Decimal("33.33"), Decimal("33.34")]


def test_barcode_parts(spark):
    r = spark.createDataFrame([("2090120240002",), ("123",)], "b string").select(S.item_key(F.col("b")).alias("k"), S.embedded_value(F.col("b")).alias("v")).collect()
    assert (r[0].k, r[0].v) == ("090120", 24000) and r[1].k is None


def test_js_round_goes_up(spark):
    assert spark.range(1).select(S.js_round(F.lit(-2.5)).alias("x")).first().x == -2


def test_demand_and_safety_stock(spark):
    d = spark.createDataFrame([("a", 4.0 + i % 3, datetime.date(2024, 1, 1) + datetime.timedelta(i)) for i in range(56)], "code string, sold double, sale_date date")
    s = K.demand_stats(d, ["code"], "2024-02-25")
    base = s.withColumns({"on_hand": F.lit(1.0), "waste": F.lit(0.0), "pack": F.lit(5.0), "moq": F.lit(0.0), "stock_confidence": F.lit(0.95), "lead_samples": F.lit(25)})
    r = K.safety_stock(base, "F1_CORE_FRESH").first()
    assert r.action == "ORDER" and r.recommended % 5 == 0 and r.target >= r.reorder_point
    assert K.safety_stock(base.withColumns({"on_hand": F.lit(30.0), "waste": F.lit(5.0)}), "F1_CORE_FRESH").first().action == "REDUCE"


def test_yield_learns_from_balanced_rows_only(spark):
    cols = "k string, input double, output double, byproduct double, loss double"
    r = K.yield_profile(spark.createDataFrame([("a", 20.0, 18.0, 1.0, 1.0)] * 30 + [("b", 20.0, 10.0, 0.0, 0.0)], cols), ["k"], "TRIM_STANDARD").collect()
    got = {x.k: x for x in r}
    assert got["a"].n == 30 and got["a"].source == "STORE_LEARNED" and 0.88 < got["a"].rate <= 0.90
    assert got["b"].n == 0 and got["b"].source == "PRIOR"


INVOICE = [(36.0, 5300.0, 190800.0, "L1"), (5.8, 31000.0, 179800.0, "L2"), (10.3, 7700.0, 79310.0, "L3")]


def issues(spark, rows, printed):
    data = [("d", i, i, q, p, s, t, printed) for i, (q, p, s, t) in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "doc string, pos int, row_no int, quantity double, unit_price double, supply double, trace string, printed int")
    return K.line_issues(df, "doc", ["pos"], "printed").first().issues


def test_invoice_rows(spark):
    assert issues(spark, INVOICE, 3) == []
    assert issues(spark, [*INVOICE, INVOICE[2]], 3) == ["PRINTED_LINE_COUNT_MISMATCH:3:4", "ADJACENT_ROW_VALUE_DUPLICATE:3:4"]
    assert issues(spark, [(36.0, 5300.0, 180000.0, None)], 0) == ["ROW_ARITHMETIC_MISMATCH:1"]


def test_pages(spark):
    pages = spark.createDataFrame([("d", i, s, 500000) for i, s in enumerate((100000, 120000, 80000, 90000, 110000), 1)], "doc string, page int, subtotal long, displayed long")
    r = K.page_summary(pages, "doc").first()
    assert (r.pages, r.actual, r.displayed_sum, r.repeated) == (5, 500000, 2500000, 500000)


def test_sanitation(spark):
    r = spark.createDataFrame([([1] * 10,), ([2] * 10,), ([3] * 10,), ([1] * 8 + [3, 2],)], "r array<int>").select(K.sanitation_score(F.col("r")).alias("s")).collect()
    assert [x.s for x in r] == [100, 50, 10, 86]


def test_refused_sales_take_nothing(spark):
    sales = spark.createDataFrame([(1, 1, "p", "a", 5.0, 1), (2, 1, "p", "b", 3.0, 2), (3, 1, "p", "c", 1.0, 3), (4, 1, "p", "c", 1.0, 4)], "id long, store int, product string, txn string, quantity double, sold_at int")
    stock = spark.createDataFrame([(1, "p", 6.0)], "store int, product string, available double")
    got = {r.id: (r.status, r.left) for r in V.till_sales(sales, stock).collect()}
    assert got == {1: ("SOLD", 1.0), 2: ("INSUFFICIENT_STOCK", 1.0), 3: ("SOLD", 0.0), 4: ("DUPLICATE_EVENT", 0.0)}


def mappings(spark):
    rows = [("000001", "old", 10, "FIXED", None, 1), ("000001", "new", 12, "FIXED", None, 2), ("000001", "own", 11, "FIXED", 7, 1), ("000001", "own2", 13, "FIXED", 7, 3), ("000001", "other", 9, "FIXED", 8, 9)]
    return spark.createDataFrame([(k, p, Decimal(c), w, s, u) for k, p, c, w, s, u in rows], "key string, product string, price decimal(18,2), weigh string, store int, updated int")


def test_a_store_takes_its_last_mapping(spark):
    events = spark.createDataFrame([(1, 1, "t1", 7, "000001", "2000001012340", 1), (2, 1, "t2", 5, "000001", "2000001012340", 2)], "id int, company int, txn string, store int, code string, barcode string, sold_at int")
    got = {r.id: r.product for r in L.scan_sale(events, mappings(spark)).collect()}
    assert got == {1: "own2", 2: "new"}
    pending = events.withColumn("amount", F.lit(Decimal(26)))
    assert {(r.id, r.product, r.quantity) for r in P.apply_mapping(pending, mappings(spark)).collect()} == {(1, "own2", 2.0), (2, "new", 2.167)}


def test_delivery_orders_post_whole_or_not_at_all(spark):
    orders = spark.createDataFrame([("ord-1", 7, "COUPANG", Decimal(100), 1), ("ord-1", 7, "COUPANG", Decimal(100), 2), ("ord-2", 7, "COUPANG", Decimal(50), 3), ("ord-3", 7, "COUPANG", Decimal(0), 4), ("o", 7, "COUPANG", Decimal(1), 5)], "order_id string, store int, channel string, amount decimal(18,2), at int")
    one = spark.createDataFrame([("ord-1", 1, "000001", "000001", None, None), ("ord-1", 2, "000001", "000001", None, None), ("ord-2", 1, "000001", "000001", None, None), ("ord-3", 1, "zzz", "a/b", None, None)], "order_id string, line_no int, code string, barcode string, quantity decimal(18,3), amount decimal(18,2)")
    stock = spark.createDataFrame([(7, "own2", Decimal(2))], "store int, product string, available decimal(18,3)")
    o, lines = V.fulfilled(orders, one, mappings(spark), stock)
    assert sorted((r.order_id, r.at, r.error) for r in o.collect()) == [("o", 5, "DELIVERY_ORDER_ID_REQUIRED"), ("ord-1", 1, None), ("ord-1", 2, "DUPLICATE_DELIVERY_ORDER"), ("ord-2", 3, "INSUFFICIENT_STOCK_LINE_1_AVAILABLE_0.000"), ("ord-3", 4, "DELIVERY_ORDER_AMOUNT_REQUIRED")]
    assert sorted((r.order_id, r.line_no, r.amount) for r in lines.collect()) == [("ord-1", 1, 50.0), ("ord-1", 2, 50.0)]


def test_a_refused_order_takes_nothing(spark):
    rnd, orders, lines = random.Random(3), [], []
    products = [f"p{k}" for k in range(5)]
    maps = spark.createDataFrame([(f"00000{k}", p, Decimal(10), "MANUAL", None, 1) for k, p in enumerate(products)], "key string, product string, price decimal(18,2), weigh string, store int, updated int")
    for o in range(300):
        orders.append((1000 + o, o % 3, "COUPANG", Decimal(100), o // 2))
        for line in range(1, rnd.randint(2, 4)):
            lines.append((1000 + o, line, f"00000{rnd.randrange(5)}", "123456", Decimal(rnd.randint(1, 9)), Decimal(5)))
    have = {(s, p): Decimal(rnd.choice([0, 40, 150, 5000])) for s in range(3) for p in products}
    stock = spark.createDataFrame([(*k, v) for k, v in have.items()], "store int, product string, available decimal(18,3)")
    left, want, posted = dict(have), {}, set()
    for o, s, _, _, _ in sorted(orders, key=lambda x: (x[4], x[0])):
        mine, error = {}, None
        for _, n, code, _, q, _ in sorted(x for x in lines if x[0] == o):
            at = (s, f"p{code[-1]}")
            rest = left[at] - mine.get(at, 0)
            if error is None and rest < q:
                error = f"INSUFFICIENT_STOCK_LINE_{n}_AVAILABLE_{rest:.3f}"
            mine[at] = mine.get(at, 0) + q
        want[o] = error
        if error is None:
            posted |= {(x[0], x[1]) for x in lines if x[0] == o}
            for at, q in mine.items():
                left[at] -= q
    o, done = V.fulfilled(spark.createDataFrame(orders, "order_id int, store int, channel string, amount decimal(18,2), at int"), spark.createDataFrame(lines, "order_id int, line_no int, code string, barcode string, quantity decimal(18,3), amount decimal(18,2)"), maps, stock)
    assert {r.order_id: r.error for r in o.collect()} == want and {(r.order_id, r.line_no) for r in done.collect()} == posted
    assert 20 < sum(e is None for e in want.values()) < 290


def test_similar_pairs_lose_none(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("가나다ab") for _ in range(rnd.randint(1, 24))) for _ in range(40)]

    def changed(w):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("가나다ab") + w[i:], w[:i] + rnd.choice("가나다ab") + w[i + 1 :]]) or "x"
        return w

    a = spark.createDataFrame([(x,) for x in [changed(rnd.choice(base)) for _ in range(300)] + ["", None]], "a string")
    b = spark.createDataFrame([(x,) for x in base + [changed(rnd.choice(base)) for _ in range(150)] + ["", None]], "b string")
    for least in (E.least_similarity, lambda n: F.lit(0.7)):
        both = a.distinct().crossJoin(b.distinct()).where("a <> '' AND b <> ''").withColumn("s", F.round(S.similarity(F.col("a"), F.col("b")), 9))
        want = {(r.a, r.b, r.s) for r in both.where(F.col("s") >= least(F.least(F.length("a"), F.length("b")))).collect()}
        assert {(r.a, r.b, round(r.similarity, 9)) for r in similar_pairs(a, b, least).collect()} == want and len(want) > 100


def test_similar_pairs_are_dealt_out_and_told_by_letters_first(spark):
    near = similar_pairs(spark.createDataFrame([("목살구이용12호",)], "a string"), spark.createDataFrame([("목살구이용13호",)], "b string"), lambda n: F.lit(0.7))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "bit_count" in plan  # a few bytes met in one task


def test_best_of_similar_names_is_that_of_all_pairs(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("가나다라") for _ in range(rnd.randint(4, 14)))
    known = [(word(), rnd.randint(70, 99), rnd.choice("PQR")) for _ in range(150)]
    names = list({w[:i] + rnd.choice("가마") + w[i + 1 :] for w, *_ in known for i in (1, 3)})
    aliases, memory = known[::2], known[1::2]

    def best(name):
        near = [(k, 100, 1, p) for k, _, p in aliases] + [(k, c, 0, p) for k, c, p in memory]
        told = [(round(1 - edits(name, k) / max(len(name), len(k)), 9), most, kind, p) for k, most, kind, p in near]
        return max(((int(min(100 - (not kind), s * most) + 0.5), kind, p) for s, most, kind, p in told if s >= 0.7), default=(0, 0, None))

    exact = {k for k, *_ in known}
    got = E.matched(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(aliases, "key string, confidence int, product string"), spark.createDataFrame(memory, "key string, score int, product string")).collect()
    told = {r.name: (r.score, r.product) for r in got if r.name not in exact}
    assert told == {n: best(n)[::2] for n in told} and len({x // 8 for x, _ in told.values()}) > 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_readings_are_merged_in_one_shuffle(spark):
    plan = D.ensemble(readings(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_readings_are_merged_by_amount_then_place(spark):
    first = [(1, 1, " a ", 2, 5, 11, 90, False), (1, 2, "b", 1, 7, 7, 95, False), (None, 1, "n", 1, 1, 2, 50, False)]
    second = [(1, 1, "aa", 2, 5, 10, 91, True), (1, 3, " c ", 1, 7, 7, 60, True), (1, 2, "x", 1, 9, 9, 99, True), (None, 1, "nn", 2, 1, 2, 99, True), (2, 1, "only", 1, 1, 1, 1, True)]
    lines = spark.createDataFrame(first + second, "doc int, row int, name string, quantity int, price int, amount int, confidence int, second boolean")
    got = {tuple(r) for r in D.ensemble(lines).collect()}
    assert got == {(1, 1, "aa", 2, 5, 10, 91), (1, 2, "b", 1, 7, 7, 95), (1, 3, " c ", 1, 7, 7, 60), (None, 1, "n", 1, 1, 2, 50), (None, 1, "nn", 2, 1, 2, 99), (2, 1, "only", 1, 1, 1, 1)}


def test_learned_names(spark):
    rules = spark.createDataFrame([
        (1, "A", "냉장 한돈 목살 구이용", "목살", "돼지고기", "냉장", 5, 90, 3, 1), (2, "A", "냉장 한돈 목살", "목심", "소고기", "냉장", 5, 90, 3, 1), (3, "A", "한우 등심", "등심", "소고기", "", 5, 90, 3, 1),
        (4, None, "숙성 채끝 스테이크", "채끝", "소고기", "", 5, 90, 3, 1), (5, "B", "숙성 채끝 스테이커", "꽃등심", "소고기", "", 5, 90, 3, 1), (6, "A", "냉동 사태", "사태", "소고기", "냉동", 5, 90, 3, 1), (7, "A", "냉장 한돈 목살 구이", "목심", "소고기", "냉장", 5, 90, 3, 1),
    ], "id int, supplier string, source string, target string, category string, storage string, priority int, confidence int, success int, day int")
    names = spark.createDataFrame([
        (1, "A", "한우 등심", None), (2, "A", "냉장 한돈 목살 구이용 농협", None), (3, "A", "냉동 사태 도드람", None), (4, "A", "냉동 사태 도드람", "돈육"), (5, "C", "숙성 채끝 스테이크", None), (6, "C", "숙성 채끝 스테이그", None),
        (7, "B", "숙성 채끝 스테이거", None), (8, "A", "닭발", None), (9, "C", "냉장 한돈 목살", None), (10, None, None, None),
    ], "id int, supplier string, name string, hint string")
    got = {r.id: (r.target, r.by) for r in E.found_rules(names, rules).collect()}
    assert got[1] == ("등심", "supplier_exact") and got[5] == ("채끝", "global_exact") and got[6] == ("채끝", "global_fuzzy") and got[8] == got[9] == got[10] == (None, None)
    assert got[2] == (None, None)  # rules for other targets are one and three letters shorter: the nearer one competes
    assert got[3] == ("사태", "supplier_prefix") and got[4] == (None, None)  # a rule of four letters counts unless the hint contradicts its category
    assert got[7] == (None, None)  # the own rule and the one for all come equally near


def test_rows_that_slipped_are_moved_back(spark):
    good = [(36.0, 5300.0, 190800.0), (5.8, 31000.0, 179800.0), (10.3, 7700.0, 79310.0), (105.1, 9300.0, 977430.0)]
    rows = [(1, i, f"n{i}", *x, f"L{j}", 90) for i, (j, x) in enumerate([(0, good[0]), (1, good[1]), (2, good[2]), (2, good[2]), (3, good[3])], 1)]
    df = spark.createDataFrame(rows, "doc int, row long, name string, quantity double, price double, amount double, trace string, confidence int")
    got = D.repaired(df).orderBy("row").collect()
    assert len(got) == 4 and got[3].quantity == 105.1 and got[3].name == "n4" and got[0].reason == "INSERTED_DUPLICATE_NUMERIC_ROW" and got[3].confidence == 80
    assert D.repaired(df.where("row < 4")).where("reason IS NOT NULL").count() == 0


def test_names(spark):
    say = lambda f, *x: [r[0] for r in spark.createDataFrame([(v,) for v in x], "n string").select(f(F.col("n"))).collect()]
    assert say(N.canonical, "냉장 황창(장터)", "냉장 삼겸", "소목심") == ["냉장 항정(장터)", "냉장 삼겹", "소목심"]
    assert say(N.letters, "갈비 a") == ["ㄱㅏㄹㅂㅣ a"] and say(N.particle, "삼겹살", "갈비") == ["이", "가"]
    assert say(S.normalise, "A+B $5 ^x") == ["ab5x"]
    assert say(T.trace_numbers, "이력번호 : L12607026054002", "a / 140028101672 / b", "no 123-45-67890, 2024-01-02") == [["L12607026054002"], ["140028101672"], []]
    keys = say(lambda c: N.classified(c)["key"], "박피 삼겹살", "삼겹살", "냉장 삼겹살", "냉동 삼겹살")
    assert keys[0] == keys[1] and len(set(keys[1:])) == 3


def test_tax(spark):
    rows = [("plain text", None), ("과세 부가세 별도", 1200.0), ("소스 첨가", None), ("면세 물품", 10.0)]
    got = [r.t for r in spark.createDataFrame(rows, "x string, o double").select(T.tax(F.col("x"), F.col("o")).alias("t")).collect()]
    assert [(t.treatment, t.amount, t.review) for t in got] == [("EXEMPT", 0.0, False), ("TAXABLE", 1200.0, False), (None, None, True), ("EXEMPT", 0.0, False)]


def test_pasted_tables(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "n long, line string")
    named = R.pasted(lines("상품코드,품명,판매가", '12,"pork, belly","1,200"', "x,,5"), 3).collect()
    assert [tuple(r) for r in named] == [("12", "pork, belly", 1200.0)]
    bare = R.pasted(lines("pork\t1,200\t12", "beef\t3,400\t13"), 3).collect()
    assert sorted(map(tuple, bare)) == [("12", "pork", 1200.0), ("13", "beef", 3400.0)]
    assert R.pasted(lines(), 3).count() == 0


def test_order_session_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 2, float(t), "receipt" if i % 5 == 2 else "label") for i, t in enumerate((0, 1, 2, 3, 20, 21, 22, 23, 24, 60, 61, 62))]
    df = spark.createDataFrame(rows, "id long, user long, seconds double, kind string")
    at = df.withColumn("at", F.timestamp_seconds("seconds"))
    want = {r.id: r.order_id for r in C.order_sessions(at, ["user"], 10).collect()}
    for k in range(3):
        df.where(f"id >= {k * 4} AND id < {k * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = C.order_session_stream(stream, 10).writeStream.format("memory").queryName("orders_of").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert {r.id: r.order_id for r in spark.table("orders_of").collect()} == want


def test_summary_stream_remakes_touched_buckets(spark, tmp_path):
    ledger = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, amount double")
    ledger.where("k = 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ledger.schema).parquet(str(tmp_path / "in"))
    C.summary_stream(stream, lambda _: ledger, ["k"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).select("k", "n", "amount").collect()] == [("a", 2, 3.0)]


def test_upsert_prefers_new_rows(spark):
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string"), spark.createDataFrame([("a", 1, "z")], "k string, v int, t string")
    assert {r.k: r.t for r in L.upsert(old, new, ["k"], "v").collect()} == {"a": "z", "b": "y"}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(i, "c", t) for i, t in enumerate((0.0, 1.5, 2.5, 4.0, 4.6))] + [(9, "d", 1.0)]
    df = spark.createDataFrame(rows, "id long, code string, seconds double")
    batch = sorted(r.id for r in C.debounce(df).collect())
    assert batch == [0, 2, 4, 9]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = C.debounce_stream(stream).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("debounced").collect()) == batch


def test_first_of_txn_stream(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"company": [1, 1, 1], "txn": ["a", "a", "b"], "sold_at": pd.date_range("2024-01-01", periods=3, freq="min")}))
    df.write.parquet(str(tmp_path / "in"))
    q = C.first_of_txn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.txn for r in spark.table("firsts").collect()) == ["a", "b"]


def test_order_sessions(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, "a", at(0), "label"), (2, "a", at(1), "receipt"), (3, "a", at(2), "label"), (4, "a", at(3), "receipt"), (5, "a", at(4), "label"), (6, "a", at(30), "label")]
    df = spark.createDataFrame(rows, "id long, agent string, at timestamp, kind string")
    assert {r.id: r.order_id for r in C.order_sessions(df, ["agent"], 10).collect()} == {1: None, 2: 2, 3: 2, 4: 4, 5: 4, 6: None}


def test_boxes_at_one_place_are_compared_once(spark):
    r = random.Random(5)
    rows = [(d, i, 100 * r.randrange(3), 100 * r.randrange(3), 110, 110, r.randrange(50)) for d in "ab" for i in range(150)]
    rows += [("c", i, r.randrange(-60, 60), r.randrange(60), r.choice((1, 7, 20, 90)), r.choice((0, 2, 7, 33)), r.randrange(50)) for i in range(120)]
    rows += [("d", 1, 0, 0, 5, 5, 1), ("d", 1, 0, 0, 5, 5, 1), ("d", 2, 9, 9, 5, 5, 1), ("d", 3, 9, 10, 5, 5, 1), ("d", 4, 0, 9, 5, 5, 1)]
    calls = spark.sparkContext.accumulator(0)

    def share(a, b):
        side = lambda p, s: max(0, min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p]))
        least = min(a["w"] * a["h"], b["w"] * b["h"])
        return side("x", "w") * side("y", "h") / least if least > 0 else 0.0

    def counted(a, b):
        calls.add(1)
        return float(share(a, b))

    names = ("doc", "id", "x", "y", "w", "h", "confidence")
    boxes = [dict(zip(names, x, strict=True)) for x in rows]
    want = set()
    for d in "abcd":
        own = [x for x in boxes if x["doc"] == d]
        hit = {x["id"] for x in own for y in own if x["id"] != y["id"] and share(x, y) >= 0.65}
        want |= {(d, x["id"]) for x in sorted((x for x in own if x["id"] not in hit), key=lambda x: (x["confidence"], x["id"]))[:3]}
    df = spark.createDataFrame(rows, "doc string, id int, x int, y int, w int, h int, confidence int")
    assert {(x.doc, x.id) for x in M.apart_boxes(df, F.udf(counted, "double")("a", "b")).collect()} == want and len(want) > 4
    assert calls.value < len(rows) ** 2 / 10


def test_a_key_stands_for_its_least_alias(spark):
    suppliers = spark.createDataFrame([(1, "n1", "c1"), (2, "n2", "c1"), (3, "n3", "c9")], "id int, name_key string, code_key string")
    aliases = spark.createDataFrame([("c1", None), ("c1", "B"), ("c1", "A"), ("n2", "Z")], "key string, alias string")
    x = M.optional_alias(suppliers, aliases)
    assert {r.id: r.alias for r in x.collect()} == {1: "A", 2: "Z", 3: None}
    assert "Window" not in x._jdf.queryExecution().toString()


def test_evidence_is_told_line_by_line(spark):
    fields = [(n, "1" if n in D.CRITICAL[:5] else "x", "DERIVED" if n in D.DERIVABLE else "OBSERVED", "f") for n in D.REQUIRED if n != "traceOrImportNo"]
    fields = [(n, "0" if n == "taxAmount" else v, s, f) for n, v, s, f in fields]
    rows = [("a", 1, "EXEMPT", [*fields, ("traceOrImportNo", "L012345678901", "INFERRED", None)]), ("a", 2, "TAXABLE", [*fields, ("traceOrImportNo", None, "OBSERVED", None)])]
    x = D.line_evidence(spark.createDataFrame(rows, "doc string, row int, treatment string, fields array<struct<field:string,value:string,status:string,formula:string>>"))
    assert "Exchange" not in x._jdf.queryExecution().toString()
    got = {r.row: (r.issues, r.proven) for r in x.collect()}
    assert got == {1: (["CRITICAL_FIELD_INFERRED:traceOrImportNo"], 11), 2: (["REQUIRED_FIELD_MISSING:traceOrImportNo", "DERIVED_EVIDENCE_NOT_PROVEN:taxAmount"], 11)}


def test_an_order_without_a_first_line_is_told(spark):
    orders = spark.createDataFrame([("ord-1", 7, "COUPANG", Decimal(100), 1)], "order_id string, store int, channel string, amount decimal(18,2), at int")
    lines = spark.createDataFrame([("ord-1", 2, "000001", "000001", None, None), ("ord-1", 3, "000001", "000001", None, None)], "order_id string, line_no int, code string, barcode string, quantity decimal(18,3), amount decimal(18,2)")
    stock = spark.createDataFrame([(7, "own2", Decimal(2))], "store int, product string, available decimal(18,3)")
    o, done = V.fulfilled(orders, lines, mappings(spark), stock)
    assert [(r.order_id, r.error) for r in o.collect()] == [("ord-1", None)]
    assert sorted((r.line_no, r.amount) for r in done.collect()) == [(2, 50.0), (3, 50.0)]


def test_printed_lines_are_split_once(spark):
    texts = [("P 7 3 box 1,000 3,000",), ("1 2 3 4",), ("a b 0 1 2",), ("a b",), (None,), ("a 2.5 10 25",)]
    x = spark.createDataFrame(texts, "t string").select("t", F.inline(D.parsed_lines(F.col("t"))))
    assert {r.t: tuple(r)[1:] for r in x.collect()} == {"P 7 3 box 1,000 3,000": ("P 7", 3.0, "box", 1000.0, 3000.0), "1 2 3 4": ("1", 2.0, "kg", 3.0, 4.0), "a 2.5 10 25": ("a", 2.5, "kg", 10.0, 25.0)}
    assert x._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_rows_of_a_run_need_one_order(spark):
    df = spark.createDataFrame([("d", i, i, 1.0, 2.0, 2.0, "L", 0) for i in range(1, 5)], "doc string, pos int, row_no int, quantity double, unit_price double, supply double, trace string, printed int")
    x = K.line_issues(df, "doc", ["pos"], "printed")
    assert x.first().issues == ["ADJACENT_ROW_VALUE_DUPLICATE:1:2"]
    assert x._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2 and "run" not in x._jdf.queryExecution().optimizedPlan().toString()
