"""Queries over product names and values read from text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import names as N
from stockloom.functions import texts as T
from stockloom.functions.scalars import similarity
from stockloom.operators import resolution as R
from stockloom.sources.adapters import cards, goods, picked, read, sales

from .registry import query

ORIGINS = "[" + ", ".join(f"'{o}'" for o in N.ORIGINS) + "]"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, '　', ' '), '２', '2'), '\\s+', ' ', 'g'))"


def sql_mended(x: str) -> str:
    return f"regexp_replace(regexp_replace({sql_clean(x)}, '넥장|넹장|냉쟝', '냉장', 'g'), '넥동|넹동|냉돔', '냉동', 'g')"


def sql_print(x: str) -> str:
    """A fingerprint in SQL: the origins go one after the other."""
    return f"list_reduce(list_prepend(lower(regexp_replace({sql_mended(x)}, '[\\s\\p{{P}}\\p{{S}}]+', '', 'g')), {ORIGINS}), lambda a, o: replace(a, o, ''))"


def sql_canonical(x: str) -> str:
    out = sql_mended(x)
    for a, b in (("황창|항창|황정살?|항졍", "항정"), ("삼겸", "삼겹"), ("삼겹쌀|삼겹삽", "삼겹살"), ("(^|[^소우])목심", r"\1목살"), ("부체살", "부채살"), ("채끝살", "채끝")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    for o in N.ORIGINS:
        out = rf"regexp_replace(regexp_replace({out}, '\(\s*{o}\s*\)', ' ', 'g'), '(^|\s){o}(\s|$)', '\1 \2', 'g')"
    for a, b in ((r"\s+", " "), (r"\s*\(\s*", "("), (r"\s*\)\s*", ")"), (r"^(냉장|냉동)\s*", r"\1 ")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim({out})"


CUT = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{c}|{k}|{q}'" for p, c, k, q in N.CUTS) + " END"
SKIN = r"CASE WHEN regexp_matches(f, '미(박|빅|밖|백|뱍)(피)?') OR regexp_matches(f, '^(냉장|냉동)?미(전지|젼지|전쥐|전디|앞다리|압다리|앞다라|후지|뒷다리|삼겹|목살|등심|갈비)') THEN 'skin_on' WHEN regexp_matches(f, '(^|냉장|냉동)(박피|박펴|박파|박비|빅피|밖피)') THEN 'skinless' ELSE 'unknown' END"
STORE = "CASE WHEN contains(n, '냉동') THEN '냉동' WHEN contains(n, '냉장') THEN '냉장' ELSE '미표기' END"
READ = f"named AS (SELECT id, name, supplier, unit, price, size, {sql_canonical('name')} AS n, {sql_print('name')} AS f FROM goods), told AS (SELECT *, {CUT} AS rule, {SKIN} AS skin, {STORE} AS storage FROM named)"


#: Half-width letters, a ligature, a letter with its accent apart, signs that stand for words, blanks of other widths, and plain text.
ODD = ("ﾡﾤ 목살", "ﬁne  cut", "Cafe\u0301 등심", "㎏ ①번", "삼겹살\u3000２００ｇ", "ﾊﾟｰｸ", "plain  ascii ", "각\u00a0목")
PLAIN = tuple(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip() for x in ODD)


@query(f"SELECT p_partkey AS id, {picked(PLAIN, 'p_partkey % 8', True)} || ' ' || p_name AS name FROM part")
def str_clean(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.get(F.array(*map(F.lit, ODD)), (F.col("p_partkey") % 8).cast("int")), F.lit("\u3000"), "p_name", F.lit(" "))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.normalised(text).alias("name"))


@query(f"SELECT id, {sql_print('name')} AS k FROM goods")
def str_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.fingerprint(F.col("name")).alias("k"))


@query("SELECT id, lower(regexp_replace(name, '[\\s　]+', '', 'g')) AS joined, lower(regexp_replace(name, '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g')) AS bare FROM goods WHERE NOT contains(name, '　')")
def str_compact_symbols(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).where(~F.col("name").contains("　")).select("id", T.plain_symbols(F.col("name")).alias("x")).select("id", "x.*")


SUPPLIERS = "suppliers AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '(주)' || s_name || '유통' WHEN 1 THEN '주식회사 ' || s_name WHEN 2 THEN s_name || ' 유통' ELSE s_name END AS name FROM supplier)"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    full = F.when(k == 0, F.concat(F.lit("(주)"), name, F.lit("유통"))).when(k == 1, F.concat(F.lit("주식회사 "), name)).when(k == 2, F.concat(name, F.lit(" 유통"))).otherwise(name)
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), full.alias("name"))


SUPPLIER_KEY = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(name, '[\\s\\p{P}\\p{S}]+', '', 'g')), '^(주식회사|농업회사법인|유한회사)', ''), '^주', ''), '유통$', '')"


@query(f"WITH {SUPPLIERS} SELECT id, {SUPPLIER_KEY} AS k FROM suppliers")
def str_supplier_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).select("id", N.supplier_fingerprint(F.col("name")).alias("k"))


@query(f"WITH {SUPPLIERS}, keyed AS (SELECT id, {SUPPLIER_KEY} AS k FROM suppliers) SELECT a.id AS invoice, min(b.id) AS supplier FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'none' || id ELSE k END AS k FROM keyed) a LEFT JOIN keyed b USING (k) GROUP BY 1")
def er_supplier_resolve(spark: SparkSession, d: str) -> DataFrame:
    known = suppliers(spark, d)
    asked = known.select(F.col("id").alias("invoice"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("none"), "id")).otherwise(F.col("name")).alias("printed"))
    return R.suppliers_of(asked, known, "printed").select("invoice", "supplier")


@query("SELECT p_partkey AS id, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS similarity FROM (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS b FROM part)")
def str_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), similarity(N.fingerprint(F.col("p_name")), N.fingerprint(F.col("p_type"))).alias("similarity"))


@query("SELECT id, letters FROM (SELECT p_partkey AS id, ['ㅅㅏㅁㄱㅕㅂ a', 'ㄱㅏㄹㅂㅣ', 'ㄷㅏㄺ', 'beef', ''][p_partkey % 5 + 1] AS letters FROM part)")
def str_jamo(spark: SparkSession, d: str) -> DataFrame:
    words = F.get(F.array(*map(F.lit, ("삼겹 a", "갈비", "닭", "beef", ""))), (F.col("p_partkey") % 5).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), N.letters(words).alias("letters"))


@query("SELECT p_partkey AS id, [1.0, round(0.96::DOUBLE * 5 / 6, 9), 0.0, round(0.96::DOUBLE * 0.5, 9), 0.88][p_partkey % 5 + 1]::DOUBLE AS similarity FROM part")
def str_hangul_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Equal; one letter of six missing; nothing given; half the letters right; all in another order."""
    pick = lambda *w: F.get(F.array(*map(F.lit, w)), (F.col("p_partkey") % 5).cast("int"))
    a, b = pick("항정", "항저", "", "가나", "삼겹"), pick("항정", "항정", "목살", "다가", "겹삼")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(N.hangul_similarity(a, b), 9).alias("similarity"))


@query("SELECT p_partkey AS id, [1.0, 0.0, 1.0, round(0.96::DOUBLE * 5 / 6, 9)][p_partkey % 4 + 1]::DOUBLE AS similarity FROM part")
def str_term_similarity(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *w: F.get(F.array(*map(F.lit, w)), (F.col("p_partkey") % 4).cast("int"))
    text, alias = pick("국산항정구이", "abc", "삼겹", "냉장항저"), pick("항정", "목살", "삼겹", "항정")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(N.term_similarity(text, alias), 9).alias("similarity"))


PAIRED = "SELECT id, a, b FROM (SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS b FROM part)"


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Names with another reading of each: the same, its first word, or something else."""
    b = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_brand"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), b.alias("b"))


@query(f"SELECT id, CAST(CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN floor(82 + least(length(a), length(b)) / greatest(length(a), length(b)) * 15 + 0.5) ELSE 0 END AS BIGINT) AS score FROM ({PAIRED})")
def str_partial_score(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("id", T.partial_score(F.col("a"), F.col("b")).alias("score"))


@query(f"SELECT id, levenshtein(a, b) / length(a) AS rate FROM ({PAIRED})")
def str_cer(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("id", T.error_rate(F.col("a"), F.col("b")).alias("rate"))


@query(f"SELECT id, levenshtein(a, b) AS distance, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS similarity FROM ({PAIRED})")
def str_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("id", F.levenshtein("a", "b").cast("long").alias("distance"), similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"SELECT id, CAST(floor(len(list_filter(list_distinct(string_split(a, '')), lambda c: contains(b, c))) * 100 / greatest(length(a), length(b)) + 0.5) AS BIGINT) AS score FROM ({PAIRED})")
def str_charset_overlap(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.functions.scalars import letters_shared

    return paired(spark, d).select("id", letters_shared(F.col("a"), F.col("b")).alias("score"))


@query(f"SELECT id, 2 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / (length(a) + length(b)) AS dice FROM ({PAIRED})")
def str_multiset_dice(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).select("id", N.dice(F.col("a"), F.col("b")).alias("dice"))


@query("SELECT id, name || CASE WHEN right(name, 1) IN ('산', '창', '살', '동', '심', '육', '장', '겸', '원') THEN '이' ELSE '가' END AS text FROM goods WHERE right(name, 1) >= '가'")
def str_particle(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).where(F.right("name", F.lit(1)) >= "가").select("id", F.concat("name", N.particle(F.col("name"))).alias("text"))


@query("SELECT id, ['강남구', '수원시', '역삼동', '세종특별자치시', '가평군'][id % 5 + 1] AS region FROM goods")
def str_region(spark: SparkSession, d: str) -> DataFrame:
    places = ("서울특별시 강남구 역삼동 (1층)", "경기도 수원시 팔달구", "부산광역시, 역삼동", "세종특별자치시", "경기 가평군 청평면")
    return goods(spark, d).select("id", T.region(F.get(F.array(*map(F.lit, places)), (F.col("id") % 5).cast("int"))).alias("region"))


@query("SELECT id, CAST(price AS DOUBLE) AS amount FROM goods")
def str_money(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", T.money(F.concat(F.lit("₩ "), F.format_number("price", 2), F.lit(" 원"))).alias("amount"))


@query("SELECT s_suppkey AS id, s_suppkey % 3 > 0 AS valid FROM supplier")
def str_business_no(spark: SparkSession, d: str) -> DataFrame:
    k = F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.business_no(F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit(" 123-45-"), k)).otherwise(F.concat(F.lit("12345"), k))).alias("valid"))


@query("SELECT doc, doc % 2 = 0 AS valid FROM invoices")
def str_date_format(spark: SparkSession, d: str) -> DataFrame:
    from stockloom.sources.adapters import invoices

    return invoices(spark, d).select("doc", T.iso_date(F.when(F.col("doc") % 2 == 0, F.date_format("created_at", "yyyy-MM-dd")).otherwise(F.date_format("created_at", "yyyy/MM/dd"))).alias("valid"))


TRACED = "SELECT p_partkey AS id, lpad(CAST(p_partkey % 1000000 AS VARCHAR), 11, '7') AS k FROM part"


def traced(spark: SparkSession, d: str) -> DataFrame:
    k = F.lpad((F.col("p_partkey") % 1000000).cast("string"), 11, "7")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("이력번호 : L12-"), k)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("수입 "), k, F.lit("28 / x"))).when(F.col("p_partkey") % 4 == 2, F.lit("등록 2024-01-02, 사업자 123-45-67890")).otherwise(F.concat(F.lit("lot us-202607 "), k))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))


#: Lines with a domestic number near and far from what it is called, a lot, a number told twice, and what is none. Each stands for itself and once more behind a filling of 30 letters.
TRACE_LINES = (
    "CASE p_partkey % 6 WHEN 0 THEN '이력번호 : L12-' || {k} WHEN 1 THEN '수입 ' || {k} || '28 / x' WHEN 2 THEN '등록 2024-01-02, 사업자 123-45-67890' WHEN 3 THEN 'lot us-202607 ' || {k} WHEN 4 THEN '묶음번호 없음' || repeat('가', 30) || 'L12 ' || {k} ELSE {k} || '77' || repeat(' 나', 20) || ' 이력번호 ' || {k} || '99, L34' || {k} END"
)
PAD = "lpad(CAST(p_partkey % 1000000 AS STRING), 11, '7')"


@query(f"""WITH t AS (SELECT p_partkey AS id, {TRACE_LINES.format(k=PAD)} AS line FROM part), m AS (SELECT id, line, unnest(regexp_extract_all(line, '(?i){T.TRACE}') || regexp_extract_all(line, '(?i){T.LOT}')) AS raw FROM t),
 o AS (SELECT id, raw, instr(line, raw) - 1 AS pos, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS key, line FROM m), c AS (SELECT *, regexp_matches(substr(line, greatest(0, pos - 28) + 1, length(raw) + 28 + least(28, pos)), '{T.TRACE_WORDS}') AS near FROM o WHERE regexp_matches(regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g'), '{T.TRACE_SHAPE}')),
 s AS (SELECT id, key, pos, near, 70 + CASE WHEN near THEN 20 ELSE 0 END + CASE WHEN regexp_matches(key, '^L[0-9]{{12,15}}$') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(key, '^[A-Z]') THEN 2 ELSE 0 END AS sure FROM c WHERE NOT regexp_matches(regexp_replace(key, '[^0-9]', '', 'g'), '^(19|20)[0-9]{{6}}$|^[0-9]{{10}}$')),
 d AS (SELECT id, key, min((-sure, pos)) AS place, max((-sure, pos)) AS told FROM s GROUP BY 1, 2)
 SELECT t.id, coalesce(string_agg(key || ':' || CAST(-told[1] AS VARCHAR) || '@' || CAST(told[2] AS VARCHAR), ',' ORDER BY place), '') AS traces FROM t LEFT JOIN d ON d.id = t.id GROUP BY 1""")
def str_trace_extract(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(TRACE_LINES.format(k=PAD)).alias("line"))
    told = F.transform(T.trace_matches(F.col("line")), lambda r: F.concat(r["key"], F.lit(":"), r["confidence"].cast("string"), F.lit("@"), r["offset"].cast("string")))
    return lines.select("id", F.array_join(told, ",").alias("traces"))


@query(f"SELECT id, '999' || k || CASE WHEN id % 2 = 0 THEN ',L999' || k ELSE '' END AS candidates FROM ({TRACED})")
def str_trace_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.lpad((F.col("p_partkey") % 1000000).cast("string"), 11, "7")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.trace_candidates(F.concat(F.lit(" 999 "), k), F.col("p_partkey") % 2 == 0), ",").alias("candidates"))


@query("SELECT id, CASE WHEN regexp_matches(name, '(^|\\s)국내산(\\s|$)') THEN '국내산' WHEN regexp_matches(name, '(^|\\s)(미국산|미국)(\\s|$)') THEN '미국산' ELSE '' END AS origin, CASE WHEN contains(name, ' 1++ ') THEN '1++' ELSE '' END AS grade, CASE WHEN regexp_matches(name, '(^|\\s)냉동(\\s|$)') THEN 'frozen' WHEN regexp_matches(name, '(^|\\s)냉장(\\s|$)') THEN 'fresh' ELSE '' END AS storage FROM goods")
def str_origin_grade_storage(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", T.origin_grade_storage(F.col("name")).alias("x")).select("id", "x.*")


@query("SELECT id, CAST(floor(price) AS DOUBLE) * (id % 2) AS amount FROM goods")
def str_amount_by_label(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("상호 x\n"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("합 계 금액 : "), F.format_number(F.floor("price"), 0))).otherwise("합계 없음"), F.lit("\n끝 9"))
    return goods(spark, d).select("id", T.amount_after(body, ("총액", "합계금액")).alias("amount"))


@query("SELECT id, ['국민', '신한', 'NH농협', '기타', '카카오'][id % 5 + 1] AS company FROM (SELECT id, card FROM cards) WHERE id % 5 > 0 UNION ALL SELECT id, 'KB국민' FROM cards WHERE id % 5 = 0")
def src_card_name_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(F.lit("kb카드"), F.lit("신한카드"), F.lit("농협 카드"), F.lit(None).cast("string"), F.lit("카카오 카드")), (F.col("id") % 5).cast("int"))
    return cards(spark, d).select("id", T.card_company(raw).alias("company"))


@query("SELECT id, ['TAXABLE', 'EXEMPT', NULL, 'EXEMPT'][id % 4 + 1] AS treatment, [CAST(size AS DOUBLE), 0, NULL, 0][id % 4 + 1] AS amount, id % 4 = 2 AS review FROM goods")
def doc_tax_policy(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, ("합계 (과세) 별도", "면세 물품", "돼지갈비 소스 첨가", "냉장 삼겹살"))), (F.col("id") % 4).cast("int"))
    t = T.tax(text, F.when(F.col("id") % 4 == 0, F.col("size")))
    return goods(spark, d).select("id", t.alias("t")).select("id", "t.treatment", "t.amount", "t.review")


@query("""SELECT id, substr(barcode, 2, 6) AS item, CASE id % 3 WHEN 0 THEN 25000.0 WHEN 1 THEN CASE WHEN a > 0 THEN floor(a / 0.5 + 0.5) END ELSE floor(9000 / 0.6 + 0.5) END::DOUBLE AS price_per_kg,
 CASE WHEN id % 3 < 2 THEN 'PRICE' WHEN a = 500 THEN 'WEIGHT' END AS embeds, id % 3 = 2 AND a <> 500 OR id % 2 = 1 AS review FROM (SELECT id, barcode, CAST(substr(barcode, 8, 5) AS BIGINT) AS a FROM sales)""")
def bc_label_normalise(spark: SparkSession, d: str) -> DataFrame:
    s, k = sales(spark, d), F.col("id") % 3
    a = F.substring("barcode", 8, 5).cast("double")
    x = T.label(F.col("barcode"), F.when(k < 2, a), F.lit(0.5), F.when(k == 0, 2500).when(k == 2, 9000), F.when(k == 0, "100g").when(k == 2, "600g"), F.when(F.col("id") % 2 == 0, "삼겹"))
    return s.select("id", x.alias("x")).select("id", "x.item", "x.price_per_kg", "x.embeds", "x.review")


@query("SELECT id, CASE WHEN hour(sold_at) < 12 THEN 'morning' WHEN hour(sold_at) < 18 THEN 'afternoon' ELSE 'evening' END AS part, CASE WHEN month(sold_at) = 11 THEN 'kimchi' WHEN month(sold_at) BETWEEN 3 AND 5 THEN 'spring' WHEN month(sold_at) BETWEEN 6 AND 8 THEN 'summer' WHEN month(sold_at) IN (9, 10) THEN 'autumn' ELSE 'winter' END AS season, dayofweek(sold_at) IN (0, 6) AS weekend FROM sales")
def dt_calendar(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).select("id", T.calendar(F.col("sold_at")).alias("x")).select("id", "x.*")


@query(f"WITH {READ} SELECT id, n AS name FROM told")
def er_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.canonical(F.col("name")).alias("name"))


@query("SELECT id, " + "regexp_replace(" * 6 + "regexp_replace(regexp_replace(name, '넥장|넹장|냉쟝', '냉장', 'g'), '넥동|넹동|냉돔', '냉동', 'g'), '황창|항창|황정살?|항졍', '항정', 'g'), '삼겸', '삼겹', 'g'), '삼겹쌀|삼겹삽', '삼겹살', 'g'), '(^|[^소우])목심', '\\1목살', 'g'), '부체살', '부채살', 'g'), '채끝살', '채끝', 'g') AS name FROM goods")
def er_substitute(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.replaced(F.col("name"), N.SUBSTITUTIONS).alias("name"))


@query(f"WITH {READ} SELECT id, split_part(rule, '|', 1) AS cut, split_part(rule, '|', 2) AS category, split_part(rule, '|', 3) AS qualifier FROM told WHERE rule IS NOT NULL")
def er_cut_rules(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.cut(N.canonical(F.col("name"))).alias("x")).where("x IS NOT NULL").select("id", "x.*")


@query(f"WITH {READ} SELECT id, skin FROM told")
def er_skin_state(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.skin(F.col("name")).alias("skin"))


CLASSIFIED = f"""{READ}, classes AS (SELECT id, supplier, n AS name, CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 2) END AS category, CASE WHEN rule IS NOT NULL THEN split_part(rule, '|', 1) END AS cut,
 CASE WHEN split_part(rule, '|', 2) = '돼지고기' AND skin = 'skin_on' THEN '미박' ELSE coalesce(split_part(rule, '|', 3), '') END AS qualifier, storage, skin, CASE WHEN rule IS NULL THEN 40 WHEN storage = '미표기' THEN 92 ELSE 96 END AS confidence,
 CASE WHEN rule IS NULL THEN 'CUT_UNKNOWN' WHEN split_part(rule, '|', 2) <> '돼지고기' AND skin <> 'unknown' THEN 'SKIN_CONTRADICTS_SPECIES' WHEN split_part(rule, '|', 3) = '미박' AND skin = 'skinless' THEN 'SKIN_CONTRADICTS_CUT' END AS review, f, size, price FROM told),
 keyed AS (SELECT *, coalesce(category, '미분류') || '|' || coalesce(cut, f) || '|' || qualifier || '|' || storage AS key FROM classes)"""


@query(f"WITH {CLASSIFIED} SELECT id, name, category, cut, qualifier, storage, skin, confidence, review, key FROM keyed")
def er_classify(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.classified(F.col("name")).alias("x")).select("id", "x.*")


@query(f"WITH {CLASSIFIED} SELECT key, count(*) AS n, CAST(sum(price) AS DOUBLE) AS amount, list_sort(list(DISTINCT name)) AS names FROM keyed GROUP BY 1")
def agg_group_by_resolved_name(spark: SparkSession, d: str) -> DataFrame:
    return R.by_resolved_name(goods(spark, d), "name", "price")


@query("SELECT id, CASE WHEN contains(t, '돈육') OR contains(t, '돼지') OR contains(t, '삼겹') OR contains(t, '전지') THEN '돼지' WHEN contains(t, '우육') OR contains(t, '한우') OR contains(t, '우') THEN '소' WHEN contains(t, '닭') THEN '닭' ELSE '기타' END AS species, CASE WHEN contains(name, '냉동') THEN '냉동' WHEN contains(name, '냉장') THEN '냉장' ELSE '미표기' END AS storage FROM (SELECT id, name, unit || ' ' || name AS t FROM goods)")
def er_source_species(spark: SparkSession, d: str) -> DataFrame:
    return goods(spark, d).select("id", N.species(F.col("unit"), F.col("name")).alias("species"), N.stated_storage(F.col("name")).alias("storage"))
