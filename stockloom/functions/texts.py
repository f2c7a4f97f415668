"""Values read from text: amounts, trace numbers, labels, receipts, formats, calendars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .scalars import SCALE_LABEL, compact, ean13_valid, js_round, let

#: The company of a card by the words of its name, in order.
CARD_COMPANIES = (("신한", "신한"), ("삼성", "삼성"), ("(?i)KB|국민", "KB국민"), ("현대", "현대"), ("롯데", "롯데"), ("(?i)BC|비씨", "BC"), ("하나", "하나"), ("우리", "우리"), ("(?i)NH|농협", "NH농협"))
#: Markings of tax on a document, and words of made goods, whose tax has to be looked at.
EXEMPT = r"(?i)(?:^|[\s\[(])(면세|부가세\s*없음)(?:[\s:：)\]]|$)"
TAXABLE = r"(?i)(?:^|[\s\[(])(과세|부가세\s*별도|VAT)(?:[\s:：)\]]|$)"
MADE = "(?i)(양념|소스|첨가|조미|제조|혼합육|떡갈비|햄|소시지)"
#: The words that show that a number near them traces goods, a trace number's forms and its shape without signs.
TRACE_WORDS = "(?i)(?:이력번호|개체식별번호|수입이력번호|수입축산물|묶음번호|trace|lot)"
NEAR = 28
#: A trace number: twelve to fifteen digits, with L before domestic ones, or a lot of letters and digits.
TRACE = r"(?:L\s*)?[0-9](?:[\s-]*[0-9]){11,14}"
LOT = r"[A-Z]{1,4}[\s-]*[0-9](?:[A-Z0-9\s-]*[0-9]){8,18}"
TRACE_SHAPE = "^(?:L[0-9]{12,15}|[0-9]{12,15}|[A-Z]{1,4}[A-Z0-9]{9,22})$"


def money(text: Column) -> Column:
    """The number in a text of money, null without one: digits, point and sign only."""
    return F.regexp_replace(text, "[^0-9.-]+", "").try_cast("double")


def business_no(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]{3}-[0-9]{2}-[0-9]{5}$")


def iso_date(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def amount_after(text: Column, labels: tuple[str, ...]) -> Column:
    """The amount that follows a label on its line, white space apart; the first line and then the first label count; 0 without one."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    found = F.flatten(F.transform(lines, lambda x: F.array(*(F.regexp_extract(x, rf"^.*?\Q{label}\E[^0-9]*([0-9][0-9,]*)", 1) for label in labels))))
    first = F.get(F.filter(found, lambda x: x != ""), F.lit(0))
    return F.coalesce(money(first), F.lit(0.0))


def region(address: Column) -> Column:
    """The district of an address, else its neighbourhood; not a metropolitan city."""
    tokens = F.filter(F.split(F.regexp_replace(address, "[(),]", " "), r"\s+"), lambda t: t != "")
    district = F.filter(tokens, lambda t: t.rlike("(시|군|구)$") & ~t.rlike("(특별시|광역시|특별자치시)$"))
    near = F.filter(tokens, lambda t: t.rlike("(읍|면|동)$"))
    rest = F.filter(tokens, lambda t: t.rlike("(시|군|구|읍|면|동)$"))
    return F.coalesce(*(F.get(x, F.lit(0)) for x in (district, near, rest)), F.lit(""))


def partial_score(a: Column, b: Column) -> Column:
    """100 for equal texts, 82 to 97 by length if one contains the other, else 0."""
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, 100).when(inside, js_round(82 + share * 15)).otherwise(0).cast("long")


def error_rate(want: Column, got: Column) -> Column:
    """Edits per character of the wanted text; 1 for any text where none is wanted."""
    n = F.length(want)
    return F.when(n > 0, F.levenshtein(want, got) / n).otherwise(F.when(F.length(got) > 0, 1.0).otherwise(0.0))


def trace_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def dated(key: Column) -> Column:
    """Whether a number is a day or a business number rather than a trace number."""
    digits = F.regexp_replace(key, "[^0-9]", "")
    return digits.rlike("^(?:19|20)[0-9]{6}$") | digits.rlike("^[0-9]{10}$")


def trace_numbers(text: Column) -> Column:
    """Distinct trace numbers of a text, in order of their form: digits first, then lots."""
    upper = F.upper(text)
    keys = F.transform(F.concat(F.regexp_extract_all(upper, F.lit(TRACE), F.lit(0)), F.regexp_extract_all(upper, F.lit(LOT), F.lit(0))), trace_key)
    return F.array_distinct(F.filter(keys, lambda k: k.rlike(TRACE_SHAPE) & ~dated(k)))


def matches_at(text: Column, pattern: str) -> Column:
    """The pattern's matches (offset from 0, raw) in order."""

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,raw:string>>").alias("out"))

        def step(a: Column, p: Column) -> Column:
            at = a["at"] + F.length(p["gap"])
            return F.struct((at + F.length(p["raw"])).alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("offset"), p["raw"].alias("raw")))).alias("out"))

        return F.aggregate(parts, start, step, lambda a: a["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: placed(F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda raw, gap: F.struct(raw.alias("raw"), gap.alias("gap")))))


def trace_matches(text: Column) -> Column:
    """The trace numbers of a text, the surest first: (key, kind, confidence, near, offset).

    A number of the right shape has 70, words within NEAR characters that speak of tracing add 20, L with digits 8, a leading
    letter 2. Days and business numbers aren't any. Numbers told more than once stand where the surest does, with the values of the least sure.
    """

    def one(t: Column) -> Callable[[Column], Column]:
        def of(m: Column) -> Column:
            key = trace_key(m["raw"])
            around = F.substring(t, F.greatest(F.lit(0), m["offset"] - NEAR) + 1, F.length(m["raw"]) + NEAR + F.least(F.lit(NEAR), m["offset"]))
            near, domestic, lettered = around.rlike(TRACE_WORDS), key.rlike("^L[0-9]{12,15}$"), key.rlike("^[A-Z]")
            sure = F.lit(70) + near.cast("int") * 20 + domestic.cast("int") * 8 + lettered.cast("int") * 2
            kind = F.when(key.rlike("^L[0-9]"), "DOMESTIC_LIVESTOCK").when(lettered, "IMPORT_OR_LOT").otherwise("NUMERIC_TRACE")
            return F.struct((-F.least(F.lit(100), sure)).alias("rank"), m["offset"].alias("offset"), key.alias("key"), kind.alias("kind"), near.alias("near"))

        return of

    def best(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
        last = lambda k: F.element_at(F.filter(rows, lambda r: r["key"] == k), -1)
        return F.transform(keys, lambda k: let(last(k), lambda r: F.struct(r["key"].alias("key"), r["kind"].alias("kind"), (-r["rank"]).alias("confidence"), r["near"].alias("near"), r["offset"].alias("offset"))))

    def of_text(t: Column) -> Column:
        found = F.transform(F.concat(matches_at(t, "(?i)" + TRACE), matches_at(t, "(?i)" + LOT)), one(t))
        return let(F.array_sort(F.filter(found, lambda r: r["key"].rlike(TRACE_SHAPE) & ~dated(r["key"]))), best)

    return let(text, of_text)


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    return texts.str.normalize("NFKC")


def normalised(text: Column) -> Column:
    """A text in compatibility composition, white space as single blanks, none at the ends; null as empty. Texts of ASCII alone don't go through Python."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.trim(F.regexp_replace(F.coalesce(composed(odd), text, F.lit("")), r"[\s\u00A0\u3000\u2000-\u200A\u202F\u205F\u1680\uFEFF\u2028\u2029]+", " "))


def trace_candidates(cell: Column, domestic: Column) -> Column:
    """The trace numbers that a table cell may mean; 14 digits of domestic goods also with L before them."""
    found = trace_numbers(cell)
    bare = F.regexp_replace(trace_key(cell), "[^0-9]", "")
    own = F.when(F.length(bare).between(12, 15), F.array(bare)).otherwise(F.array().cast("array<string>"))
    digits = F.filter(F.transform(F.concat(found, own), lambda k: F.regexp_replace(k, "[^0-9]", "")), lambda k: F.length(k) == 14)
    with_l = F.when(domestic, F.transform(digits, lambda k: F.concat(F.lit("L"), k))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(found, own, with_l), lambda k: k.rlike(TRACE_SHAPE) & ~dated(k))))


def origin_grade_storage(text: Column) -> Column:
    """(origin, grade, storage) by word lists; blanks bound the words; empty without one."""
    word = lambda *w: text.rlike(r"(?:^|\s)(?:" + "|".join(w) + r")(?:\s|$)")
    origin = F.when(word("국내산"), "국내산").when(word("미국산", "미국"), "미국산").when(word("호주산", "호주"), "호주산").when(word("칠레산", "칠레"), "칠레산").when(word("뉴질랜드"), "뉴질랜드산").when(word("수입산"), "수입산").otherwise("")
    grade = F.regexp_extract(F.upper(text), r"(?:^|\s)(1\+\+|1\+|1급|1|2|3|A\+|A|B|C|PR|CAB|S|GF|SBA|AAA)(?:\s|$)", 1)
    storage = F.when(word("냉동"), "frozen").when(word("냉장"), "fresh").otherwise("")
    return F.struct(origin.alias("origin"), grade.alias("grade"), storage.alias("storage"))


def card_company(text: Column) -> Column:
    bare = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("카드"), F.lit("")))
    return F.coalesce(*(F.when(text.rlike(p), name) for p, name in CARD_COMPANIES), F.when(bare != "", bare), F.lit("기타"))


def tax(text: Column, observed: Column) -> Column:
    """(treatment, amount, source, review): an explicit exemption wins over a taxable marking or amount, made goods are reviewed, all else is exempt."""
    exempt, taxable = text.rlike(EXEMPT), text.rlike(TAXABLE) | F.coalesce(observed > 0, F.lit(False))
    row = lambda t, a, s, r: F.struct(t.cast("string").alias("treatment"), a.cast("double").alias("amount"), F.lit(s).alias("source"), r.alias("review"))
    none = F.lit(None)
    return (
        F.when(~exempt & taxable, row(F.lit("TAXABLE"), observed, "DOCUMENT_TAX_MARKING", observed.isNull()))
        .when(exempt, row(F.lit("EXEMPT"), F.lit(0), "DOCUMENT_TAX_MARKING", F.lit(False)))
        .when(text.rlike(MADE), row(none, none, "MEAT_TAX_POLICY", F.lit(True)))
        .otherwise(row(F.lit("EXEMPT"), F.lit(0), "TENANT_TAX_POLICY", F.lit(False)))
    )


def label(barcode: Column, amount: Column, kilograms: Column, price: Column, basis: Column, name: Column) -> Column:
    """(item, price_per_kg, embeds, six_digits, check_digit, review): a scale label's print, checked against its barcode."""
    code = F.regexp_replace(barcode, "[^0-9]", "")
    scale = code.rlike(SCALE_LABEL)
    value = F.when(scale, F.substring(code, 8, 5).cast("long"))
    per = F.when((price > 0) & (basis == "100g"), price * 10).when((price > 0) & (basis == "1kg"), price).when((price > 0) & (basis == "600g"), js_round(price / 0.6)).when((amount > 0) & (kilograms > 0), js_round(amount / kilograms))
    embeds = F.when(value == js_round(amount), "PRICE").when(value == js_round(kilograms * 1000), "WEIGHT")
    six = F.coalesce(scale & embeds.isNull() & (F.substring(code, 7, 6).cast("long") == js_round(amount)), F.lit(False))
    review = ~(scale & embeds.isNotNull() & (F.length(F.trim(F.coalesce(name, F.lit("")))) > 0))
    return F.struct(F.when(scale, F.substring(code, 2, 6)).alias("item"), per.cast("double").alias("price_per_kg"), embeds.alias("embeds"), six.alias("six_digits"), ean13_valid(code).alias("check_digit"), review.alias("review"))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text if they are valid, else as Korean ones; SQL's decode doesn't know the latter."""

    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        try:
            return bytes(x).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(x).decode("cp949", "replace")

    return raw.map(one)


@F.pandas_udf(BinaryType())
def korean_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.encode("cp949", "replace"))


def printed(text: Column) -> Column:
    """Text for a printer without its control characters."""
    return F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F\x7F]", "")


def receipt(text: Column) -> Column:
    """(order_id, amount) of a delivery receipt; null unless it shows both and the amount is above 0."""
    order = F.regexp_extract(text, r"주문\s*번호\s*[:：]?\s*([A-Za-z0-9-]{3,})", 1)
    amount = F.replace(F.regexp_extract(text, r"(?:결제|총|합계)\s*금액\s*[:：]?\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.when((order != "") & (amount > 0), F.struct(order.alias("order_id"), amount.cast("double").alias("amount")))


def label_signal(text: Column) -> Column:
    """(barcode, name, kilograms, price, amount) of a printed label; null without a barcode."""
    code = F.regexp_extract(text, r"(?:^|[^0-9])(2[0-9]{12})(?:[^0-9]|$)", 1)
    weight, unit = (F.regexp_extract(text, r"중량\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*(kg|g)", i) for i in (1, 2))
    kilograms = F.when(unit == "g", weight.try_cast("double") / 1000).otherwise(weight.try_cast("double"))
    number = lambda w: F.replace(F.regexp_extract(text, rf"{w}\s*[:：]?\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("double")
    name = F.trim(F.regexp_extract(text, r"품명\s*[:：]?\s*([^\n]+)", 1))
    return F.when(code != "", F.struct(code.alias("barcode"), name.alias("name"), kilograms.alias("kilograms"), number("단가").alias("price"), number("금액").alias("amount")))


def calendar(ts: Column) -> Column:
    """(part, season, weekend): morning to 12, afternoon to 18, evening; November is its own season."""
    h, m = F.hour(ts), F.month(ts)
    part = F.when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    season = F.when(m == 11, "kimchi").when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 10), "autumn").otherwise("winter")
    return F.struct(part.alias("part"), season.alias("season"), F.dayofweek(ts).isin(1, 7).alias("weekend"))


def plain_symbols(text: Column) -> Column:
    """(joined, bare): lower case without white space, and also without marks."""
    return F.struct(F.lower(F.regexp_replace(text, r"\s+", "")).alias("joined"), compact(text).alias("bare"))
