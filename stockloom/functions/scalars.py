"""Scalar functions over columns: barcodes, dates, money, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE_LABEL = "^2[0-9]{12}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def item_key(barcode: Column) -> Column:
    """Item of a scale label: characters 2 to 7; null for other codes."""
    return F.when(barcode.rlike(SCALE_LABEL), F.substring(barcode, 2, 6))


def embedded_value(barcode: Column) -> Column:
    return F.when(barcode.rlike(SCALE_LABEL), F.substring(barcode, 8, 5).cast("long"))


def ean13_valid(code: Column) -> Column:
    """Weights 1 and 3 in turn; the sum of all 13 digits is a multiple of 10."""
    total = sum((F.substring(code, i, 1).cast("int") * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    return F.when(code.rlike("^[0-9]{13}$"), total % 10 == 0).otherwise(False)


def plu_key(prefix: Column, plu: Column) -> Column:
    """The prefix and the PLU, padded together to six digits; a longer number stays whole."""
    room = F.lit(6) - F.length(prefix)
    return F.concat(prefix, F.when(F.length(plu) < room, F.lpad(plu, room, F.lit("0"))).otherwise(plu))


def per_kilogram(price: Column, basis: Column) -> Column:
    return F.when(basis == "100g", price * 10).when(basis == "600g", F.round(price / 0.6, 2)).otherwise(price)


def business_date(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_part(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 11, "morning").when(h < 15, "lunch").when(h < 18, "afternoon").otherwise("evening")


def season(day: Column) -> Column:
    m = F.month(day)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def js_round(x: Column) -> Column:
    """Half towards plus infinity, as the browser rounds."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """Within low and high; null and NaN count as 0."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def normalise(text: Column) -> Column:
    """Lower case, without white space and ASCII punctuation and symbols."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Punct}]+", ""))


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\p{P}\p{S}]+", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def letters_shared(a: Column, b: Column) -> Column:
    """100 * distinct letters of a that b contains / the longer length, rounded."""
    of_a = F.array_distinct(F.split(a, ""))
    shared = F.size(F.filter(of_a, lambda c: (c != "") & F.contains(b, c)))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, js_round(shared * 100 / longer)).otherwise(0).cast("long")


def hash31(text: Column) -> Column:
    """h = h * 31 + letter, from 7, in 32 bits."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(7).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)


def number(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.-]+", "").try_cast("double")


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def z_score(level: Column) -> Column:
    return F.when(level >= 0.97, 1.88).when(level >= 0.95, 1.65).when(level >= 0.9, 1.28).when(level >= 0.85, 1.04).otherwise(0.84)
