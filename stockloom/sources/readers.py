"""Sources: a query builder over tables, pasted tables, XML, JSON and layout payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[\s₩]*[0-9][0-9,]*(\.[0-9]+)?\s*원?\s*$"
#: Words of a header that name a code, a name and a price.
HEADS = (("code", r"(?i)plu|품번|품목\s*번호|상품\s*코드|품목\s*코드|코드|번호|item|no\.?$"), ("name", r"(?i)품명|품목명|상품명|품목|이름|name"), ("price", r"(?i)단가|판매가|가격|price"))
TESTS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v), "like": lambda c, v: c.like(v), "is.null": lambda c, _: c.isNull(), "not.is.null": lambda c, _: c.isNotNull(),
}


def rest_scan(df: DataFrame, select: list[str], where: list[tuple] = (), either: list[tuple] = (), order: list[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
    """Rows as a table service gives them: predicates (column, test, value), of which the last one on a column and test counts; `either` of which one must hold; order (column, ascending); limit."""
    last = {(c, t): v for c, t, v in where}
    for (c, t), v in last.items():
        df = df.where(TESTS[t](F.col(c), v))
    if either:
        some = F.lit(False)
        for c, t, v in either:
            some = some | F.coalesce(TESTS[t](F.col(c), v), F.lit(False))
        df = df.where(some)
    if order:
        df = df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order))
    return (df.limit(limit) if limit is not None else df).select(*select)


def children(rows: DataFrame, key: str, value, order: str) -> DataFrame:
    return rows.where(F.col(key) == value).orderBy(order)


def cells(line: Column) -> Column:
    """A pasted line's cells: by tabs if it has any, else by commas outside of quotes."""
    quoted = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.replace(c, F.lit('"'), F.lit("")))
    return F.transform(F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(quoted), lambda c: F.trim(c))


def pasted(lines: DataFrame, width: int) -> DataFrame:
    """(code, name, price) from pasted lines (n, line), n in order from 0, of up to width columns.

    A header names its columns; a column it doesn't name is found by its values: a code has more than 8 in 10 numbers, all of 1 to 6
    digits, a name the fewest numbers, a price more than 6 in 10 numbers and the greatest mean. Rows without code or name go.
    """
    c = lines.select("n", cells(F.col("line")).alias("c"))
    value = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    number = lambda v: F.regexp_replace(v, "[^0-9.]", "").try_cast("double")
    head = c.where("n = 0").select(F.col("c").alias("h")).first()
    names = list(head["h"]) if head else []
    import re

    python = {k: re.compile(p) for k, p in HEADS}
    found = {k: next((i for i, h in enumerate(names) if p.search(h)), -1) for k, p in python.items()} if any(h and not re.match(NUMBER, h) for h in names) else dict.fromkeys(python, -1)
    body = c.where("n > 0") if found["code"] >= 0 or found["name"] >= 0 else c
    stats = body.agg(*(f for i in range(width) for f in (F.avg(value(i).rlike(NUMBER).cast("int")).alias(f"s{i}"), F.avg(F.coalesce(number(value(i)), F.lit(0.0))).alias(f"m{i}"), F.bool_and((value(i) == "") | value(i).rlike("^[0-9]{1,6}$")).alias(f"d{i}")))).first()
    free = lambda: [i for i in range(width) if i not in found.values()]
    share, mean = (lambda i: stats[f"s{i}"] or 0.0), (lambda i: stats[f"m{i}"] or 0.0)
    if found["code"] < 0:
        found["code"] = next((i for i in free() if share(i) > 0.8 and stats[f"d{i}"]), -1)
    if found["name"] < 0:
        best = max(free(), key=lambda i: (1 - share(i), -i), default=-1)
        found["name"] = best if best >= 0 and share(best) < 1 else -1
    if found["price"] < 0:
        best = max((i for i in free() if share(i) > 0.6 and mean(i) > 0), key=lambda i: (mean(i), -i), default=-1)
        found["price"] = best
    if found["code"] < 0 or found["name"] < 0:
        return body.limit(0).select(F.lit("").alias("code"), F.lit("").alias("name"), F.lit(0.0).alias("price"))
    price = number(value(found["price"])) if found["price"] >= 0 else F.lit(None).cast("double")
    out = body.select(F.regexp_replace(value(found["code"]), "[^0-9]", "").alias("code"), value(found["name"]).alias("name"), price.alias("price"))
    return out.where((F.col("code") != "") & (F.col("name") != "") & (F.length("code") <= 6))


def xml_values(text: Column, tags: tuple[str, ...]) -> Column:
    """A struct of the tags' values: the first that isn't empty, null without one."""
    first = lambda t: F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"<{t}>([^<]*)</{t}>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return F.struct(*(first(t).alias(t) for t in tags))


def fenced_json(text: Column, schema: str, defaults: dict[str, Column]) -> Column:
    """A model's answer by a schema: without the code fence around it, with defaults for missing fields."""
    x = F.from_json(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)
    return F.struct(*(F.coalesce(x[c], v).alias(c) for c, v in defaults.items()))


def table_rows(found: DataFrame, roles: tuple[tuple[str, str], ...]) -> DataFrame:
    """Cells (doc, row, col, text) as rows: the first row's cells give each column its role, blank rows and rows of sums go.

    roles: (name, pattern), the first pattern decides; a column without a role is left out.
    """
    role = F.coalesce(*(F.when(F.col("text").rlike(p), n) for n, p in roles))
    heads = found.where("row = 0").select("doc", "col", role.alias("role")).where("role IS NOT NULL")
    body = found.where("row > 0").join(heads, ["doc", "col"])
    value = lambda n: F.max(F.when((F.col("role") == n) & (F.trim("text") != ""), F.trim("text"))).alias(n)
    g = body.groupBy("doc", "row").agg(*(value(n) for n, _ in roles))
    first = F.col(roles[0][0])
    return g.where(first.isNotNull() & ~first.rlike("합계|소계|총계"))


def recordset(text: Column, schema: str) -> Column:
    """The rows of a JSON array by a schema; null where it isn't one."""
    return F.from_json(text, f"array<struct<{schema}>>")


def provider_words(payload: DataFrame) -> DataFrame:
    """Words of three providers' payloads (doc, provider, body) in one form: doc, text, confidence of 100."""
    forms = {"a": "words array<struct<text:string,conf:double>>", "b": "fields array<struct<inferText:string,inferConfidence:double>>", "c": "blocks array<struct<lines:array<struct<t:string,c:double>>>>"}
    x = payload.select("doc", "provider", *(F.from_json("body", s).alias(k) for k, s in forms.items()))
    word = lambda t, c: F.struct(t.alias("text"), c.alias("confidence"))
    a = F.transform("a.words", lambda w: word(w["text"], w["conf"]))
    b = F.transform("b.fields", lambda w: word(w["inferText"], w["inferConfidence"]))
    c = F.transform(F.flatten(F.transform("c.blocks", lambda k: k["lines"])), lambda w: word(w["t"], w["c"]))
    w = x.select("doc", F.explode(F.when(F.col("provider") == "a", a).when(F.col("provider") == "b", b).otherwise(c)).alias("w"))
    sure = F.col("w.confidence")
    return w.select("doc", "w.text", F.round(F.when(sure <= 1, sure * 100).otherwise(sure), 4).alias("confidence"))
