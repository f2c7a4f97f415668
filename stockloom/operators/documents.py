"""Checks, repair and merging of documents that were read from scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.names import fingerprint
from stockloom.functions.scalars import clamp, js_round
from stockloom.functions.texts import TRACE_SHAPE, business_no, dated, iso_date, trace_key

NUMBERS = ("quantity", "price", "amount")
#: The fields that each line needs, those whose numbers are critical, and those that may be derived.
REQUIRED = ("species", "part", "productName", "grade", "condition", "unit", "quantity", "unitPrice", "supplyAmount", "taxAmount", "totalAmount", "traceOrImportNo")
CRITICAL = ("quantity", "unitPrice", "supplyAmount", "taxAmount", "totalAmount", "traceOrImportNo")
DERIVABLE = ("supplyAmount", "taxAmount", "totalAmount")
#: What stands in a product's cell if the columns have slipped.
HEADER = r"(?:^|\s)(?:원산지|수량|중량|단가|공급가액|합계금액|이력번호|거래일자|사업자번호|연락처)(?=\s|$|\()"
NUMERIC = r"^[\s\d,.+\-/원박스BOXkgKG]+$"
UNIT = r"(?i)^\d*\s*(?:box|kg|박스|팩|개)$"
ORIGIN = "(?:국내산|국내|미국산|수입산|수입|호주산|캐나다산|브라질산|덴마크산|스페인산|칠레산|네덜란드산|멕시코산)"


def codes(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in named)))


def score(ocr: Column, table: Column, arithmetic: Column, required: Column, alias: Column) -> Column:
    """A document's score of 100: reading .25, table .20, arithmetic .25, required fields .15, known names .15."""
    parts = ((ocr, 0.25), (table, 0.20), (arithmetic, 0.25), (required, 0.15), (alias, 0.15))
    return js_round(sum(clamp(c, 0, 100) * w for c, w in parts)).cast("long")


def validated(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each document: lines, issues, score, integrity, totals_ok, posting and status.

    Lines carry doc, quantity, price, amount and confidence, heads doc, supplier, invoice_date, supply, tax, total and
    business_no. Amounts may be off by 1 in a line and in the document's sum; documents without lines count too.
    """
    given = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in NUMBERS]
    whole = given[0] & given[1] & given[2]
    right = whole & F.coalesce(F.abs(F.col("quantity") * F.col("price") - F.col("amount")) <= 1, F.lit(False))
    sums = lines.groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(~whole).alias("holes"), F.count_if(~right).alias("wrong"), F.sum(F.coalesce("amount", F.lit(0))).alias("sum"), F.avg(F.coalesce("confidence", F.lit(0))).alias("ocr"))
    d = heads.join(sums, "doc", "left").fillna(0, ["lines", "holes", "wrong", "sum", "ocr", "supply", "tax", "total"])
    has = lambda c: F.col(c) > 0
    both = F.round(F.col("supply") + F.col("tax")) != F.round("total")
    numeric = codes(
        ("NO_LINE_ITEMS", ~has("lines")), ("NUMERIC_FIELD_MISSING", has("holes")), ("LINE_ITEM_AMOUNT_MISMATCH", has("wrong")), ("SUPPLY_AMOUNT_MISSING", ~has("supply")), ("TOTAL_AMOUNT_MISSING", ~has("total")),
        ("SUPPLY_AMOUNT_MISMATCH", has("supply") & has("sum") & (F.round("sum") != F.round("supply"))), ("TOTAL_AMOUNT_MISMATCH", has("total") & has("supply") & (F.col("tax") >= 0) & both),
    )
    formal = codes(("BUSINESS_NO_FORMAT", ~business_no(F.col("business_no"))), ("INVOICE_DATE_FORMAT", ~iso_date(F.col("invoice_date"))))
    d = d.withColumn("numeric", numeric).withColumn("issues", F.concat("numeric", formal)).withColumn("integrity", has("lines") & (F.size("numeric") == 0))
    required = sum((c.cast("int") for c in (F.col("supplier").isNotNull(), F.col("invoice_date").isNotNull(), has("total"))), F.lit(0))
    totals = has("supply") & has("total") & (F.abs(F.col("supply") + F.col("tax") - F.col("total")) <= 1)
    d = d.withColumn("totals_ok", totals).withColumn("score", score(F.col("ocr"), F.least(F.lit(100), 60 + F.col("lines") * 5), F.when(F.col("integrity"), 100).otherwise(30), F.least(F.lit(100), required * 33), F.when(F.col("supplier").isNotNull(), 84).otherwise(44)))
    status = F.when(F.col("totals_ok") & F.col("integrity"), "PASS").when(F.size("issues") > 0, "REVIEW").otherwise("UNKNOWN")
    return d.select("doc", "lines", "issues", "score", "integrity", "totals_ok", (F.col("integrity") & F.col("totals_ok")).alias("posting"), status.alias("status"))


def line_evidence(lines: DataFrame) -> DataFrame:
    """Issues of each line's fields by how each was come by, from (doc, row, treatment, fields): one row for each line, without a shuffle. fields: an array of (field, value, status, formula).

    A field is proven if it was observed or confirmed, or derived by a formula from proven fields; numbers and
    trace numbers may not be inferred, and only sums may be derived. A derived tax needs an exemption.
    """

    def judged(f: Column) -> Column:
        name, status = f["field"], f["status"]
        missing = F.coalesce(F.trim(F.coalesce(f["value"], F.lit(""))) == "", F.lit(True)) | (status == "MISSING")
        derived = (status == "DERIVED") & name.isin(*DERIVABLE) & f["formula"].isNotNull()
        proven = ~missing & (status.isin("OBSERVED", "CONFIRMED") | derived)
        return F.struct(name.alias("field"), f["value"].alias("value"), status.alias("status"), missing.alias("missing"), proven.alias("proven"))

    def own(f: Column) -> Column:
        critical, status = f["field"].isin(*CRITICAL), f["status"]
        found = codes(
            ("REQUIRED_FIELD_MISSING", f["missing"]), ("FIELD_CONFLICT", status == "CONFLICT"), ("FIELD_UNREADABLE", status == "UNREADABLE"), ("CRITICAL_FIELD_INFERRED", critical & (status == "INFERRED")),
            ("CRITICAL_FIELD_DERIVATION_NOT_ALLOWED", critical & (status == "DERIVED") & ~f["field"].isin(*DERIVABLE)), ("FIELD_EVIDENCE_INSUFFICIENT", ~f["missing"] & ~f["proven"] & (status != "INFERRED")),
        )
        return F.transform(found, lambda c: F.concat(c, F.lit(":"), f["field"]))

    x = lines.withColumn("fields", F.transform("fields", judged))
    named = lambda n: F.filter("fields", lambda f: f["field"] == n)
    x = x.withColumns({f"_{n}": named(n) for n in CRITICAL})
    of = lambda name, c: F.array_max(F.transform(F.col(f"_{name}"), lambda f: f[c]))
    x = x.withColumns({n: F.coalesce(of(n, "value").try_cast("double"), F.lit(0.0)) for n in CRITICAL})
    sure = {n: F.coalesce(of(n, "proven"), F.lit(False)) for n in CRITICAL}
    value = {n: F.col(n) for n in CRITICAL}
    exempt = F.coalesce(F.col("treatment").isin("EXEMPT", "ZERO_RATED"), F.lit(False))
    is_derived = lambda n: of(n, "status") == "DERIVED"
    shaky = codes(
        ("DERIVED_EVIDENCE_NOT_PROVEN:supplyAmount", is_derived("supplyAmount") & ~(sure["quantity"] & sure["unitPrice"])), ("DERIVED_EVIDENCE_NOT_PROVEN:taxAmount", is_derived("taxAmount") & ~exempt),
        ("DERIVED_EVIDENCE_NOT_PROVEN:totalAmount", is_derived("totalAmount") & ~(sure["supplyAmount"] & sure["taxAmount"])),
    )
    supply = (value["quantity"] > 0) & (value["unitPrice"] > 0) & (F.abs(value["quantity"] * value["unitPrice"] - value["supplyAmount"]) <= 1)
    total = (value["supplyAmount"] >= 0) & (value["taxAmount"] >= 0) & (F.abs(value["supplyAmount"] + value["taxAmount"] - value["totalAmount"]) <= 1)
    x = x.withColumn("trace", trace_key(of("traceOrImportNo", "value")))
    trace = F.col("trace")
    sums = codes(("QUANTITY_UNIT_PRICE_SUPPLY_MISMATCH", ~supply), ("SUPPLY_TAX_TOTAL_MISMATCH", ~total), ("TRACE_OR_IMPORT_NO_FORMAT", (trace != "") & (~trace.rlike(TRACE_SHAPE) | dated(trace))))
    issues = F.concat(F.array_sort(F.flatten(F.transform("fields", own))), sums, shaky)
    x = x.select("doc", "row", issues.alias("issues"), F.size(F.filter("fields", lambda f: f["proven"])).cast("long").alias("proven"), *DERIVABLE)
    return x.withColumn("posting", (F.size("issues") == 0) & (F.col("proven") == len(REQUIRED)))


def evidence(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Whether each document may be posted by itself: its lines' issues and its sums against those of the lines, off by 1 at most."""
    s = lines.groupBy("doc").agg(F.count("*").alias("lines"), F.sum(F.size("issues")).alias("line_issues"), F.bool_and("posting").alias("all"), *(F.sum(c).alias(f"sum_{c}") for c in DERIVABLE))
    d = heads.join(s, "doc", "left").fillna(0, ["lines", "line_issues"])
    off = lambda c, n: F.abs(F.col(c) - F.col(f"sum_{n}")) > 1
    missing = F.col("supply").isNull() | F.col("tax").isNull() | F.col("total").isNull()
    issues = codes(("NO_LINE_ITEMS", F.col("lines") == 0), ("DOCUMENT_TOTALS_MISSING", missing), ("DOCUMENT_SUPPLY_SUM_MISMATCH", off("supply", "supplyAmount")), ("DOCUMENT_TAX_SUM_MISMATCH", off("tax", "taxAmount")), ("DOCUMENT_TOTAL_SUM_MISMATCH", off("total", "totalAmount")))
    return d.select("doc", "lines", "line_issues", issues.alias("issues"), (F.coalesce("all", F.lit(False)) & (F.size(issues) == 0)).alias("posting"))


def repaired(lines: DataFrame) -> DataFrame:
    """Lines (doc, row, name, quantity, price, amount, trace, confidence) whose numbers slipped down by one row, moved back; with the reason.

    From the first row on that repeats the numbers of the row before, or (if no document's row does) that has the next
    row's amount but wrong arithmetic, while all rows after it are right, each name takes the numbers of the next row
    and the last row goes. Documents of under three rows stay as they are.
    """
    doc = Window.partitionBy("doc")
    w, rest = doc.orderBy("row"), doc.orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    off = F.coalesce(F.abs(F.col("quantity") * F.col("price") - F.col("amount")), F.lit(0))
    x = lines.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(doc)).withColumn("off", off)
    sign = F.struct("quantity", "price", "amount", "trace")
    x = x.withColumn("right", F.max("off").over(rest) <= 1).withColumn("same", F.coalesce(sign == F.lag(sign).over(w), F.lit(False)))
    ahead = F.coalesce((F.abs(F.lead("amount").over(w) - F.col("amount")) <= 1) & (F.col("off") > 1) & F.lead("right").over(w), F.lit(False))
    inside = (F.col("i") > 1) & (F.col("i") < F.col("n")) & (F.col("n") >= 3)
    x = x.withColumn("twice", F.when(inside & F.col("same") & F.col("right"), F.col("i"))).withColumn("slipped", F.when(inside & ahead, F.col("i")))
    twice, slipped = F.min("twice").over(doc), F.min("slipped").over(doc)
    x = x.withColumn("at", F.coalesce(twice, slipped)).withColumn("reason", F.when(twice.isNotNull(), "INSERTED_DUPLICATE_NUMERIC_ROW").when(slipped.isNotNull(), "SHIFTED_NUMERIC_COLUMNS"))
    moved = F.coalesce(F.col("i") >= F.col("at"), F.lit(False))
    after = [F.when(moved, F.lead(c).over(w)).otherwise(F.col(c)).alias(c) for c in ("quantity", "price", "amount", "trace")]
    sure = F.when(moved, F.least(F.lit(80), "confidence", F.lead("confidence").over(w))).otherwise(F.col("confidence")).alias("confidence")
    out = x.select("doc", F.col("i").cast("long").alias("row"), "name", *after, sure, "reason", (F.col("at").isNotNull() & (F.col("i") == F.col("n"))).alias("gone"))
    return out.where("NOT gone").drop("gone")


def cell_issues(name: Column, origin: Column) -> Column:
    """What is wrong with a product's cell: empty, a header, only numbers, only a unit, or the origin of another column."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return codes(("PRODUCT_NAME_EMPTY", n == ""), ("PRODUCT_COLUMN_HEADER_CONTAMINATION", n.rlike(HEADER)), ("PRODUCT_COLUMN_NUMERIC_SHIFT", n.rlike(NUMERIC)), ("PRODUCT_COLUMN_UNIT_SHIFT", n.rlike(UNIT)), ("PRODUCT_COLUMN_ORIGIN_SHIFT", n.rlike(ORIGIN) & (F.coalesce(F.trim(origin), F.lit("")) != "")))


def product_decision(found: Column, confidence: Column, doubtful: Column) -> Column:
    return F.when(~found, "UNRESOLVED").when(~doubtful & (confidence >= 0.9), "AUTO_APPROVED").when(confidence >= 0.75, "SUGGESTED").otherwise("UNRESOLVED")


def met(lines: DataFrame) -> DataFrame:
    """Lines of two readings with `other`, the second reading's first line of the same amount in the document, else its first one at the same place, and `last`, the primary reading's last place.

    lines: doc, row, name, quantity, price, amount, confidence, second (whether of the second reading). They are dealt out once, by document, and sorted there; no join.
    """
    second, o = F.col("second"), F.struct("row", "name", "quantity", "price", "amount", "confidence")
    by = lambda value, *keys: F.when(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys)), value.over(Window.partitionBy(*keys)))
    x = lines.withColumn("by_amount", by(F.min(F.when(second & (F.col("amount") > 0), o)), "doc", "amount"))
    x = x.withColumn("by_place", by(F.min(F.when(second, o)), "doc", "row")).withColumn("last", by(F.max(F.when(~second, F.col("row"))), "doc"))
    return x.withColumn("other", F.coalesce("by_amount", "by_place")).drop("by_amount", "by_place")


def aligned(lines: DataFrame) -> DataFrame:
    """Each line of the primary reading with its line in the other one: the first of the same amount in the document, else the one at the same place."""
    return met(lines).where("NOT second").drop("second", "last")


def ensemble(lines: DataFrame) -> DataFrame:
    """Two readings merged: the other's numbers only where they alone are arithmetically right, its name where it is surer.

    Lines at places beyond the primary reading are the other's.
    """
    right = lambda s: F.coalesce((s("quantity") > 0) & (s("price") > 0) & (s("amount") > 0) & (js_round(s("quantity") * s("price")) == js_round(s("amount"))), F.lit(False))
    p, o = (lambda c: F.col(c)), (lambda c: F.col(f"other.{c}"))
    a = met(lines).where(~F.col("second") | (F.col("row") > F.coalesce("last", F.lit(0)))).withColumn("other", F.when(~F.col("second"), F.col("other")))
    numbers = right(o) & ~right(p)
    named = F.coalesce((F.length(F.trim(o("name"))) >= 2) & (o("confidence") > p("confidence")), F.lit(False))
    name = F.when(F.col("second"), F.col("name")).when(named, F.trim(o("name"))).otherwise(F.trim("name"))
    return a.select("doc", "row", name.alias("name"), *(F.when(numbers, o(c)).otherwise(p(c)).alias(c) for c in NUMBERS), F.greatest("confidence", o("confidence")).alias("confidence"))


def rank(arithmetic: Column, totals: Column, lines: Column, issues: Column) -> Column:
    return sum((F.when(c, n).otherwise(0) for c, n in ((arithmetic, 4), (totals, 3), (lines > 0, 2), (issues == 0, 1))), F.lit(0))


def best_results(results: DataFrame, key: str) -> DataFrame:
    """The best reading of each document: by rank, score, lines and confidence, then by provider; with whether it still calls for another."""
    order = F.struct("rank", "score", "lines", "confidence", (-F.col("provider")).alias("provider"))
    best = results.groupBy(key).agg(F.max(order).alias("b"))
    return best.select(key, "b.rank", "b.score", "b.lines", (-F.col("b.provider")).alias("provider"), ((F.col("b.score") < 92) | (F.col("b.lines") == 0) | (F.col("b.rank") < 4)).alias("again"))


def local_route(table: Column, arithmetic: Column, unseen: Column, required: Column, millis: Column, pages: Column, price: float, most: float = 100) -> Column:
    """Where a local reading goes next: accept, compare fields, an outside layout reader within its cost, or review."""
    return (
        F.when(arithmetic & (table >= 95) & (required >= 95), "LOCAL_ACCEPT").when(~unseen & (table >= 80) & (millis < 3000), "SELECTIVE_COMPARE")
        .when((unseen | (table < 80)) & (pages * price <= most), "EXTERNAL_LAYOUT_COMPARE").otherwise("REVIEW_REQUIRED")
    )


def vision_route(complete: Column, arithmetic: Column, exact: Column, trace: Column, matched: Column, tried: Column, configured: bool = True) -> Column:
    return F.when(complete & arithmetic & exact & trace & (matched >= 80), "APPROVAL_CANDIDATE").when(F.lit(configured) & ~tried, "GEMINI_COMPARE").otherwise("REVIEW_REQUIRED")


def signals(checked: DataFrame, heads: DataFrame, lines: DataFrame, known: Column) -> DataFrame:
    """What the route of a document depends on: completeness, arithmetic, trace numbers and the percentage of known products."""
    key = trace_key(F.coalesce("trace", F.lit("")))
    good = key.rlike(TRACE_SHAPE) & ~dated(key)
    s = lines.groupBy("doc").agg(F.count_if(key != "").alias("traces"), F.count_if((key != "") & ~good).alias("bad"), F.count_if(known).alias("known"))
    d = checked.join(heads.select("doc", "supplier", "invoice_date", "total"), "doc").join(s, "doc", "left").fillna(0, ["traces", "bad", "known"])
    complete = F.col("supplier").isNotNull() & F.col("invoice_date").isNotNull() & F.coalesce(F.col("total") > 0, F.lit(False)) & (F.col("lines") > 0)
    return d.select(
        "doc", complete.alias("complete"), F.col("integrity").alias("arithmetic"), F.col("posting").alias("exact"), ((F.col("traces") > 0) & (F.col("bad") == 0)).alias("trace"),
        F.when(F.col("lines") > 0, js_round(100 * F.col("known") / F.col("lines"))).otherwise(0).cast("long").alias("matched"), F.when(F.col("lines") > 0, F.least(F.lit(100), 70 + F.col("lines") * 4)).otherwise(0).alias("table"),
    )


def intake(quality: Column, warnings: Column, sizes: dict[str, Column]) -> Column:
    """(reasons, path): a scan is taken again only where it is unusable; from 85 on it needs no review."""
    warned = lambda w: F.array_contains(warnings, w)
    reasons = codes(
        ("LOW_QUALITY", quality < 35), ("LOW_RESOLUTION", warned("LOW_RESOLUTION") & (F.least(sizes["width"], sizes["height"]) < 500)), ("LOW_BRIGHTNESS", warned("LOW_BRIGHTNESS") & (sizes["brightness"] < 45)),
        ("LOW_CONTRAST", warned("LOW_CONTRAST") & (sizes["contrast"] < 12)), ("SHADOW_RISK", warned("SHADOW_RISK") & (sizes["dark"] > 70)), ("BLUR_RISK", warned("BLUR_RISK") & (sizes["edges"] < 5)),
        ("ROTATION_REVIEW_REQUIRED", warned("ROTATION_RECOMMENDED") | warned("ROTATION_REVIEW_REQUIRED")),
    )
    return F.struct(reasons.alias("reasons"), F.when(F.size(reasons) > 0, "RECAPTURE_PATH").when(quality >= 85, "AUTO_PATH").otherwise("REVIEW_PATH").alias("path"))


def withheld(heads: DataFrame, damage: dict[str, Column]) -> DataFrame:
    """Documents with their totals emptied where any damage flag is set, and the reasons."""
    reasons = codes(*damage.items())
    hide = [F.when(F.size("reasons") == 0, F.col(c)).alias(c) for c in ("supply", "tax", "total")]
    return heads.withColumn("reasons", reasons).select("doc", *hide, "reasons")


def stabilised(lines: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Lines named as confirmed before for the same supplier and numbers; confirmed: supplier, quantity, price, amount, product, one row a key."""
    key = ["supplier", "quantity", "price", "amount"]
    x = lines.join(confirmed.groupBy(*key).agg(F.max("product").alias("product")), key, "left")
    return x.withColumn("name", F.coalesce("product", "name")).withColumn("confidence", F.when(F.col("product").isNotNull(), F.greatest("confidence", F.lit(95))).otherwise(F.col("confidence"))).withColumn("stabilised", F.col("product").isNotNull()).drop("product")


def zoomed(first: Column, zoom: Column, confidence: Column, status: Column, least: float = 0.9) -> Column:
    """(source, suggestion, review): a second reading verifies the first, suggests another name, or leaves it open."""
    readable = F.coalesce((status == "READABLE") & (confidence >= least) & (F.trim(zoom) != ""), F.lit(False))
    changed = readable & (fingerprint(zoom) != fingerprint(first))
    source = F.when(~readable, "SMART_ZOOM_UNRESOLVED").when(changed, "SMART_ZOOM_SUGGESTED").otherwise("SMART_ZOOM_VERIFIED")
    return F.struct(source.alias("source"), F.when(changed, F.trim(zoom)).alias("suggestion"), (~readable | changed).alias("review"))


def marked_duplicates(docs: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Documents with the first one of the same key; the later ones are duplicates of it."""
    first = F.first(name).over(Window.partitionBy(*key).orderBy(*order, name))
    return docs.withColumn("first", first).withColumn("duplicate_of", F.when(F.col("first") != F.col(name), F.col("first"))).drop("first")


def eligible(samples: DataFrame, rules: dict[str, Column], digest: Column) -> DataFrame:
    """Samples that break no rule, one for each digest: the first by id; the others with what is wrong."""
    x = samples.withColumn("errors", codes(*rules.items())).withColumn("digest", digest)
    k = F.row_number().over(Window.partitionBy("digest", F.size("errors") == 0).orderBy("id"))
    again = (F.size("errors") == 0) & (k > 1)
    return x.withColumn("errors", F.when(again, F.array(F.lit("DUPLICATE_CONTENT_HASH"))).otherwise(F.col("errors"))).drop("digest")


def parsed_lines(line: Column) -> Column:
    """An array of (name, quantity, unit, price, amount) of a printed line, whose last three numbers are quantity, price and amount; empty for other lines.

    Each step is a function over an array of one, so that nothing is split or matched twice.
    """
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    number = lambda t: F.regexp_replace(t, ",", "").try_cast("double")
    numbers = lambda t: F.filter(F.transform(t, lambda w, i: F.when(w.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$"), i)), lambda i: i.isNotNull())

    def of(s: Column) -> Column:
        t, q, p, a = s["tokens"], F.element_at(s["at"], -3), F.element_at(s["at"], -2), F.element_at(s["at"], -1)
        between = F.filter(F.slice(t, q + 2, p - q - 1), lambda x: x.rlike("(?i)^(kg|g|box|팩|개|박스)$"))
        return F.struct(F.array_join(F.slice(t, F.lit(1), q), " ").alias("name"), number(F.get(t, q)).alias("quantity"), F.coalesce(F.get(between, F.lit(0)), F.lit("kg")).alias("unit"), number(F.get(t, p)).alias("price"), number(F.get(t, a)).alias("amount"))

    split = F.transform(F.filter(F.array(tokens), lambda t: F.size(t) >= 4), lambda t: F.struct(t.alias("tokens"), numbers(t).alias("at")))
    usable = F.filter(F.filter(split, lambda s: F.size(s["at"]) >= 3), lambda s: F.element_at(s["at"], -3) > 0)
    return F.filter(F.transform(usable, of), lambda x: x["quantity"] > 0)


def last_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,.]*"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def region_item(both: Column, quantity: Column, price: Column, amount: Column) -> Column:
    """(quantity, price, amount) of a region's fields: the last number of each, else the last two of the field that holds both."""
    end = lambda c, k: F.when(F.size(last_numbers(c)) >= k, F.element_at(last_numbers(c), -k))
    return F.struct(F.coalesce(end(quantity, 1), end(both, 2), F.lit(0.0)).alias("quantity"), F.coalesce(end(price, 1), end(both, 1), F.lit(0.0)).alias("price"), F.coalesce(end(amount, 1), F.lit(0.0)).alias("amount"))
