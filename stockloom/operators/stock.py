"""Replenishment, invoice checks and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import clamp, z_score

#: Service level, review days, lead days, shelf life in days and risk factor of each policy class.
POLICIES = {
    "F1_CORE_FRESH": (0.90, 1, 1, 5, 1.0),
    "F2_SHORT_LIFE_PROCESSED": (0.78, 1, 1, 2, 0.55),
    "F3_PREMIUM_INTERMITTENT": (0.72, 3, 2, 7, 0.45),
    "F4_FROZEN_BUFFER": (0.92, 7, 3, 60, 1.1),
    "F5_TRANSFORMABLE_RAW": (0.86, 2, 2, 7, 0.8),
}
#: Prior rate, its least and greatest value, and its weight in kilograms.
YIELDS = {"DIRECT_RETAIL": (0.96, 0.90, 0.99, 30), "TRIM_STANDARD": (0.88, 0.78, 0.96, 50), "BONE_IN_COMPLEX": (0.75, 0.60, 0.88, 70), "MULTI_OUTPUT": (0.85, 0.68, 0.94, 80)}


def policy_class(name: Column, demand: Column | None = None) -> Column:
    """The first class whose words occur in a product's name, storage and category; premium only under a demand of 2 a day, none given counting as 0."""
    t = F.lower(name)
    rare = F.coalesce(demand, F.lit(0)) < 2 if demand is not None else F.lit(True)
    return (
        F.when(t.rlike("냉동|frozen"), "F4_FROZEN_BUFFER").when(t.rlike("다짐|세절|양념|해동|가공"), "F2_SHORT_LIFE_PROCESSED").when(t.rlike("특수|한우|와규|안심|채끝") & rare, "F3_PREMIUM_INTERMITTENT")
        .when(t.rlike("원육|미박|전지|후지|앞다리|뒷다리"), "F5_TRANSFORMABLE_RAW").otherwise("F1_CORE_FRESH")
    )


def demand_series(sales: DataFrame, keys: list[str], day: str, days: int = 56) -> DataFrame:
    """One row for each key and each of the last days up to day, without gaps: sold amounts, 0 where nothing was sold."""
    last = F.lit(day).cast("date")
    sold = sales.where(F.col("sale_date").between(F.date_sub(last, days - 1), last)).groupBy(*keys, "sale_date").agg(F.sum("amount").cast("double").alias("sold"))
    all_days = sold.select(*keys).distinct().withColumn("sale_date", F.explode(F.sequence(F.date_sub(last, days - 1), last)))
    return all_days.join(sold, [*keys, "sale_date"], "left").withColumn("sold", F.coalesce("sold", F.lit(0.0)))


def demand_stats(series: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Mean of 7 days weighing 0.65 and of all days 0.35, sample deviation, days and confidence."""
    recent = F.col("sale_date") > F.date_sub(F.lit(day).cast("date"), 7)
    s = series.groupBy(*keys).agg(F.avg("sold").alias("mean"), F.avg(F.when(recent, F.col("sold"))).alias("recent"), F.coalesce(F.stddev_samp("sold"), F.lit(0.0)).alias("deviation"), F.count("*").alias("days"))
    return s.select(*keys, F.round(F.col("recent") * 0.65 + F.col("mean") * 0.35, 3).alias("demand"), F.round("deviation", 3).alias("deviation"), "days", F.round(clamp(0.25 + F.col("days") / 56, 0.25, 0.95), 2).alias("confidence"))


def safety_stock(d: DataFrame, policy: str) -> DataFrame:
    """Order quantities from demand, deviation, days, confidence, on_hand, waste, pack, moq, stock_confidence and lead_samples.

    Where there are a yield_rate and yield_sure, the need is divided by the rate; else all is sold as it comes. REDUCE overrides ORDER
    and HOLD, REVIEW overrides all; the least order quantity isn't rounded to packs again.
    """
    if "yield_rate" not in d.columns:
        d = d.withColumns({"yield_rate": F.lit(1.0), "yield_sure": F.lit(0.8)})
    level, review, lead, shelf, risk = POLICIES[policy]
    z = z_score(F.lit(level))
    d = d.withColumn("safety", z * F.col("deviation") * F.sqrt(F.lit(lead)) * risk)
    cap = F.when(F.col("demand") > 0, F.col("demand") * shelf * 0.9).otherwise(F.lit(float("inf")))
    d = d.withColumn("cap", cap).withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("demand") * (lead + review) + F.col("safety"), "cap")))
    d = d.withColumn("available", F.greatest(F.lit(0.0), F.col("on_hand") - F.col("waste"))).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("available")))
    order = F.when(F.col("need") <= 0, 0.0).otherwise(F.greatest(F.col("moq"), F.ceil(F.col("need") / clamp(F.col("yield_rate"), 0.05, 1.0) / F.col("pack")) * F.col("pack")))
    sure = clamp(F.col("confidence") * 0.35 + F.col("stock_confidence") * 0.30 + F.least(F.lit(1.0), F.col("lead_samples") / 20) * 0.20 + F.col("yield_sure") * 0.15, 0.0, 0.98)
    d = d.withColumn("recommended", order.cast("double")).withColumn("sure", sure)
    blocked = (F.col("cap") < float("inf")) & (F.col("available") >= F.col("cap"))
    action = F.when((F.col("sure") < 0.55) | (F.col("days") < 7), "REVIEW").when((F.col("waste") > 0) | blocked, "REDUCE").when(F.col("recommended") > 0, "ORDER").otherwise("HOLD")
    point = F.round(F.col("demand") * lead + F.col("safety"), 3)
    return d.withColumn("reorder_point", point).withColumn("target", F.round("target", 3)).withColumn("recommended", F.round("recommended", 3)).withColumn("action", action)


def reason_codes(days: Column, stock_confidence: Column, waste: Column, yield_rate: Column, yield_sure: Column) -> Column:
    """Why a proposal may be trusted or not: history, stock, expiry, yield."""
    return F.array(
        F.when(days < 56, "DEMAND_HISTORY_SHORT").otherwise("DEMAND_HISTORY_OK"), F.when(stock_confidence < 0.95, "INVENTORY_CHECK_REQUIRED").otherwise("INVENTORY_TRUSTED"),
        F.when(waste > 0, "EXPIRY_RISK").otherwise("EXPIRY_CLEAR"), F.when((yield_rate < 1) & (yield_sure < 0.75), "YIELD_LEARNING").otherwise("YIELD_READY"),
    )


def fresh_proposals(on_hand: DataFrame, sold: DataFrame, yields: DataFrame, day: str, policy: str) -> DataFrame:
    """Replenishment of products that have stock (product, on_hand, waste) or were sold (product, sale_date, amount) in 56 days: what to do, how much, how surely and why.

    yields: product, rate, confidence. place is the action's place in the list: orders, reductions, reviews, the rest.
    """
    stats = demand_stats(demand_series(sold, ["product"], day), ["product"], day)
    x = on_hand.join(stats, "product", "full").where("on_hand > 0 OR days IS NOT NULL").join(yields.select("product", "rate", F.col("confidence").alias("known")), "product", "left")
    x = x.fillna({"on_hand": 0.0, "waste": 0.0, "demand": 0.0, "deviation": 0.0, "days": 0, "confidence": 0.25})
    given = {"pack": F.lit(1.0), "moq": F.lit(0.0), "stock_confidence": F.lit(0.7), "lead_samples": F.lit(0), "yield_rate": F.coalesce("rate", F.lit(1.0)), "yield_sure": F.coalesce("known", F.lit(0.4))}
    p = safety_stock(x.withColumns(given), policy)
    reasons = F.array_join(reason_codes(F.col("days"), F.col("stock_confidence"), F.col("waste"), F.col("yield_rate"), F.col("yield_sure")), ",")
    return p.withColumn("sure", F.round("sure", 2)).withColumn("reasons", reasons).withColumn("place", action_rank(F.col("action")))


def yield_profile(observed: DataFrame, keys: list[str], prior: str) -> DataFrame:
    """Posterior yield of valid observations (input, output, byproduct, loss): those whose masses balance within a tenth."""
    rate, low, high, kg = YIELDS[prior]
    residual = F.abs(F.col("input") - F.col("output") - F.col("byproduct") - F.col("loss")) / F.col("input")
    ok = F.when(F.col("input") > 0, residual <= 0.10).otherwise(False) & (F.col("output") >= 0)
    s = observed.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("double").alias(c) for c in ("input", "output", "loss")), F.count_if(ok).alias("n"))
    post = (rate * kg + F.col("output")) / (kg + F.col("input"))
    source = F.when(F.col("n") >= 30, "STORE_LEARNED").when(F.col("n") > 0, "BLENDED").otherwise("PRIOR")
    loss = F.when(F.col("input") > 0, F.col("loss") / F.col("input")).otherwise(1 - rate)
    sure = clamp(0.25 + F.col("n") / 40 + F.col("input") / 500, 0.25, 0.98)
    return s.select(*keys, F.round(clamp(post, low, high), 4).alias("rate"), F.round(loss, 4).alias("loss_rate"), "n", F.round(sure, 2).alias("confidence"), source.alias("source"))


def stock_status(on_hand: Column, safe: Column) -> Column:
    return F.when(on_hand <= safe * 0.5, "danger").when(on_hand < safe, "warn").otherwise("ok")


def reorder(on_hand: Column, safe: Column, moq: Column) -> Column:
    return F.when(on_hand < safe, F.greatest(moq, F.ceil(safe * 1.5 - on_hand)))


def line_issues(lines: DataFrame, doc: str, order: list[str], printed: str) -> DataFrame:
    """Issues of each document: printed count, row numbers, arithmetic off by more than 1, rows equal to the one before.

    lines: doc, row_no, quantity, unit_price, supply, trace and the printed number of lines.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    known = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("supply").isNotNull()
    text = lambda c, n: F.format_number(F.col(c), n)
    same = F.when(known, F.concat_ws("|", text("quantity", 3), text("unit_price", 2), text("supply", 2), F.regexp_replace(F.coalesce("trace", F.lit("")), r"\s+", "")))
    i = F.row_number().over(w)
    wrong = known & (F.abs(F.col("quantity") * F.col("unit_price") - F.col("supply")) > 1)
    rows = lines.select(doc, *order, F.col("row_no"), F.col(printed).alias("printed"), wrong.alias("wrong"), same.alias("text"))
    rows = rows.withColumn("i", i).withColumn("again", F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False)))
    # a row that repeats its predecessor isn't remembered, so only the second row of a run is flagged
    rows = rows.select(doc, *order, "row_no", "printed", "wrong", "i", "again").withColumn("twice", F.col("again") & ~F.lag("again", 1, False).over(w))
    places = rows.select(doc, "printed", F.coalesce(F.col("row_no") != F.col("i"), F.lit(True)).alias("gap"), F.when(F.col("wrong"), F.col("i")).alias("wrong"), F.when(F.col("twice"), F.col("i")).alias("twice"))
    docs = places.groupBy(doc).agg(F.count("*").alias("n"), F.max("printed").alias("printed"), F.max("gap").alias("gap"), F.collect_list("wrong").alias("wrong"), F.collect_list("twice").alias("twice"))
    told = F.concat(F.transform("wrong", lambda k: F.concat(F.lit("ROW_ARITHMETIC_MISMATCH:"), k)), F.transform("twice", lambda k: F.concat(F.lit("ADJACENT_ROW_VALUE_DUPLICATE:"), k - 1, F.lit(":"), k)))
    docs = docs.withColumn("row_issues", F.array_sort(told))
    count = F.when((F.col("printed") > 0) & (F.col("printed") != F.col("n")), F.concat(F.lit("PRINTED_LINE_COUNT_MISMATCH:"), F.col("printed"), F.lit(":"), F.col("n")))
    return docs.select(doc, F.concat(F.array_compact(F.array(count, F.when(F.col("gap"), "ROW_NUMBER_DUPLICATE_OR_GAP"))), "row_issues").alias("issues"))


def line_amount(supply: Column, total: Column, quantity: Column, price: Column) -> Column:
    return F.when(supply > 0, supply).when(total > 0, total).otherwise(F.coalesce(quantity * price, F.lit(0)))


def page_summary(pages: DataFrame, doc: str) -> DataFrame:
    """Totals of documents whose pages have a subtotal and a displayed total; the commonest displayed total if it repeats."""
    shown = pages.where("displayed > 0").groupBy(doc, "displayed").agg(F.count("*").alias("k"), F.min("page").alias("first"))
    mode = shown.groupBy(doc).agg(F.max(F.struct("k", -F.col("first"), "displayed")).alias("m")).select(doc, F.when(F.col("m.k") > 1, F.col("m.displayed")).otherwise(0).alias("repeated"))
    s = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum("subtotal").cast("double").alias("actual"), F.sum("displayed").cast("double").alias("displayed_sum"))
    return s.join(mode, doc, "left").select(doc, "pages", "actual", "displayed_sum", F.coalesce("repeated", F.lit(0)).cast("double").alias("repeated"))


def sanitation_points(rating: Column) -> Column:
    """10, 5 or 1 points for the ratings 1, 2 and 3; nothing for others."""
    return F.when(rating == 1, 10).when(rating == 2, 5).when(rating == 3, 1).otherwise(0)


def sanitation_score(ratings: Column) -> Column:
    return F.aggregate(ratings, F.lit(0), lambda a, r: a + sanitation_points(r))


def temperature_issues(fridge: Column, freezer: Column) -> Column:
    return F.array_compact(F.array(F.when(fridge > 5, "FRIDGE_ABOVE_5"), F.when(freezer > -18, "FREEZER_ABOVE_-18")))


def document_checks(lines: DataFrame, doc: str) -> DataFrame:
    """Validation of each document from its lines (quantity, unit_price, amount, confidence, known) and its total.

    Score: a quarter each for reading confidence and arithmetic, a fifth for the table, 15 hundredths each
    for required fields and known names, all of 100.
    """
    right = F.abs(F.col("quantity") * F.col("unit_price") - F.col("amount")) <= 1
    share = lambda x: F.avg(F.when(x, 100.0).otherwise(0.0))
    s = lines.groupBy(doc).agg(
        F.count("*").alias("lines"), F.avg("confidence").alias("ocr"), share(F.coalesce(right, F.lit(False))).alias("arithmetic"),
        share(F.col("quantity").isNotNull() & F.col("amount").isNotNull()).alias("required"), share("known").alias("alias"), F.sum("amount").alias("sum"), F.max("total").alias("total"),
    )
    score = F.round(F.col("ocr") * 0.25 + 100 * 0.20 + F.col("arithmetic") * 0.25 + F.col("required") * 0.15 + F.col("alias") * 0.15, 2)
    return s.select(doc, "lines", score.alias("score"), (F.abs(F.col("sum") - F.col("total")) <= 1).alias("sum_ok"), grade(score).alias("grade"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("E")


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller box; boxes have x, y, w and h."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    least = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(least > 0, side("x", "w") * side("y", "h") / least).otherwise(0.0)


def token_cost(calls: Column, tokens_in: float, tokens_out: float, rate_in: float, rate_out: float) -> Column:
    return calls * (tokens_in * rate_in + tokens_out * rate_out) / 1_000_000


def repeated_rows(lines: DataFrame, doc: str, order: str, columns: list[str]) -> DataFrame:
    """Rows equal to the one before in all of these columns, with the next row's amount."""
    w = Window.partitionBy(doc).orderBy(order)
    sign = F.struct(*columns)
    return lines.withColumn("same", sign == F.lag(sign).over(w)).withColumn("next_amount", F.lead("amount").over(w)).where("same").drop("same")


def action_rank(action: Column) -> Column:
    """Orders first, then what is to be reduced, reviewed and held."""
    return F.when(action == "ORDER", 0).when(action == "REDUCE", 1).when(action == "REVIEW", 2).otherwise(3)
