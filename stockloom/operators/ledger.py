"""Ledger operators: balances, summaries, briefs, joins and windows over sales and stock movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amount(x: Column) -> Column:
    """A sum of money as double, after exact decimal addition."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("double")


def active(sales: DataFrame) -> DataFrame:
    return sales.where(~F.coalesce("is_cancelled", F.lit(False)))


def signed(x: str) -> Column:
    """Only OUT negates; ADJUST always adds."""
    return F.when(F.col("kind") == "OUT", -F.col(x)).otherwise(F.col(x))


def inventory_balance(moves: DataFrame) -> DataFrame:
    """Signed quantity and amount, rows and last day by company, product and origin, of active rows."""
    m = moves.where("is_active")
    return m.groupBy("company", "product", "origin").agg(amount(signed("qty")).alias("qty"), amount(signed("amount")).alias("amount"), F.count("*").alias("n"), F.max("day").alias("last_day"))


def inventory_summary(moves: DataFrame) -> DataFrame:
    m = moves.where("is_active")
    out = m.groupBy("company", "store", "product").agg(amount(signed("qty")).alias("qty"), amount(signed("amount")).alias("amount"))
    return out.withColumn("low_stock", F.col("qty") <= 0)


def sales_summary(sales: DataFrame, bucket: Column, cancelled: bool = False) -> DataFrame:
    """Count and amount by company, store and bucket; the backfill also counts cancelled rows."""
    rows = sales if cancelled else active(sales)
    return rows.groupBy("company", "store", bucket.alias("bucket")).agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


def purchase_summary(invoices: DataFrame, pattern: str) -> DataFrame:
    """Posted documents by the invoice date, or else the day of creation."""
    day = F.coalesce("invoice_date", F.to_date("created_at"))
    rows = invoices.where("status = 'POSTED'")
    return rows.groupBy("company", "store", F.date_format(day, pattern).alias("bucket")).agg(F.count("*").alias("n"), amount(F.col("total")).alias("amount"))


def money_brief(sales: DataFrame, moves: DataFrame, cards: DataFrame, day: str) -> DataFrame:
    """One row: today, yesterday, its weekday a week earlier (day - 8), the month's sales and purchases, unmapped codes, deposits, expiring rows.

    The unmapped codes are the top 20 and aren't bounded by date.
    """
    d = F.lit(day).cast("date")
    month = F.trunc(d, "month")
    s = active(sales).where(F.col("sale_date").between(F.least(month, F.date_sub(d, 8)), d))

    def on(x: Column, of: str = "amount") -> Column:
        return amount(F.when(x, F.col(of)))

    sold = s.agg(
        on(F.col("sale_date") == d).alias("today"), on(F.col("sale_date") == F.date_sub(d, 1)).alias("yesterday"), on(F.col("sale_date") == F.date_sub(d, 8)).alias("last_week_same_day"),
        on(F.col("sale_date").between(month, d)).alias("month_sales"), F.count_if(F.col("sale_date") == d).alias("today_n"),
    )
    codes = F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "code"))).getField("code")).alias("codes")
    top = unmapped_codes(sales, 20).agg(F.count("*").alias("unmapped_codes"), codes, F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped_n"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("unmapped_amount"))
    due = cards.where((F.col("status") == "SCHEDULED") & F.col("deposit_date").between(d, F.date_add(d, 6))).agg(F.count("*").alias("deposits_n"), amount(F.col("amount") - F.col("fee")).alias("deposits"))
    old = moves.where(F.col("is_active") & F.col("expiry").between(d, F.date_add(d, 3))).agg(F.count("*").alias("expiring_n"))
    bought = month_purchases(moves, day).select(F.col("amount").alias("month_purchases"))
    return sold.crossJoin(top).crossJoin(due).crossJoin(old).crossJoin(bought).withColumn("day", d)


def month_purchases(moves: DataFrame, day: str) -> DataFrame:
    """Goods received from the month's first day to the day, but for those that a cancelled sale put back."""
    d = F.lit(day).cast("date")
    rows = moves.where(F.col("is_active") & (F.col("kind") == "IN") & F.col("day").between(F.trunc(d, "month"), d) & ~F.coalesce(F.col("memo").startswith("판매취소 재고원복"), F.lit(False)))
    return rows.agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


def unmapped_codes(sales: DataFrame, top: int) -> DataFrame:
    rows = active(sales).where("needs_mapping")
    return rows.groupBy("code").agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"), F.max("barcode").alias("barcode")).orderBy(F.desc("n"), "code").limit(top)


def card_deposits(cards: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    rows = cards.where((F.col("status") == "SCHEDULED") & F.col("deposit_date").between(d, F.date_add(d, 6)))
    return rows.groupBy("deposit_date").agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


def channel_sales(sales: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    rows = active(sales).where(F.col("sale_date").between(F.trunc(d, "month"), d))
    now = F.col("sale_date") == d
    return rows.groupBy("channel").agg(F.count_if(now).alias("today_n"), amount(F.when(now, F.col("amount"))).alias("today"), F.count("*").alias("month_n"), amount(F.col("amount")).alias("month"))


def kpi(rows: DataFrame, day_col: str, amount_col: str, day: str) -> DataFrame:
    """Month to date, week to date (weeks start on Monday) and today."""
    d = F.lit(day).cast("date")
    spans = {"month": F.trunc(d, "month"), "week": F.trunc(d, "week"), "today": d}
    inside = {k: F.col(day_col).between(v, d) for k, v in spans.items()}
    return rows.agg(*(f for k, c in inside.items() for f in (F.count_if(c).alias(f"{k}_n"), amount(F.when(c, F.col(amount_col))).alias(k))))


def calendar(sales: DataFrame, month: str) -> DataFrame:
    """Sums by day, by week of the month and for the month; a null day or week marks a total."""
    m = F.lit(month).cast("date")
    rows = active(sales).where(F.trunc("sale_date", "month") == m).withColumn("week", F.trunc("sale_date", "week"))
    return rows.rollup("week", F.col("sale_date").alias("day")).agg(F.count("*").alias("n"), amount(F.col("amount")).alias("amount"))


def reconcile(raw: DataFrame, summary: DataFrame) -> DataFrame:
    a = raw.agg(amount(F.col("amount")).alias("raw"))
    b = summary.agg(F.round(F.sum("amount"), 2).alias("summary"))
    return a.crossJoin(b).withColumn("equal", F.round("raw", 2) == F.col("summary"))


def allocate(lines: DataFrame, group: str, order: list[str], weight: str, total: str) -> DataFrame:
    """Each line's share of total in proportion to weight, to two decimals; the last line takes the residual."""
    g = Window.partitionBy(group)
    o = g.orderBy(*order)
    part = F.round(F.col(total) * F.col(weight) / F.sum(weight).over(g), 2).cast("decimal(18,2)")
    before = F.coalesce(F.sum("share").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(o) == F.count("*").over(g)
    out = lines.withColumn("share", part)
    return out.withColumn("allocated", F.when(last, F.col(total) - before).otherwise(F.col("share")).cast("decimal(18,2)")).drop("share")


def repeated(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def override_lookup(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """The mapping row of the event's store if there is one, else the one for all stores; of several the last updated, so that events don't multiply."""
    mapping = latest_per_key(mapping, ["key", "store"], [F.desc("updated"), F.desc("price"), F.asc("product")])
    own = mapping.where("store IS NOT NULL").select(F.col("key").alias("k1"), F.col("store").alias("s1"), F.struct("product", "price", "weigh").alias("own"))
    any_ = mapping.where("store IS NULL").select(F.col("key").alias("k2"), F.struct("product", "price", "weigh").alias("any"))
    e = events.join(own, (F.col("code") == F.col("k1")) & (F.col("store") == F.col("s1")), "left").join(any_, F.col("code") == F.col("k2"), "left")
    return e.withColumn("map", F.coalesce("own", "any")).drop("k1", "s1", "own", "k2", "any")


def scan_sale(scans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sales that scan events make: one for each transaction, with amount, quantity and status.

    The first event of a transaction counts, the others are duplicates. A price label carries the amount,
    a weight label grams; unmapped labels sell for the amount in the label and wait for a mapping.
    """
    w = Window.partitionBy("company", "txn").orderBy("sold_at", "id")
    s = override_lookup(scans.withColumn("duplicate", F.row_number().over(w) > 1), mapping)
    embedded = F.substring("barcode", 8, 5).cast("decimal(18,3)")
    kind, price = F.col("map.weigh"), F.col("map.price")
    qty = F.when(kind == "WEIGHT_EMBED", F.round(embedded / 1000, 3)).when(kind == "PRICE_EMBED", F.round(F.try_divide(embedded, price), 3)).when(kind == "FIXED", 1).when(kind == "MANUAL", None)
    value = F.when(kind == "WEIGHT_EMBED", F.round(embedded / 1000 * price, 2)).when(kind == "PRICE_EMBED", embedded).when(kind == "FIXED", price).when(kind.isNull(), embedded)
    status = F.when(F.col("duplicate"), "DUPLICATE").when(~F.col("barcode").rlike("^2[0-9]{12}$"), "FAILED").when(value.isNull(), "PENDING").otherwise("PROCESSED")
    out = s.withColumn("status", status).withColumn("quantity", qty.cast("decimal(18,3)")).withColumn("value", value.cast("decimal(18,2)"))
    return out.select("id", "company", "store", "txn", "status", F.col("map.product").alias("product"), F.col("quantity").cast("double").alias("quantity"), F.col("value").cast("double").alias("value"), kind.isNull().alias("needs_mapping"))


def time_slot(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000))


def recent_duplicates(web: DataFrame, pos: DataFrame, seconds: int = 7200) -> DataFrame:
    """Web scans with a POS scan of the same barcode within so many seconds on either side, and the earliest such time.

    Scans meet by barcode and slot of time, a web scan in its own slot and both neighbours, so a hot barcode is
    joined slot by slot.
    """
    p = pos.select(F.col("company").alias("pc"), F.col("barcode").alias("pb"), F.col("sold_at").alias("pt"), time_slot(F.col("sold_at"), seconds).alias("ps"))
    apart = F.abs(F.unix_micros(F.col("sold_at").cast("timestamp")) - F.unix_micros(F.col("pt").cast("timestamp")))
    slot = time_slot(F.col("sold_at"), seconds)
    w = web.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    near = w.join(p, (F.col("barcode") == F.col("pb")) & (F.col("company") == F.col("pc")) & (F.col("slot") == F.col("ps")) & (apart <= seconds * 1_000_000))
    return near.groupBy("id", "barcode").agg(F.min("pt").alias("pos_at"), F.count("*").alias("n"))


def seen_before(web: DataFrame, pos: DataFrame, seconds: int = 7200) -> DataFrame:
    """Web scans whose code a POS scan recorded within so many seconds before, with the latest such time."""
    p = pos.select(F.col("code").alias("pc"), F.col("sold_at").alias("pt"), time_slot(F.col("sold_at"), seconds).alias("ps"))
    slot, since = time_slot(F.col("sold_at"), seconds), F.unix_micros(F.col("sold_at").cast("timestamp")) - F.unix_micros(F.col("pt").cast("timestamp"))
    w = web.withColumn("slot", F.explode(F.array(slot - 1, slot)))
    near = w.join(p, (F.col("code") == F.col("pc")) & (F.col("slot") == F.col("ps")) & since.between(0, seconds * 1_000_000))
    return near.groupBy("id").agg(F.max("pt").alias("pos_at"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """new over old: for each key the row of the highest version, of new on ties. No table format is needed."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")
