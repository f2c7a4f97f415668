"""Orders and sales that post to the ledger: delivery orders, channel and manual sales, observed scans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockloom.sources.sinks import written

from .ledger import allocate, latest_per_key, override_lookup

BARCODE = "^[0-9A-Za-z._-]{6,64}$"
SCALE = "^2[0-9]{12}$"
#: The channels of sales.
CHANNELS = ("STORE", "COUPANG", "BAEMIN", "YOGIYO", "MEATBONGA", "ETC")


def dec(x: Column, places: int = 2) -> Column:
    return F.round(x, places).cast(f"decimal(18,{places})")


def with_values(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """lines (code, store, barcode, quantity, amount) with product, the quantity and amount that their mapping's kind gives, and whether a mapping exists.

    A given quantity wins; price labels carry the amount, weight labels grams, fixed goods count one; else the given values stand.
    """
    x = override_lookup(lines, mapping)
    value = F.when(F.col("barcode").rlike(SCALE), F.substring("barcode", 8, 5).cast("decimal(18,3)"))
    kind, price = F.col("map.weigh"), F.col("map.price")
    by_price, by_weight, fixed = (kind == "PRICE_EMBED") & value.isNotNull() & (price > 0), (kind == "WEIGHT_EMBED") & value.isNotNull(), (kind == "FIXED") & (price > 0)
    given = F.coalesce(F.col("quantity") > 0, F.lit(False)) & (kind == "MANUAL")
    qty = F.when(by_price, dec(F.try_divide(value, price), 3)).when(by_weight, dec(value / 1000, 3)).when(fixed, F.lit(1)).when(given, dec(F.col("quantity"), 3))
    worth = F.when(by_price, dec(value)).when(by_weight, dec(value / 1000 * price)).when(fixed, dec(price)).when(given & (F.col("amount") >= 0), dec(F.col("amount")))
    return x.withColumn("product", F.col("map.product")).withColumn("mapped", F.col("map").isNotNull()).withColumn("qty", qty.cast("decimal(18,3)")).withColumn("worth", worth.cast("decimal(18,2)")).drop("map")


def order_heads(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Each request for an order (order_id, store, at, total) with the first error that it shows without its lines' values, else null; the first of an id in time counts."""
    n = lines.groupBy("order_id").agg(F.count("line_no").alias("lines"))
    o = orders.withColumnRenamed("amount", "total").withColumn("nth", F.row_number().over(Window.partitionBy("channel", "order_id").orderBy("at"))).join(n, "order_id", "left")
    error = (
        F.when(F.col("channel") != "COUPANG", "DELIVERY_CHANNEL_NOT_SUPPORTED").when(F.length(F.col("order_id").cast("string")) < 3, "DELIVERY_ORDER_ID_REQUIRED").when(~F.coalesce(F.col("total") > 0, F.lit(False)), "DELIVERY_ORDER_AMOUNT_REQUIRED")
        .when(F.col("nth") > 1, "DUPLICATE_DELIVERY_ORDER").when(F.coalesce("lines", F.lit(0)) < 1, "DELIVERY_LINES_REQUIRED").when(F.col("lines") > 50, "DELIVERY_LINE_COUNT_INVALID")
    )
    return o.select("order_id", "store", "at", "total", error.alias("error"))


def line_facts(sound: DataFrame, lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """The lines of sound orders (order_id, store) with their values, and their order's error by its lines, null where only stock can refuse it."""
    v = with_values(sound.select("order_id", "store").join(lines, "order_id"), mapping)
    wrong = F.when(~F.coalesce(F.col("barcode").rlike(BARCODE), F.lit(False)), "INVALID_BARCODE").when(~F.col("mapped"), "BARCODE_NOT_MAPPED").when(F.col("qty").isNull() | F.col("worth").isNull(), "SALE_VALUE_REQUIRED").when(F.col("qty") <= 0, "INVALID_QUANTITY")
    v = v.select("order_id", "store", "line_no", "product", "qty", "worth", wrong.alias("wrong"))
    own = Window.partitionBy("order_id")
    v = v.withColumn("first", F.min(F.when(F.col("wrong").isNotNull(), F.struct("line_no", "wrong"))).over(own)).withColumn("scale", F.sum("worth").over(own))
    error = F.when(F.col("first").isNotNull(), F.concat(F.col("first.wrong"), F.lit("_LINE_"), F.col("first.line_no"))).when(~F.coalesce(F.col("scale") > 0, F.lit(False)), "DELIVERY_SCALE_AMOUNT_REQUIRED")
    return v.select("order_id", "store", "line_no", "product", "qty", "worth", error.alias("error"))


def lacking_stock(rivals: DataFrame) -> DataFrame:
    """(order_id, line_no, left) of the orders that a store can't fill, with the first line that lacks stock and what there was. rivals: store, at, order_id, line_no, product, qty, available.

    A store's orders come in order of time, as a stream; its state is what has been taken of each product. An
    order that is refused takes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, taken, order, own, short, out, kinds = None, {}, None, {}, None, [], ()

        def end() -> None:
            if order is not None and short is not None:
                out.append((order, *short))
            elif order is not None:
                taken.update({p: taken.get(p, 0) + q for p, q in own.items()})

        for b in batches:
            kinds = (b.schema.field(1).type, pa.int64(), pa.decimal128(18, 3))
            for s, o, line, product, qty, available in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, o) != (store, order):
                    end()
                    if s != store:
                        store, taken = s, {}
                    order, own, short = o, {}, None
                left = available - taken.get(product, 0) - own.get(product, 0)
                if short is None and left < qty:
                    short = (line, left)
                own[product] = own.get(product, 0) + qty
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["order_id", "line_no", "left"])
                out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["order_id", "line_no", "left"])

    d3 = lambda c: F.col(c).cast("decimal(18,3)").alias(c)
    rows = rivals.repartition("store").sortWithinPartitions("store", "at", "order_id", "line_no").select("store", "order_id", F.col("line_no").cast("long").alias("line_no"), "product", d3("qty"), d3("available"))
    return rows.mapInArrow(run, f"order_id {rows.schema['order_id'].dataType.simpleString()}, line_no long, left decimal(18,3)")


def fulfilled(orders: DataFrame, lines: DataFrame, mapping: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery orders posted as a whole or not at all: (orders with their error or null, posted lines with quantity and allocated amount).

    orders: order_id, store, channel, amount, at; lines: order_id, line_no, code, barcode, quantity, amount; stock: store,
    product, available. The first order of an id in time counts. The order's amount is dealt out by scale amounts,
    the last line taking the residual. Orders take stock in order of time; one that lacks any product takes nothing.

    Only products of which the valid orders together ask for more than there is can refuse one, so only orders
    with such a product pass through the fold over a store; all others are settled by sums.
    """
    heads = written(order_heads(orders, lines))
    sound = heads.where("error IS NULL").drop("error")
    facts = written(line_facts(sound, lines, mapping))
    valid = facts.where("error IS NULL").drop("error")
    asked = valid.groupBy("store", "product").agg(F.sum("qty").alias("asked")).join(stock, ["store", "product"], "left")
    scarce = asked.withColumn("available", F.coalesce("available", F.lit(0)).cast("decimal(18,3)")).where("asked > available").select("store", "product", "available")
    timed = lambda x: x.join(sound.select("order_id", "at", "total"), "order_id")
    refused = written(lacking_stock(timed(valid.join(scarce, ["store", "product"]))))
    reason = F.concat(F.lit("INSUFFICIENT_STOCK_LINE_"), F.col("short"), F.lit("_AVAILABLE_"), F.col("left").cast("string"))
    by_line = facts.groupBy("order_id").agg(F.max("error").alias("line_error")).where("line_error IS NOT NULL")
    by_stock = refused.select("order_id", F.col("line_no").alias("short"), "left")
    settled = sound.select("order_id", "store", "at").join(by_line, "order_id", "left").join(by_stock, "order_id", "left").select("order_id", "store", "at", F.coalesce("line_error", reason).alias("error"))
    o = heads.where("error IS NOT NULL").select("order_id", "store", "at", "error").unionByName(settled)
    done = allocate(timed(valid.join(refused, "order_id", "left_anti")), "order_id", ["line_no"], "worth", "total")
    return o, done.select("order_id", "line_no", "store", "product", F.col("qty").cast("double").alias("quantity"), F.col("allocated").cast("double").alias("amount"), "at")


def cancelled(requests: DataFrame, orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (order_id) to cancel delivery orders: (orders with status and outcome, stock rows that go back).

    Posted orders and those under review are cancelled once; what is cancelled already stays as it is. Orders in shadow
    mode never moved stock, so nothing goes back.
    """
    asked = requests.select("order_id").distinct().withColumn("asked", F.lit(True))
    o = orders.join(asked, "order_id", "left")
    able = F.col("asked") & F.col("status").isin("FULFILLED", "REVIEW")
    outcome = F.when(F.col("asked").isNull(), None).when(able, "CANCELLED").when(F.col("status") == "CANCELLED", "ALREADY_CANCELLED").otherwise("DELIVERY_ORDER_NOT_CANCELLABLE")
    o = o.withColumn("outcome", outcome)
    back = lines.join(o.where("outcome = 'CANCELLED' AND NOT shadow").select("order_id"), "order_id", "left_semi").where("posted AND NOT reversed")
    after = F.when(F.col("outcome") == "CANCELLED", "CANCELLED").otherwise(F.col("status"))
    return o.select("order_id", after.alias("status"), "outcome"), back.select("order_id", "line_no", "product", F.lit("IN").alias("kind"), "quantity", "amount")


def channel_sales(scans: DataFrame, pos: DataFrame, posted: DataFrame, seconds: int = 7200) -> DataFrame:
    """Scans sold over a channel (id, channel, store, barcode, sold_at, allow): refused where the till recorded the label within two hours before, else as posted, under their channel."""
    from .ledger import time_slot

    slot = time_slot(F.col("sold_at"), seconds)
    p = pos.select(F.col("store").alias("ps"), F.col("barcode").alias("pb"), F.col("sold_at").alias("pt"), time_slot(F.col("sold_at"), seconds).alias("pslot"))
    since = F.unix_micros(F.col("sold_at").cast("timestamp")) - F.unix_micros(F.col("pt").cast("timestamp"))
    guarded = scans.where((F.col("channel") != "STORE") & ~F.col("allow")).withColumn("slot", F.explode(F.array(slot - 1, slot)))
    seen = guarded.join(p, (F.col("store") == F.col("ps")) & (F.col("barcode") == F.col("pb")) & (F.col("slot") == F.col("pslot")) & since.between(0, seconds * 1_000_000)).groupBy("id").agg(F.max("pt").alias("recorded_at"))
    out = scans.join(seen, "id", "left").join(posted.select("id", F.col("status").alias("posted")), "id", "left")
    status = F.when(~F.col("channel").isin(*CHANNELS), "INVALID_CHANNEL").when(F.col("recorded_at").isNotNull(), "POS_ALREADY_RECORDED").otherwise(F.col("posted"))
    return out.select("id", "channel", status.alias("status"), "recorded_at")


def manual_sale(quantity: Column, price: Column, amount: Column) -> Column:
    """(amount, price, error) of a sale typed in by hand: what is missing follows from the other two."""
    worth = dec(F.coalesce(amount, quantity * F.coalesce(price, F.lit(0))))
    each = dec(F.coalesce(price, F.try_divide(worth, quantity)))
    error = F.when(~F.coalesce(quantity > 0, F.lit(False)), "QUANTITY_REQUIRED").when((worth < 0) | (each < 0), "INVALID_SALE_AMOUNT")
    return F.struct(worth.cast("double").alias("amount"), each.cast("double").alias("price"), error.alias("error"))


def with_stock_warning(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Sales (store, product, quantity) with whether they take more than there is; they are posted all the same."""
    return sales.join(stock, ["store", "product"], "left").withColumn("low", F.coalesce(F.col("available"), F.lit(0)) < F.col("quantity")).drop("available")


def observed(scans: DataFrame, mapping: DataFrame, keep_odd: bool) -> DataFrame:
    """Scans in observation mode: status, product, quantity and amount of each, and nothing posted. Codes of no known form are kept with a note, or else left out."""
    x = with_values(scans.withColumn("quantity", F.lit(None).cast("decimal(18,3)")).withColumn("amount", F.lit(None).cast("decimal(18,2)")), mapping)
    formed = F.col("barcode").rlike(BARCODE)
    error = F.when(~formed, "INVALID_BARCODE").when(~F.col("mapped"), "BARCODE_NOT_MAPPED").when(F.col("worth").isNull() | F.col("qty").isNull(), "SALE_VALUE_REQUIRED")
    x = x.withColumn("error", error).where(F.lit(keep_odd) | formed)
    return x.select("id", F.when(F.col("error").isNull(), "OBSERVED").otherwise("PENDING").alias("status"), "product", F.col("qty").cast("double").alias("quantity"), F.col("worth").cast("double").alias("amount"), "error")


def first_scan(scans: DataFrame, mapping: DataFrame) -> DataFrame:
    """The oldest rule: digits only, unmapped codes fail, amounts in whole won."""
    x = with_values(scans.withColumn("quantity", F.lit(None).cast("decimal(18,3)")).withColumn("amount", F.lit(None).cast("decimal(18,2)")), mapping)
    status = F.when(~F.col("barcode").rlike("^[0-9]+$") | ~F.col("mapped"), "FAILED").when(F.col("worth").isNull(), "PENDING").otherwise("PROCESSED")
    return x.select("id", status.alias("status"), F.round("worth").cast("long").alias("amount"))


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """Folds each key's rows in order, as a stream of Arrow batches over sorted partitions: only the last key's state is held, however many rows a key has.

    step(state, row) gives (state, output row or None); row is a tuple in the order of df's columns, and state is None at a key's first row.
    One key's rows go through one task, since each outcome depends on the one before.
    """
    at = [df.columns.index(k) for k in keys]
    made_of = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine = [row[i] for i in at]
                if mine != key:
                    key, state = mine, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made_of, strict=True)], schema=made_of)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def till_sales(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Till sales (id, store, product, txn, quantity, sold_at) against running stock: SOLD, DUPLICATE_EVENT or INSUFFICIENT_STOCK; a refused sale takes nothing."""
    k = F.row_number().over(Window.partitionBy("store", "txn").orderBy("sold_at", "id"))
    s = sales.withColumn("again", k > 1).join(stock, ["store", "product"], "left")
    s = s.select("store", "product", "id", "sold_at", "again", F.col("quantity").cast("double").alias("quantity"), F.coalesce(F.col("available").cast("double"), F.lit(0.0)).alias("available"))

    def step(left: float | None, r: tuple) -> tuple[float, tuple]:
        _, _, i, _, again, quantity, available = r
        left = available if left is None else left
        if again:
            return left, (i, "DUPLICATE_EVENT", left)
        if quantity > left:
            return left, (i, "INSUFFICIENT_STOCK", left)
        return left - quantity, (i, "SOLD", left - quantity)

    return sorted_fold(s, ["store", "product"], ["sold_at", "id"], step, "id long, status string, left double")


def manual_sales_v1(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Manual sales that low stock refuses: till_sales without transactions."""
    return till_sales(sales.withColumn("txn", F.col("id").cast("string")), stock)


def received(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Goods receipts of documents that are ready: approved, with all lines named, counted and traced; a row for each line."""
    hole = (F.trim(F.coalesce("name", F.lit(""))) == "") | ~F.coalesce(F.col("quantity") > 0, F.lit(False)) | (F.trim(F.coalesce("trace", F.lit(""))) == "")
    ready = lines.groupBy("doc").agg(F.count_if(hole).alias("holes")).where("holes = 0")
    return lines.join(documents.where("status = 'APPROVED'").select("doc"), "doc", "left_semi").join(ready, "doc", "left_semi").withColumn("kind", F.lit("IN"))


def signed_rows(rows: DataFrame) -> DataFrame:
    """Ledger rows from changes: goods in, goods out, or an adjustment by its sign; nothing for 0."""
    q = F.col("change")
    return rows.where(q != 0).withColumn("kind", F.when(F.col("adjust"), F.when(q > 0, "ADJUST_IN").otherwise("ADJUST_OUT")).when(q > 0, "IN").otherwise("OUT")).withColumn("quantity", F.abs(q))


def by_credential(events: DataFrame, credentials: DataFrame) -> DataFrame:
    """Events with the store whose active credential has the digest of their key; the others are dropped."""
    c = latest_per_key(credentials.where("active"), ["digest"], [F.desc("since"), F.asc("store")]).select("digest", "store")
    return events.withColumn("digest", F.sha2(F.col("key"), 256)).join(c, "digest").drop("digest", "key")
