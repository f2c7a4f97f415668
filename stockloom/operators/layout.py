"""Tables, lines and regions from the places of words on a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import codes


#: The columns of an invoice in order, with the header texts that stand for them.
HEADERS = (
    ("species", ("종류", "축종", "식육종류", "축산물종류")), ("part", ("부위", "부위명", "부위명칭")), ("productName", ("상품명및등급", "상품명", "품명", "제품명", "내역")), ("origin", ("원산지", "산지")),
    ("grade", ("등급", "육질등급", "품질등급")), ("condition", ("상태", "보관상태", "냉장냉동", "식육포장육의종류")), ("unit", ("단위", "u/m")), ("quantity", ("수량", "중량", "qty")), ("unitPrice", ("단가", "공급단가")),
    ("supplyAmount", ("공급가액", "공급가")), ("taxAmount", ("세액", "부가세")), ("totalAmount", ("금액", "합계", "합계금액")), ("traceOrImportNo", ("이력번호", "수입이력번호", "수입번호", "묶음번호", "개체식별번호")),
)


def banded(tokens: DataFrame, order: list[str], last_only: bool = False) -> DataFrame:
    """tokens (doc, y, tolerance, ...) with `band`: each, in order within its document, joins the first band whose mean y is within its tolerance, or begins one.

    last_only: only the band begun last can be joined. The mean follows with each token, so the fold is sequential within a document; it
    runs as a stream over sorted partitions and holds sum and size of one document's bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, total, size, used = None, np.zeros(64), np.zeros(64), 0
        for b in batches:
            docs, ys, reach = b.column("doc").to_pylist(), b.column("y").to_numpy(zero_copy_only=False), b.column("tolerance").to_numpy(zero_copy_only=False)
            band = np.zeros(b.num_rows, np.int64)
            for i, d in enumerate(docs):
                if d != doc:
                    doc, used = d, 0
                first = max(0, used - 1) if last_only else 0
                hit = np.flatnonzero(np.abs(total[first:used] / size[first:used] - ys[i]) <= reach[i])
                if len(hit):
                    k = first + hit[0]
                    total[k], size[k] = total[k] + ys[i], size[k] + 1
                else:
                    if used == len(total):
                        total, size = np.append(total, total * 0), np.append(size, size * 0)
                    k, used = used, used + 1
                    total[k], size[k] = ys[i], 1
                band[i] = k + 1
            yield b.append_column("band", pa.array(band))

    rows = tokens.withColumn("y", F.col("y").cast("double")).withColumn("tolerance", F.col("tolerance").cast("double")).repartition("doc").sortWithinPartitions("doc", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, band long")


def reading_order(tokens: DataFrame) -> list[str]:
    """From top to bottom and left to right; equal ids are told apart by all else that a token says."""
    return ["y", "x", "id", *(c for c in ("text", "w", "h", "confidence") if c in tokens.columns)]


def header_tokens(tokens: DataFrame) -> DataFrame:
    """The surest token of each document for each column of HEADERS: tokens (doc, id, text, x, y, w, h, confidence), x and y the left and upper edges.

    A token stands for a column if it equals one of its texts, which makes it surer by 8, or one holds the other and
    both have two letters. Blanks, points, colons and brackets don't count.
    """
    bare = F.lower(F.regexp_replace("text", r"[\s·ㆍ:：()\[\]{}]", ""))
    labels = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(i).alias("nth"), F.lit(key).alias("name"), F.lit(label).alias("label")) for k, (key, texts) in enumerate(HEADERS) for i, label in enumerate(texts)))
    fits = lambda t, v: (t == v["label"]) | ((F.contains(t, v["label"]) | F.contains(v["label"], t)) & (F.least(F.length(t), F.length(v["label"])) >= 2))
    t = tokens.where("trim(text) <> '' AND w > 0 AND h > 0").withColumn("bare", bare)
    t = t.withColumn("v", F.explode(F.filter(labels, lambda v: fits(F.col("bare"), v))))
    sure = F.floor(F.least(F.lit(100), F.least(F.lit(100), F.greatest(F.lit(0), F.col("confidence"))) + F.when(F.col("bare") == F.col("v.label"), 8).otherwise(0)) + 0.5).cast("long")
    t = t.select("doc", "id", "x", "w", "h", (F.col("x") + F.col("w") / 2).alias("centre"), (F.col("y") + F.col("h") / 2).alias("y"), sure.alias("confidence"), "v.name", "v.place", "v.nth")
    w = Window.partitionBy("doc", "name").orderBy(F.desc("confidence"), "id", "nth")
    return t.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "nth")


def table_columns(tokens: DataFrame) -> DataFrame:
    """Columns (doc, name, centre, left, right, confidence) of each document's table by its header: the band of most header tokens, the upper one on ties.

    Bands reach 1.25 of the median height of the header tokens, 18 at least. Of headers that nearly coincide the left one counts;
    neighbours meet halfway, the outer ones reach .45 of their width, 12 at least, beyond their text. A table has three columns at least.
    """
    wide = tokens.groupBy("doc").agg(F.max(F.col("x") + F.col("w")).alias("width"))
    h = header_tokens(tokens)
    every = Window.partitionBy("doc")
    h = banded(h.withColumn("tolerance", F.greatest(F.lit(18.0), F.median("h").over(every) * 1.25)), ["place"])
    of_band = Window.partitionBy("doc", "band")
    h = h.withColumn("n", F.count("*").over(of_band)).withColumn("height", F.sum("y").over(of_band) / F.count("*").over(of_band))
    best = F.max(F.struct("n", -F.col("height"), -F.col("band"))).over(every)
    h = h.withColumn("best", F.struct("n", -F.col("height"), -F.col("band")) == best).where("best").join(wide, "doc")
    line = Window.partitionBy("doc").orderBy("centre", "place")
    gap = F.col("centre") - F.lag("centre").over(line)
    h = h.withColumn("apart", F.coalesce(gap > F.greatest(F.lit(8.0), F.col("width") * 0.008), F.lit(True))).where("apart")
    h = h.withColumn("columns", F.count("*").over(every)).where("columns >= 3")
    half = lambda c: (c + F.col("centre")) / 2
    beyond = F.greatest(F.lit(12.0), F.col("w") * 0.45)
    left = F.coalesce(half(F.lag("centre").over(line)), F.greatest(F.lit(0.0), F.col("x") - beyond))
    right = F.coalesce(half(F.lead("centre").over(line)), F.least(F.col("width"), F.col("x") + F.col("w") + beyond))
    return h.select("doc", "name", F.col("centre").cast("double").alias("centre"), left.cast("double").alias("left"), right.cast("double").alias("right"), "confidence")


def column_bounds(headers: DataFrame, width: float) -> DataFrame:
    """Columns of each document from the centres x of their headers: they meet halfway between neighbours, the outer ones reach the page's edges."""
    w = Window.partitionBy("doc").orderBy("x", "name")
    half = lambda c: (c + F.col("x")) / 2
    return headers.select("doc", "name", F.coalesce(half(F.lag("x").over(w)), F.lit(0.0)).alias("left"), F.coalesce(half(F.lead("x").over(w)), F.lit(width)).alias("right"))


def cell_boxes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A box for each column and row of a document."""
    return columns.join(rows, "doc").select("doc", "row", "name", F.col("left").alias("x"), "y", (F.col("right") - F.col("left")).alias("w"), "h")


def merged_templates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Layouts (name, x, samples) by name; places known to both are averaged by their samples."""
    n = new.select("name", F.col("x").alias("nx"), F.col("samples").alias("ns"))
    both = old.join(n, "name", "full")
    mean = F.round((F.col("x") * F.col("samples") + F.col("nx") * F.col("ns")) / (F.col("samples") + F.col("ns")), 6)
    return both.select("name", F.coalesce(mean, "x", "nx").alias("x"), (F.coalesce("samples", F.lit(0)) + F.coalesce("ns", F.lit(0))).alias("samples"))


def traces_of_lines(lines: DataFrame, traces: DataFrame) -> DataFrame:
    """Lines (doc, row) with the trace numbers on rows from theirs up to before the next line's: a window finds the line of each, so no ranges are joined."""
    both = lines.select("doc", "row", F.lit(None).cast("string").alias("trace"), F.col("row").alias("own")).unionByName(traces.select("doc", "row", "trace", F.lit(None).cast("long").alias("own")))
    w = Window.partitionBy("doc").orderBy("row", F.col("own").isNull())
    x = both.withColumn("line", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = x.where("trace IS NOT NULL AND line IS NOT NULL").groupBy("doc", F.col("line").alias("row")).agg(F.array_sort(F.collect_list("trace")).alias("traces"))
    return lines.join(found, ["doc", "row"], "left").withColumn("traces", F.coalesce("traces", F.array().cast("array<string>")))


def line_clusters(tokens: DataFrame) -> DataFrame:
    """Tokens (doc, id, x, y, h) with their line's number, from top to bottom: a line goes on while the next centre y is near its running mean, within .75 of the document's median height, 12 at least."""
    middle = F.median(F.when(F.col("h") > 0, F.col("h"))).over(Window.partitionBy("doc")) * 0.75
    reach = F.greatest(F.lit(12.0), F.when(middle > 0, middle).otherwise(16.0))
    return banded(tokens.withColumn("tolerance", reach), reading_order(tokens), last_only=True).withColumnRenamed("band", "line").drop("tolerance")


def grouped_lines(tokens: DataFrame) -> DataFrame:
    """Tokens (doc, id, x, y, h, text, confidence) as lines of text (doc, line, text, confidence): each token joins the first line whose mean y is within .7 of its height, 12 at least."""
    t = banded(tokens.withColumn("tolerance", F.greatest(F.lit(12.0), F.col("h") * 0.7)), reading_order(tokens))
    g = t.groupBy("doc", "band").agg(F.array_sort(F.collect_list(F.struct("x", "id", "text"))).alias("t"), F.avg("y").alias("y"), F.round(F.avg("confidence"), 2).alias("confidence"))
    row = F.row_number().over(Window.partitionBy("doc").orderBy("y", "band")).cast("long")
    return g.select("doc", row.alias("line"), F.trim(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("text"), "confidence")


def regions(lines: DataFrame, bands: tuple[tuple[str, float, float], ...]) -> DataFrame:
    """The text of each band of a document, from top to bottom; bands (name, from, to) are a fixed few."""
    band = F.coalesce(*(F.when((F.col("y") >= a) & (F.col("y") < b), n) for n, a, b in bands))
    g = lines.withColumn("region", band).where("region IS NOT NULL").groupBy("doc", "region").agg(F.array_sort(F.collect_list(F.struct("y", "id", "text"))).alias("t"))
    return g.select("doc", "region", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def line_messages(quantity: Column, price: Column, amount: Column, trace: Column, greatest_quantity: Column, greatest_price: Column) -> Column:
    """What a user must look at in a line: numbers out of range, missing or wrong, and a missing trace number; a document's total isn't compared."""
    missing = ~F.coalesce((quantity > 0) & (price > 0) & (amount > 0), F.lit(False))
    range_ = F.coalesce(greatest_quantity > 100000, F.lit(False)) | F.coalesce(greatest_price > 1000000, F.lit(False)) | F.coalesce(amount > 100000000, F.lit(False))
    return codes(("OUT_OF_RANGE", range_), ("NUMBER_MISSING", missing), ("ARITHMETIC", ~missing & (F.abs(quantity * price - amount) > 1)), ("TRACE_MISSING", F.coalesce(trace, F.lit("")) == ""))


def action_counts(proposals: DataFrame) -> DataFrame:
    """Proposals by action: how many, how much is recommended, how many hold expiring goods."""
    return proposals.groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("recommended"), 3).alias("kilograms"), F.count_if(F.col("waste") > 0).alias("expiring"))
