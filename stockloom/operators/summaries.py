"""Summaries, best matches and rankings over the ledger's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.scalars import js_round
from stockloom.sources.sinks import written


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, js_round(100 * part / whole)).otherwise(0).cast("long")


def queue(rows: DataFrame) -> DataFrame:
    """Whole percentages of parsed, reviewed and badly scanned documents, mean confidence and time, duplicates; rows: status, review, quality, confidence, millis, duplicate."""
    n = F.count("*")
    done = F.count_if(F.col("status").isin("PARSE_COMPLETED", "REVIEW_REQUIRED", "APPROVED", "POSTED"))
    open_ = F.count_if((F.col("status") == "REVIEW_REQUIRED") | F.coalesce(F.col("review") == "PENDING", F.lit(False)))
    mean = lambda c: F.coalesce(js_round(F.avg(c)), F.lit(0)).cast("long")
    again = F.count_if(F.coalesce("quality", F.lit(0)) < 70)
    return rows.agg(n.alias("total"), percent(done, n).alias("success"), mean(F.coalesce("confidence", "quality", F.lit(0))).alias("confidence"), percent(open_, n).alias("review"), percent(again, n).alias("recapture"), mean(F.when(F.col("millis") >= 0, F.col("millis"))).alias("millis"), F.count_if("duplicate").alias("duplicates"))


def history(rows: DataFrame) -> DataFrame:
    """Mean confidence, repeated selections, unknown and automatic decisions, and a learning score of 100 at most."""
    mean = F.coalesce(js_round(F.avg(F.coalesce("confidence", F.lit(0)))), F.lit(0))
    again = F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce("selections", F.lit(1)) - 1)), F.lit(0))
    s = rows.agg(F.count("*").alias("total"), mean.cast("long").alias("confidence"), again.cast("long").alias("repeated"), F.count_if(F.col("decision") == "UNKNOWN").alias("unknown"), F.count_if(F.col("decision") == "AUTO_APPROVED").alias("automatic"))
    return s.withColumn("learning", F.least(F.lit(100), js_round(F.col("confidence") * 0.6 + F.least(F.lit(40), F.col("repeated") * 4))).cast("long"))


def candidates(rows: DataFrame) -> DataFrame:
    """Candidates by status, distinct dictionary entries, mean confidence and the percentage that passed by itself."""
    auto = F.count_if(F.col("status") == "AUTO_APPROVED")
    return rows.agg(F.count("*").alias("total"), auto.alias("automatic"), F.count_if(F.col("status").isin("REVIEW_REQUIRED", "USER_SELECT")).alias("review"), F.count_if(F.col("status") == "UNKNOWN").alias("unknown"), F.countDistinct("dictionary").alias("entries"), percent(auto, F.count("*")).alias("accuracy"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("cases"), F.count_if(F.coalesce(F.col("status") != "RESOLVED", F.lit(True))).alias("open"), F.round(F.avg(F.coalesce("confidence", F.lit(0))), 6).alias("confidence"))


def sources(rows: DataFrame, key: Column) -> DataFrame:
    """Rows, those mapped and pending, keys that repeat, and rows of costs."""
    repeated = rows.groupBy(key.alias("_k")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_groups"))
    return rows.agg(F.count("*").alias("loaded"), F.count_if(F.col("mapped")).alias("mapped"), F.count_if(~F.col("mapped")).alias("pending"), F.count_if(F.col("cost")).alias("costs")).crossJoin(repeated)


def accuracy(rows: DataFrame) -> DataFrame:
    """Correct, safe (held back) and wrong decisions of each family, with rates in percent."""
    n = F.count("*")
    rate = lambda s: F.round(100 * F.count_if(F.col("outcome") == s) / n, 2)
    return rows.groupBy("family").agg(n.alias("n"), *(f for s in ("correct", "safe", "wrong") for f in (F.count_if(F.col("outcome") == s).alias(s), rate(s).alias(f"{s}_rate"))))


def weakest_items(logs: DataFrame, keys: list[str], most: int = 3, below: float = 8.0) -> DataFrame:
    """The up to three items of the lowest mean points under 8, from (keys, points array): item numbers from 1."""
    each = logs.select(*keys, F.posexplode("points").alias("p", "points")).groupBy(*keys, (F.col("p") + 1).alias("item")).agg(F.round(F.avg("points"), 4).alias("mean")).where(F.col("mean") < below)
    return each.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "item"))).where(F.col("place") <= most)


def running_average(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each key's mean of the values up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean", F.round(F.avg(value).over(w), 6)).withColumn("samples", F.count(value).over(w))


def scorecard(logs: DataFrame, keys: list[str], items: int) -> DataFrame:
    """The latest log of each key and day as points by item, with total and whether it falls short of 80; logs: keys, day, created, points."""
    last = logs.groupBy(*keys, "day").agg(F.max_by("points", F.struct("created", "points")).alias("points"))
    total = F.aggregate("points", F.lit(0), lambda a, x: a + x)
    return last.select(*keys, "day", *(F.get("points", F.lit(i)).alias(f"item{i + 1}") for i in range(items)), total.alias("total"), (total < 80).alias("short"))


def best_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def optional_alias(suppliers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Suppliers with the alias whose key equals the key of their name, else of their code: two equi joins in place of an OR. A key stands for its least alias."""
    least = aliases.groupBy("key").agg(F.min("alias").alias("alias"))
    by = lambda c, p: suppliers.join(least.select(F.col("key").alias(c), "alias"), c).select("id", F.struct(F.lit(p).alias("place"), "alias").alias("x"))
    found = by("name_key", 0).unionByName(by("code_key", 1)).groupBy("id").agg(F.min("x").alias("x"))
    return suppliers.join(found.select("id", "x.alias"), "id", "left")


def word_candidates(lines: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """(line, product, score) of the up to `most` products that share words with a line, by common words in all their words in percent, then by product: exactly those of a comparison of all pairs.

    Equal texts are one, and a name stands for its `most` least products. A line's words are asked in rounds, the one that the
    fewest names have first. A name that none of the first r words has found shares at most the others with the line, so a line is done
    once `most` products score above what that allows; frequent words are asked only by lines that need them. Few bytes of lines
    find many names, so each round deals them out over all shuffle partitions, where their finds are sorted.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")))
    asked = lines.select("line", words("text").alias("a"))
    named = products.select("product", words("name").alias("b")).withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("product"))).where(F.col("k") <= most)
    names = written(named.groupBy("b").agg(F.array_sort(F.collect_list("product")).alias("products")))
    index = names.select("b", "products", F.explode("b").alias("word"))
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    told = asked.select("a").distinct().select("a", F.explode("a").alias("word")).join(df, "word")
    open_ = written(told.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("rare")).withColumn("best", F.array().cast("array<struct<score:bigint,product:bigint>>")))
    done, turn = [], 0
    while True:
        common = F.size(F.array_intersect("a", "b"))
        new = open_.repartition(parts, "a").select("a", F.get("rare", F.lit(turn)).alias("word"), F.slice("rare", 1, turn).alias("before")).join(index, "word").where(~F.arrays_overlap("before", "b"))  # not found before
        new = new.select("a", percent(common, F.size("a") + F.size("b") - common).alias("score"), F.explode("products").alias("product")).select("a", F.struct((-F.col("score")).alias("score"), F.col("product").cast("long").alias("product")).alias("x"))
        first = best_rows(new, ["a"], [F.asc("x")], most).groupBy("a").agg(F.collect_list("x").alias("new"))
        x = open_.join(first, "a", "left")
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array().cast("array<struct<score:bigint,product:bigint>>")))), 1, most)
        left = F.size("rare") - (turn + 1)
        x = x.select("a", "rare", best.alias("best")).withColumn("over", (left <= 0) | F.coalesce(-F.get("best", F.lit(most - 1))["score"] > percent(left, F.size("a")), F.lit(False)))
        x = written(x)
        done.append(x.where("over").select("a", "best"))
        open_, turn = x.where("NOT over").drop("over"), turn + 1
        if not open_.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, done)
    return asked.join(found, "a").select("line", F.explode("best").alias("x")).select("line", F.col("x.product").alias("product"), (-F.col("x.score")).alias("score"))


def header_columns(tokens: DataFrame, labels: tuple[tuple[str, str], ...]) -> DataFrame:
    """The surest token of each document for each column whose label it contains; labels are a small fixed list of (column, label)."""
    hits = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(label)), name) for name, label in labels)))
    t = tokens.withColumn("column", F.explode(F.array_distinct(hits)))
    return best_rows(t, ["doc", "column"], [F.desc("confidence"), F.asc("token")])


def apart_boxes(boxes: DataFrame, overlap: Column, most: int = 3) -> DataFrame:
    """A document's boxes of the least confidence, without any that overlaps another by .65 or more of the smaller one; overlap compares a box a with a box b.

    Boxes at the same place are compared as one, which holds their least and greatest id. As more than half of the smaller box lies in
    the other, its centre does; so boxes meet by cells: one as wide as the other's longer side, rounded up to a power of two, holds the centre.
    """
    place = ["doc", "x", "y", "w", "h"]
    p = boxes.groupBy(*place).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("w > 0 AND h > 0")
    level = F.ceil(F.log2(F.greatest("w", "h").cast("double"))).cast("int")
    p = p.select("doc", F.struct(*place[1:], "low", "high").alias("b"), level.alias("level"))
    cells = lambda s, d: F.sequence(F.floor(F.col(f"b.{s}") / F.pow(F.lit(2.0), "level")), F.floor((F.col(f"b.{s}") + F.col(f"b.{d}")) / F.pow(F.lit(2.0), "level")))
    larger = p.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    levels = p.groupBy("doc").agg(F.collect_set("level").alias("levels"))
    cell = lambda s, d: F.floor((F.col(f"a.{s}") + F.col(f"a.{d}") / 2) / F.pow(F.lit(2.0), "level"))
    smaller = p.select("doc", F.col("b").alias("a")).join(levels, "doc").withColumn("level", F.explode("levels"))
    smaller = smaller.select("doc", "a", "level", cell("x", "w").alias("cx"), cell("y", "h").alias("cy"))
    met = smaller.join(larger, ["doc", "level", "cx", "cy"]).where(overlap >= 0.65)
    sides = lambda own, other: met.select("doc", *(F.col(f"{own}.{c}").alias(c) for c in place[1:]), F.col(f"{other}.low").alias("low"), F.col(f"{other}.high").alias("high"))
    near = sides("a", "b").unionByName(sides("b", "a")).groupBy(*place).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hit = boxes.join(near, place).where((F.col("id") != F.col("low")) | (F.col("id") != F.col("high"))).select("doc", "id").distinct()
    return best_rows(boxes.join(hit, ["doc", "id"], "left_anti"), ["doc"], [F.asc("confidence"), F.asc("id")], most)


def korean_order(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Rows by their first tie column in the order of a Korean dictionary, then by the ties as they are."""
    return rows.orderBy(F.collate(ties[0], "ko"), *ties)


def business_days(start: Column, days: int, holidays: Column) -> Column:
    """The day so many working days after start: Saturdays, Sundays and the holidays don't count."""
    later = F.sequence(F.date_add(start, 1), F.date_add(start, days * 2 + 20))
    working = F.filter(later, lambda x: ~F.dayofweek(x).isin(1, 7) & ~F.array_contains(holidays, x))
    return F.get(working, F.lit(days - 1))


def menus(stores: DataFrame, pools: DataFrame) -> DataFrame:
    """The menu of each store and day with the highest score, ties by hash; pools: (context, species, position, menu), a small fixed table."""
    from stockloom.functions.scalars import hash31

    m = F.col("menu")
    fits = {"hot": "(냉채|무침|소금구이|채소)", "rainy": "(찌개|전골|찜|볶음)", "cold": "(찌개|전골|탕|곰탕|감자탕|백숙)", "weekend": "(구이|바비큐|스테이크|수육|보쌈)", "spring": "(미나리|달래|봄나물|채소)", "autumn": "(버섯|구이|불고기|찜)"}
    parts = {"morning": "(찌개|국|탕|백숙|곰탕)", "afternoon": "(구이|볶음|불고기|냉채|무침)", "evening": "(구이|찜|전골|수육|보쌈|바비큐)"}
    bonus = lambda of, by, points: F.coalesce(*(F.when((F.col(of) == k) & m.rlike(v), points) for k, v in by.items()), F.lit(0))
    score = 100 - F.col("position") * 3 + bonus("context", fits, 24) + bonus("part", parts, 12)
    both = stores.join(pools, "context").withColumn("score", score).withColumn("tie", hash31(F.concat_ws("|", "day", "part", "store", "menu")))
    return best_rows(both, ["store", "day", "part"], [F.desc("score"), F.desc("tie"), F.asc("menu")])


def brief_lines(b: DataFrame) -> DataFrame:
    """A money brief as text: yesterday with its change against the weekday before, deposits, month, unmapped sales, expiring goods."""
    won = lambda c: F.concat(F.format_number(js_round(F.col(c)), 0), F.lit("원"))
    rate = js_round((F.col("yesterday") - F.col("last_week_same_day")) / F.col("last_week_same_day") * 100).cast("long")
    change = F.when(F.col("last_week_same_day") > 0, F.concat(F.lit(" (지난주 같은 요일 대비 "), F.when(rate >= 0, "▲").otherwise("▼"), F.abs(rate), F.lit("%)"))).otherwise("")
    lines = F.array_compact(F.array(
        F.concat(F.lit("어제 매출 "), won("yesterday"), change), F.when(F.col("deposits_n") > 0, F.concat(F.lit("카드 입금 예정(7일) "), won("deposits"))),
        F.concat(F.lit("이번 달 매출 "), won("month_sales"), F.when(F.col("month_purchases") > 0, F.concat(F.lit(" / 매입 "), won("month_purchases"))).otherwise("")),
        F.when(F.col("unmapped_n") > 0, F.concat(F.lit("품목 미지정 매출 "), F.col("unmapped_n"), F.lit("건"))), F.when(F.col("expiring_n") > 0, F.concat(F.lit("유통기한 임박 "), F.col("expiring_n"), F.lit("건"))),
    ))
    return b.select(*[c for c in ("store", "day") if c in b.columns], F.array_join(lines, "\n").alias("text"))


def explanation(action: Column, order: Column) -> Column:
    return F.when(action == "REDUCE", "임박·예상 손실 재고가 있어 새 발주보다 기존 재고 소진이 우선입니다.").when(action == "REVIEW", "학습 데이터가 아직 부족해 수량은 참고값입니다. 실사와 납기를 확인해 주세요.").when(action == "HOLD", "현재 가용재고가 소비기한 내 목표재고를 충족해 발주를 보류합니다.").otherwise(F.concat(F.lit("리드타임 수요와 안전재고를 반영해 "), order, F.lit("kg 발주를 제안합니다.")))


def sanitation_group(total: Column, complete: Column, seed: Column) -> Column:
    """(band, number): a score's band and which of its five messages is shown, by the sum of the characters' codes."""
    band = F.when(~complete, "incomplete").when(total >= 90, "excellent").when(total >= 80, "good").when(total >= 60, "caution").otherwise("urgent")
    codes = F.aggregate(F.filter(F.split(F.concat_ws(":", F.coalesce(seed, F.lit("")), total), ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.struct(band.alias("band"), (codes % 5).alias("number"))


def advice(ratings: Column, names: Column, warnings: Column) -> Column:
    """What to look at first: bad items, up to three normal ones, temperatures; or how many items are still open."""
    of = lambda r: F.filter(F.transform(ratings, lambda x, i: F.when(x == r, F.get(names, i))), lambda x: x.isNotNull())
    left = F.size(F.filter(ratings, lambda x: ~F.coalesce(x.isin(1, 2, 3), F.lit(False))))
    say = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, ", ")))
    found = F.array_compact(F.array(say("먼저 챙겨볼 곳: ", of(3)), say("한 번 더 살펴볼 곳: ", F.slice(of(2), 1, 3)), F.when(F.size(warnings) > 0, F.array_join(warnings, ", "))))
    return F.when(left > 0, F.concat(F.lit("아직 "), left, F.lit("개 항목이 남았어요."))).when(F.size(found) > 0, F.array_join(found, " · ")).otherwise("오늘은 모든 항목이 편안하게 잘 관리됐어요.")


def scored_items(ratings: Column) -> Column:
    """Ten items with their points: 10, 5 or 1 for the ratings 1, 2 and 3; missing ones have none."""
    item = lambda i: F.get(ratings, i - 1)
    points = lambda i: F.when(item(i) == 1, 10).when(item(i) == 2, 5).when(item(i) == 3, 1).otherwise(0)
    return F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(i.alias("item"), item(i).alias("rating"), points(i).alias("points")))
