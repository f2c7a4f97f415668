"""Mixing sources to target weights by entropy balancing (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, durable, text_or_empty

#: Newton stops once every source is this near its target, relative to it; rounding makes good the rest.
NEAR = 1e-5
ROUNDS = 60
#: After the running sums are rounded, each source changes one document's copies so many times at most, as long as that brings it nearer to its target.
REPAIRS = 6
#: Documents of one source and size are ranked in groups of about so many.
GROUP = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(sid, source, source_size, target) for each source. sizes: (source, source_size), one row a source.

    Sources in code point order, null last, take the weights in turn. The targets are the water level:
    each source gets its weight's share, but cap times its size at most.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(order)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("w", F.when(F.col("cap") > 0, F.col("w")).otherwise(0))
    filling = Window.orderBy(F.try_divide("cap", F.col("w")), "sid")
    so_far, whole = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(whole)).withColumn("rest", F.sum("w").over(whole) - F.sum("w").over(so_far) + F.col("w"))
    s = s.withColumn("level", F.when(F.col("rest") > 0, (F.col("total") - (F.sum("cap").over(so_far) - F.col("cap"))) / F.col("rest")))
    first = F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.try_divide("cap", F.col("w")), "sid", "level"))).over(whole)
    s = s.withColumn("at", first["level"])
    return s.select("sid", "source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), "cap")).alias("target"))


def tilted(theta: Column, size: Column, mean: Column, cap: float) -> Column:
    """The rate that the dual variable gives a document of this size: the odds of rate : (cap - rate) grow exponentially with size."""
    return F.lit(cap) / (1 + (cap - 1) * F.exp(F.least(F.lit(700.0), -theta * size / mean)))


def balance(hist: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """(sid, theta): Newton's method on the dual, for all sources at once, over (sid, size, n) counts.

    Each source's dual is convex with one variable; a step outside the interval known to hold the root
    halves that interval instead. Sums are decimals, so that they don't depend on the order of rows.
    """
    state = goal.select("sid", "target", "mean", F.lit(0.0).alias("theta"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    kept = None
    for _ in range(ROUNDS):
        rate = tilted(F.col("theta"), F.col("size"), F.col("mean"), cap)
        mass = F.col("n") * F.col("size")
        sums = hist.join(state, "sid").groupBy("sid").agg(
            F.sum((mass * rate).cast("decimal(30,6)")).cast("double").alias("got"),
            F.sum((mass * rate * (1 - rate / cap) * F.col("size") / F.col("mean")).cast("decimal(32,6)")).cast("double").alias("slope"),
        )
        over = F.col("got") - F.col("target")
        low, high = F.when(over < 0, F.col("theta")).otherwise(F.col("low")), F.when(over > 0, F.col("theta")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, -over / F.col("slope")).otherwise(-F.signum(over))
        far = F.greatest(F.lit(4.0), F.abs("theta") * 2)
        new = F.col("theta") + F.greatest(-far, F.least(far, step))
        new = F.when((new > low) & (new < high), new).when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).otherwise(F.col("theta") - F.signum(over) * far)
        miss = F.abs(over) / F.col("target")
        state = state.join(sums, "sid").select("sid", "target", "mean", F.when(miss <= NEAR, F.col("theta")).otherwise(new).alias("theta"), low.alias("low"), high.alias("high"), miss.alias("miss"))
        state = kept = durable(state, over=kept)
        if not (state.agg(F.max("miss")).first()[0] or 0) > NEAR:
            break
    return state.select("sid", "theta")


def rounded(rates: DataFrame, cap: int) -> DataFrame:
    """(sid, size, n, copies): whole copies for all n documents of a size, from (sid, size, n, rate).

    From the largest size down, the running sum of n * rate is rounded: since sizes fall, a source's words are
    out by half of its largest document at most. Then each source makes good what it is out: it takes one
    copy more or less of the size that brings it nearest, as long as any does; one rule at any number of sizes.
    """
    down = Window.partitionBy("sid").orderBy(F.col("size").desc())
    r = rates.withColumn("want", F.col("n") * F.col("rate"))
    run = F.floor(F.sum(F.col("want").cast("decimal(30,9)")).over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(0.5).cast("decimal(3,1)"))
    r = r.withColumn("run", run.cast("long")).withColumn("copies", F.col("run") - F.coalesce(F.lag("run").over(down), F.lit(0)))
    r = r.select("sid", "size", "n", F.least(F.greatest(F.lit(0), "copies"), cap * F.col("n")).cast("long").alias("copies"), (F.col("want") * F.col("size")).alias("words"))
    r = durable(r)
    owed = r.groupBy("sid").agg((F.sum(F.col("words").cast("decimal(30,6)")) - F.sum(F.col("copies") * F.col("size"))).cast("double").alias("owed"))
    r = r.drop("words")
    state = durable(owed)
    for _ in range(REPAIRS):
        sign = F.signum("owed")
        left = F.abs(F.abs("owed") - F.col("size"))
        able = F.when(sign > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (left < F.abs("owed"))
        best = r.join(state, "sid").where(able).groupBy("sid").agg(F.min(F.struct(left.alias("left"), "size", sign.cast("long").alias("by"))).alias("best"))
        step = durable(best.select("sid", F.col("best.size").alias("at"), F.col("best.by").alias("by")))
        if step.isEmpty():
            break
        r = durable(r.join(step, "sid", "left").select("sid", "size", "n", (F.col("copies") + F.when(F.col("size") == F.col("at"), F.col("by")).otherwise(0)).alias("copies")), over=r)
        state = durable(state.join(step, "sid", "left").select("sid", (F.col("owed") - F.coalesce(F.col("by") * F.col("at"), F.lit(0))).alias("owed")), over=state)
    return r


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row for each row of df: id, size (words), source_size, target, taken (words) and copies.

    The rates minimise the relative entropy to one copy each, within 0 and cap, subject to each source's
    words meeting its target; they are then rounded into copies. Null texts have size 0; a null source
    is a source of its own, the last. Rows without words keep one copy and take 0 words. Repeated rows
    count row by row; which of several equal rows gets a further copy makes no difference. Reruns agree:
    hashes of the rows break ties. An empty table gives an empty result. Other columns aren't carried.

    Scale: Newton and the rounding work on the counts of (source, size), whose number the longest text
    bounds; a document is touched when its words are counted and when copies are dealt out, in groups of
    about GROUP documents of one source and size. Skewed sizes are left to the adaptive join. One task orders the sources, a row each.
    """
    docs = durable(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(text_or_empty(text_col)).alias("size")))
    pairs = durable(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = pairs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goal = durable(targets(by_source.select("source", "source_size"), weights, share, cap))
    hist = durable(pairs.join(goal.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("sid", "size", "n"))
    mean = hist.groupBy("sid").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= cap * F.col("source_size")
    theta = balance(hist, goal.where(~full & (F.col("target") > 0)).join(mean, "sid"), cap)
    rate = F.when(F.col("size") == 0, 1.0).when(full, F.lit(float(cap))).when(F.col("theta").isNull(), 0.0).otherwise(F.round(tilted(F.col("theta"), F.col("size"), F.col("mean"), cap), 9))
    rates = hist.join(goal, "sid").join(mean, "sid").join(theta, "sid", "left").select("sid", "size", "n", rate.alias("rate"))
    plan = rounded(rates, cap).join(goal.select("sid", F.col("source").alias("s"), "source_size", "target"), "sid")
    plan = durable(plan.select("sid", "s", "source_size", "target", F.col("size").alias("z"), "n", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra")))

    dealt = docs.join(plan, docs["source"].eqNullSafe(plan["s"]) & (docs["size"] == plan["z"]))
    mark = F.xxhash64("id", "size")
    dealt = dealt.withColumn("mark", mark).withColumn("part", F.pmod(F.xxhash64("mark"), F.ceil(F.col("n") / GROUP)))
    some = dealt.where("extra > 0")  # the others all have the same number of copies
    parts = some.groupBy("sid", "size", "part").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    upto = F.sum("m").over(Window.partitionBy("sid", "size").orderBy("part"))
    quota = parts.select("sid", "size", "part", (F.floor(F.col("extra") * upto / F.col("n")) - F.floor(F.col("extra") * (upto - F.col("m")) / F.col("n"))).alias("quota"))
    nth = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("mark", "id"))
    some = some.withColumn("nth", nth).join(quota, ["sid", "size", "part"]).withColumn("copies", F.col("each") + (F.col("nth") <= F.col("quota")).cast("long"))
    columns = ["id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"]
    return some.select(columns).unionByName(dealt.where("extra = 0").withColumn("copies", F.col("each")).select(columns)).withColumnRenamed("id", id_col)
