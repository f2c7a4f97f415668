"""Personal data: base spans, and terms that reveal it by corpus co-occurrence (operator 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .quality_rules import let

#: Kinds in the order that sorts spans of one start.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "")

#: The patterns find what the plain forms in the comments find, in linear time: a match starts where a run starts or the last match ended, and runs are never given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"  # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

TERM = r"[\p{L}\p{N}]+"
SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"
#: A generalised term keeps so many first letters: each number is a third or half more than the one before, so that a term's stems together are but a few
#: times as long as it is. The last exceeds any text's length.
STEMS = (2, 3, *(n << k for k in range(29) for n in (4, 6) if n << k < 2**31 - 1))
#: Arrays are scanned in blocks of so many items, so that the work grows in proportion to their length.
BLOCK = 256
#: Terms that no text need be joined for are sorted out by a table of 2^SIEVE bits, 2 MB at any size.
SIEVE = 24
#: Beyond any text's length.
FAR = 2_000_000_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(x: Column) -> Column:
    def of(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            v = F.substring(d, -i, F.lit(1)).cast("int") * (2 - i % 2)
            return a + v - F.when(v > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(digits(x), of)


def blocks(items: Column) -> Column:
    """A non-empty array as an array of arrays of BLOCK items each; the last may be shorter."""
    return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda i: F.slice(items, i, F.lit(BLOCK)))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of a non-empty array's ints, what merge makes of 0 and all ints before it; merge is associative."""

    def scan(items: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def of_blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: merge(a, x)))
        return let(scan(totals, F.lit(0)), lambda heads: F.flatten(F.transform(parts, lambda b, i: scan(b, F.get(heads, i)))))

    return let(values, lambda v: let(blocks(v), of_blocks))


def spans(text: Column, kind: int, pattern: str) -> Column:
    """Spans (start, kind, end), in code points, of the pattern's matches, with the match itself."""

    def of_parts(parts: Column) -> Column:
        at = running(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["match"])), lambda a, x: a + x)

        def one(x: Column) -> Column:
            start = x["at"] + F.length(x["part"]["gap"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["part"]["match"])).alias("end"), x["part"]["match"].alias("match"))

        return F.transform(F.zip_with(parts, at, lambda p, x: F.struct(p.alias("part"), x.alias("at"))), one)

    def of_found(found: Column) -> Column:
        parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
        return F.when(F.size(found) > 0, let(parts, of_parts)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_found)


def base_spans(text: Column) -> Column:
    """All base spans with their matches, in order of start and then kind."""
    ip = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
    none = F.array().cast(SPANS)
    email = F.when(F.contains(text, F.lit("@")), spans(text, 0, EMAIL)).otherwise(none)
    ips = F.filter(spans(text, 1, IP), lambda x: x["match"].rlike(ip))
    cards = F.filter(spans(text, 2, CARD), lambda x: luhn(x["match"]))
    phones = F.when(F.contains(text, F.lit("+")), F.filter(spans(text, 3, PHONE), lambda x: F.length(digits(x["match"])).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ips, cards, phones))


def bare(items: Column) -> Column:
    """The spans without their matches."""
    return F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def joined(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def stems(term: Column) -> Column:
    """What a term is short for: its first letters, as many as STEMS has, but not all."""
    long = F.filter(F.array(*map(F.lit, STEMS)), lambda n: n < F.length(term))
    return F.transform(long, lambda n: F.left(term, n))


def facts(base: Column) -> Column:
    """The entities of all spans: each span's value and its group (the e-mail's domain, the first half of an address or number)."""

    def of(x: Column) -> Column:
        half = F.when(x["kind"] == 0, F.substring_index(x["match"], "@", -1)).when(x["kind"] == 1, F.substring_index(x["match"], ".", 2)).otherwise(F.substring(digits(x["match"]), 1, 4))
        entity = lambda *v: F.xxhash64(x["kind"], *v)
        return F.array(entity(F.lit("value"), x["match"]), entity(F.lit("group"), half))

    return F.array_distinct(F.flatten(F.transform(base, of)))


def sieve(wanted: DataFrame) -> Callable[[Column], Column]:
    """Whether a term may be one of wanted's: a table of 2^SIEVE bits, whatever wanted's size, that has all of their hashes.

    It spares the others the way to the join, which decides.
    """
    spark = wanted.sparkSession
    place = lambda term: F.call_function("shiftrightunsigned", F.xxhash64(term), F.lit(64 - SIEVE))
    own = wanted.select(place(F.col("term")).alias("p")).select(F.call_function("shiftright", "p", F.lit(6)).alias("id"), F.col("p").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = own.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word"))
    every = spark.range(1 << SIEVE - 6).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    bits = durable(every.agg(F.array_sort(F.collect_list(F.struct("id", "word"))).alias("x")).select(F.transform("x", lambda r: r["word"]).alias("bits"))).scalar()

    def may(term: Column) -> Column:
        p = place(term)
        word = F.get(bits, F.call_function("shiftright", p, F.lit(6)).cast("int"))
        return F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may


def holding(source: DataFrame, wanted: DataFrame, found: Column, *names: str) -> DataFrame:
    """The named columns of source for each term of wanted that `found` makes of its text, with wanted's columns."""
    may = sieve(wanted)
    return source.select(*names, F.explode(found).alias("term")).where(may(F.col("term"))).join(wanted, "term")


def told_share(pair: DataFrame, spread: DataFrame, texts: Column) -> DataFrame:
    """pair (entity, term, nc, nct) with share: pointwise mutual information over the entity's whole information, by numbers of distinct texts."""
    known = F.log2(texts * F.col("nct") / (F.col("nc") * F.col("nt"))) / F.log2(texts / F.col("nc"))
    return pair.join(spread, "term").withColumn("share", F.when(texts > F.col("nc"), F.round(known, 9)).otherwise(F.lit(0.0)))


def revealing(found: DataFrame, source: DataFrame, least: int, disclose: float) -> DataFrame:
    """(term, kind, mask): terms that disclose an entity, generalised to their longest safe stem or removed.

    All numbers are of distinct texts, so copies count once: nc of an entity, nt of a term, nct of both in one
    text, the term outside of all spans there. Entities and pairs of under `least` texts are no evidence.
    A term discloses an entity if log2(texts nct / (nc nt)) is at least the share `disclose` of log2(texts / nc), so that
    at least (nc / texts) to the power 1 - disclose of the texts that hold the term hold the entity too.
    The corpus decides how far a term is generalised: a stem stands for all terms that begin with it, is counted
    like a term, and is safe if it discloses none of the entities that its term does.
    """
    told = found.where("size(facts) > 0").select("context", "facts", "terms").dropDuplicates(["context"])
    fact = durable(told.select("context", F.explode("facts").alias("entity")))
    entity = durable(fact.groupBy("entity").agg(F.count("*").alias("nc")).where(F.col("nc") >= least))
    texts = F.lit(found.select("context").distinct().count())
    known = fact.join(entity, "entity")
    held = durable(told.select("context", F.explode("terms").alias("term")))
    low = held.groupBy("term").agg(F.count("*").alias("nt"))
    pair = known.join(held, "context").groupBy("entity", "nc", "term").agg(F.count("*").alias("nct")).where(F.col("nct") >= least)
    pair = durable(told_share(pair, low, texts).where(F.col("share") >= disclose).drop("nt", "share"))  # no term is in fewer texts than these
    spread = holding(source, durable(pair.select("term").distinct()), terms(F.col("text")), "context").distinct().groupBy("term").agg(F.count("*").alias("nt"))
    pair = durable(told_share(pair, durable(spread), texts).where(F.col("share") >= disclose).select("entity", "nc", "term"), over=pair)

    # Stems, by their counts within the entities' texts first: these are bounds that prove most of them safe.
    short = durable(pair.select("entity", "nc", F.col("term").alias("full"), F.explode(stems(F.col("term"))).alias("term")))
    of_term = lambda t: F.concat(stems(t), F.array(t))
    wanted = short.select("term").distinct()
    inside = durable(held.select("context", F.explode(of_term(F.col("term"))).alias("term")).join(wanted, "term").distinct())
    low = inside.groupBy("term").agg(F.count("*").alias("nt"))
    both = fact.join(short.select("entity").distinct(), "entity").join(inside, "context").groupBy("entity", "term").agg(F.count("*").alias("nct"))
    short = durable(short.join(both, ["entity", "term"]))
    worst = lambda spread: told_share(short, spread, texts).groupBy("full", "term").agg(F.max("share").alias("share"))
    bound = durable(worst(low))
    proven = bound.where(F.col("share") < disclose).groupBy("full").agg(F.max(F.length("term")).alias("long"))
    open_ = durable(bound.join(proven, "full", "left").where((F.col("share") >= disclose) & (F.length("term") > F.coalesce("long", F.lit(0)))).select("full", "term"))
    of_text = F.flatten(F.transform(terms(F.col("text")), of_term))
    spread = durable(holding(source, durable(open_.select("term").distinct()), of_text, "context").distinct().groupBy("term").agg(F.count("*").alias("nt")))
    decided = worst(spread).join(open_, ["full", "term"], "left_semi")
    safe = bound.unionByName(decided).where(F.col("share") < disclose)
    mask = safe.groupBy("full").agg(F.max(F.struct(F.length("term").alias("n"), "term")).alias("best")).select(F.col("full").alias("term"), F.concat("best.term", F.lit("*")).alias("mask"))
    return pair.select("term").distinct().join(mask, "term", "left").select("term", F.when(F.col("mask").isNull(), 5).otherwise(4).alias("kind"), F.coalesce("mask", F.lit("")).alias("mask"))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, disclose: float = 0.9) -> DataFrame:
    """(id, context, base, all): each row's base spans and all its spans, the latter with their masks; context is a hash of the text.

    Revealing terms are spans in every row that holds them, whether or not it holds the entity.
    Other columns aren't carried. Equal rows have equal spans and stay repeated.
    """
    source = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("context", F.xxhash64("text"))
    found = source.withColumn("base", base_spans(F.col("text")))
    outside = F.when(F.size("base") > 0, terms(masked(F.col("text"), F.col("base"), (" ",) * len(KINDS))))
    found = durable(found.select("id", "context", bare(F.col("base")).alias("base"), facts(F.col("base")).alias("facts"), outside.alias("terms")))
    told = durable(revealing(found, source, least, disclose))
    exposed = durable(holding(source, told.select("term"), terms(F.col("text")), "id", "context").select("id", "context").distinct())
    named = source.join(exposed.select(F.col("id").alias("i"), F.col("context").alias("c")), F.col("id").eqNullSafe(F.col("i")) & (F.col("context") == F.col("c"))).dropDuplicates(["id", "context"])
    token = named.select("id", "context", F.explode(spans(F.col("text"), 0, TERM)).alias("s")).withColumn("term", F.lower("s.match")).join(told, "term")
    more = token.groupBy("id", "context").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "kind", F.col("s.end").alias("end"), "mask"))).alias("more"))
    both = found.select("id", "context", "base").join(more.withColumnRenamed("id", "i").withColumnRenamed("context", "c"), F.col("id").eqNullSafe(F.col("i")) & (F.col("context") == F.col("c")), "left")
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.get(F.array(*map(F.lit, MASKS)), x["kind"]).alias("mask")))
    return both.select("id", "context", "base", F.when(F.col("more").isNull(), plain).otherwise(F.array_sort(F.concat(plain, outside_of(F.col("more"), F.col("base"))))).alias("all"))


def outside_of(more: Column, base: Column) -> Column:
    """The spans of `more` that overlap none of base; both are sorted by start, and those of `more` lie apart.

    Merged in order of start, a span is free of base if no base span before it reaches into it and none starts
    within it. The latter starts after it in the order; the next base span is the first that can.
    """

    def of_all(items: Column) -> Column:
        reach = running(F.transform(items, lambda x: F.when(x["mask"].isNull(), x["end"]).otherwise(0)), F.greatest)
        later = F.reverse(running(F.reverse(F.transform(items, lambda x: F.when(x["mask"].isNull(), x["start"] - FAR).otherwise(0))), F.least))
        told = F.zip_with(F.zip_with(items, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), later, lambda t, a: F.struct(t["x"].alias("x"), t["reach"].alias("reach"), a.alias("later")))
        return F.transform(F.filter(told, lambda t: t["x"]["mask"].isNotNull() & (t["reach"] <= t["x"]["start"]) & (t["later"] + FAR >= t["x"]["end"])), lambda t: t["x"])

    marked = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("mask")))
    return F.when(F.size(base) == 0, more).otherwise(let(F.array_sort(F.concat(marked, more)), of_all))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row for each row of df: id, the numbers of base spans of each kind, base_sha256, and all spans as text.

    Null texts count as empty and have no spans. Null and repeated ids stay. An empty table gives an
    empty result. Other columns aren't carried.
    """
    a = annotate(df, id_col, text_col, **limits)
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return a.select(F.col("id").alias(id_col), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def masked(text: Column, items: Column, masks: tuple[str, ...] | None = None) -> Column:
    """The text with each span replaced by its mask, or its kind's of `masks`; overlapping spans share the first one's."""

    def cut(part: Column) -> Column:
        """The texts before the spans of one block, and their masks. They are cut from the block's own stretch of the text."""
        low = F.get(part, F.lit(0))["from"]
        stretch = F.substring(text, low + 1, F.element_at(part, -1)["start"] - low)
        return let(stretch, lambda s: F.array_join(F.transform(part, lambda x: F.concat(F.substring(s, x["from"] - low + 1, x["start"] - x["from"]), x["mask"])), ""))

    def of_spans(v: Column) -> Column:
        reach = running(F.transform(v, lambda x: x["end"]), F.greatest)
        told = F.zip_with(v, reach, lambda x, r: F.struct(r.alias("from"), x["start"].alias("start"), (F.get(F.array(*map(F.lit, masks)), x["kind"]) if masks else x["mask"]).alias("mask")))
        new = F.filter(told, lambda x: x["start"] >= x["from"])
        rest = F.substring(text, F.array_max(F.transform(v, lambda x: x["end"])) + 1, F.length(text))
        return F.concat(let(new, lambda n: F.array_join(F.transform(blocks(n), cut), "")), rest)

    return F.when(F.size(items) > 0, let(items, of_spans)).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """df with personal data in its text masked, and revealing terms generalised or removed; null texts stay null.

    The texts are dealt out by id once, at every size: what a table's spans take doesn't tell how they are joined.
    """
    a = annotate(df, id_col, text_col, **limits).where("size(all) > 0").select(F.col("id").alias("_pii_id"), F.col("context").alias("_pii_key"), F.col("all").alias("_pii_spans")).dropDuplicates(["_pii_id", "_pii_key"])
    same = F.col(id_col).eqNullSafe(F.col("_pii_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_pii_key"))
    keyed = df.join(durable(a).hint("merge"), same, "left")
    text = F.when(F.col("_pii_spans").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("_pii_spans")))
    return keyed.withColumn(text_col, text).select(df.columns)
