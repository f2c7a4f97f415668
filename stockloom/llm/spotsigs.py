"""SpotSigs fingerprints: chains of content words that follow common-word anchors (operator 7)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .quality_rules import let

#: Frequent function words of English, French, German and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "dans", "que", "pour",
    "der", "die", "das", "den", "und", "ein", "eine", "ist", "von", "mit",
    "el", "los", "las", "y", "en", "es", "del", "por", "con", "para",
)
CHAIN = 2


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of a text's spot signatures, as array<bigint>.

    A signature is an anchor and the next chain words that aren't anchors. Letter case and everything
    but letters and digits don't count. In a text without any, every word counts as an anchor, and a
    text too short even for that has one signature for all its words.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    anchor = "(?:" + "|".join(anchors) + ")"
    found = F.regexp_extract_all(plain, F.lit(f" (?=({anchor}(?: (?:{anchor} )*+[^ ]++){{{chain}}}) )"), F.lit(1))
    chains = F.transform(found, lambda x: F.xxhash64(F.regexp_replace(x, f" {anchor}(?= )", "")))
    every = F.transform(F.regexp_extract_all(plain, F.lit(f" (?=([^ ]++(?: [^ ]++){{{chain}}}) )"), F.lit(1)), lambda x: F.xxhash64(x))
    whole = F.array(F.xxhash64(F.regexp_replace(plain, " +", " ")))
    fallback = let(every, lambda x: F.when(F.size(x) > 0, x).otherwise(whole))
    return F.array_sort(F.array_distinct(let(chains, lambda x: F.when(F.size(x) > 0, x).otherwise(fallback))))


def fingerprint(items: Column) -> Column:
    """The signature set as text: 16 hex digits for each signature, in order."""
    return F.array_join(F.transform(items, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, neither of them empty."""
    common = F.size(F.array_intersect(a, b))
    return (common / (F.size(a) + F.size(b) - common)).cast("double")


def length_part(size: Column, least: float) -> Column:
    """Sets of a likeness of at least `least` lie in the same length partition or in neighbours."""
    return F.floor(F.log(size.cast("double")) / -math.log(least) + 1e-9).cast("int")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of distinct fingerprints with at least that likeness, and the membership (id, class).

    A class is the rows of one fingerprint, named by their least id; pairs are between classes.
    Each set offers its rarest signatures, so many that two sets of that likeness share one of them; they
    meet by signature and length partition if their sizes allow that likeness, and the comparison of the full sets decides.
    """
    sets = durable(df.select(F.col(id_col).alias("id"), signatures(text_or_empty(text_col)).alias("items")))
    classes = durable(sets.groupBy("items").agg(F.min("id").alias("class")))
    member = sets.join(classes, "items").select("id", "class")
    one = classes.select("class", F.size("items").alias("n"), F.explode("items").alias("item"))
    rare = one.join(one.groupBy("item").agg(F.count("*").alias("df")), "item")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "item"))
    offered = rare.withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).withColumn("part", length_part(F.col("n"), least))
    left = offered.select("item", F.col("class").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = offered.select("item", "part", F.col("class").alias("b"), F.col("n").alias("nb"))
    near = left.join(right, ["item", "part"]).where("na <= nb AND (na < nb OR a < b)").where(F.col("na") >= F.col("nb") * least)
    pairs = near.select("a", "b").distinct()
    both = pairs.join(classes.select(F.col("class").alias("a"), F.col("items").alias("s")), "a").join(classes.select(F.col("class").alias("b"), F.col("items").alias("t")), "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("s"), F.col("t")).alias("likeness")).where(F.col("likeness") >= least), member


def first_keys(keys: DataFrame) -> list[int]:
    """The least k of each of as many ranges as there are shuffle partitions."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("k")).collect()
    return sorted({r["k"] for r in found}) or [0]


def with_next(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """rows (with a k) and, as struct next, the columns of the row after in the order of k and order; after the last comes the first.

    The rows are dealt out by ranges of k in one shuffle. The first rows of a range also go to the range
    before, behind its own rows, so that each range can be finished alone.
    """
    firsts = first_keys(rows.select("k"))
    edges = F.array(*map(F.lit, firsts))
    steps = [1 << i for i in range(len(firsts).bit_length() - 1, -1, -1)]
    part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(F.get(edges, i + s) <= F.col("k"), i + s).otherwise(i))
    dealt = rows.withColumn("part", part)
    to = F.when(F.get(edges, F.col("part")) == F.col("k"), F.array(F.col("part"), F.pmod(F.col("part") - 1, F.lit(len(firsts))))).otherwise(F.array("part"))
    dealt = dealt.select(*rows.columns, F.posexplode(to).alias("copy", "part"))
    span = Window.partitionBy("part").orderBy("copy", "k", *order)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(span)).where("copy = 0").drop("copy", "part")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """One row for each row of df: its fingerprint, that of its edited text, and two likenesses.

    The edited text has its last quarter replaced by as much of the start of the next row's text, in
    ascending order of id; after the last comes the first. Null texts count as empty. Null ids come
    first; rows that repeat an id follow each other in the order of their texts. A single row is its own
    next. An empty table gives an empty result. Other columns aren't carried. length_part is the
    fingerprint's length partition for near_pairs() at a likeness of `least`.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    docs = df.select(key.alias("k"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("items", signatures(F.col("text")))
    both = with_next(docs, ["text"], ["text", "items"])
    edited = F.expr("concat(left(text, int(length(text) - floor(length(text) / 4))), left(next.text, int(floor(length(text) / 4))))")
    both = both.withColumn("edited", edited).withColumn("edited_items", signatures(F.col("edited")))
    return both.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("items")).alias("fingerprint"),
        fingerprint(F.col("edited_items")).alias("edited_fingerprint"),
        likeness(F.col("items"), F.col("edited_items")).alias("near_edited"),
        likeness(F.col("items"), F.col("next.items")).alias("near_next"),
        length_part(F.size("items"), least).alias("length_part"),
    )
