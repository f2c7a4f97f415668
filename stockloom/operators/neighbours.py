"""Exact similarity joins of short strings by shared segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalars import similarity

#: Keeps a product such as 0.18 * 50 from ending just below the whole number that it stands for.
SLACK = 1e-9


def letter_bits(text: Column) -> Column:
    """The set of a text's letters as 64 bits; letters may share one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def similar_pairs(asked: DataFrame, known: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """(a, b, similarity) of all distinct strings a of asked (a) and b of known (b) whose similarity, 1 - edits / longer length, is at least least(shorter length).

    least doesn't grow with the length, and is above 0.5. No pair is lost: a known string is cut into one segment more than there can
    be edits between it and any partner, so one segment stands unchanged in the partner, and as the edits on both sides of
    it are bounded too, its place is known to within half of them. The strings meet by (length, segment number,
    segment) in an equi join; the edit distance decides. It is taken only of strings whose sets of letters allow it: each letter that
    the other lacks takes an edit. Strings of length 0 pair with nothing. Each string offers
    a number of segments that depends on its own length alone. Few bytes can meet in many pairs, so the strings are dealt out over all
    shuffle partitions, whatever their size.
    """
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["n", "i", "segment"]
    share = lambda n: F.floor((1 - least(n)) / least(n) * n + SLACK).cast("int")  # noqa: E731  most edits to a partner, which is longer by so many at most
    segment = lambda i, n, parts: F.floor(i * n / parts).cast("int")  # noqa: E731  where segment i begins
    k = known.select("b").where("b <> ''").repartition(parts, "b").distinct().withColumn("n", F.length("b")).withColumn("most", share(F.col("n"))).withColumn("b_letters", letter_bits(F.col("b")))
    k = k.select("b", "b_letters", "n", F.explode(F.sequence(F.lit(0), "most")).alias("i"), (F.col("most") + 1).alias("parts"))
    start = segment(F.col("i"), F.col("n"), F.col("parts"))
    k = k.select("b", "b_letters", "n", "i", F.substring("b", start + 1, segment(F.col("i") + 1, F.col("n"), F.col("parts")) - start).alias("segment"))
    a = asked.select("a").where("a <> ''").repartition(parts, "a").distinct().withColumn("m", F.length("a")).withColumn("a_letters", letter_bits(F.col("a")))
    reach = share(F.col("m"))
    a = a.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - reach), F.col("m") + reach))).withColumn("most", share(F.col("n")))
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), "most"))).withColumn("start", segment(F.col("i"), F.col("n"), F.col("most") + 1))
    a = a.withColumn("size", segment(F.col("i") + 1, F.col("n"), F.col("most") + 1) - F.col("start")).withColumn("longer", F.col("m") - F.col("n"))
    left, right = F.floor((F.col("most") - F.col("longer")) / 2).cast("int"), F.floor((F.col("most") + F.col("longer")) / 2).cast("int")
    low, high = F.greatest(F.lit(0), F.col("start") - left), F.least(F.col("m") - F.col("size"), F.col("start") + right)
    segments = F.array_distinct(F.transform(F.sequence(low, high), lambda at: F.substring(F.col("a"), at + 1, F.col("size"))))
    a = a.where(low <= high).select("a", "a_letters", "m", "n", "i", F.explode(segments).alias("segment"))
    edits = F.floor((1 - least(F.least("m", "n"))) * F.greatest("m", "n") + SLACK)
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    met = a.repartition(parts, *place).join(k.repartition(parts, *place), place)
    met = met.where((lacks("a_letters", "b_letters") <= edits) & (lacks("b_letters", "a_letters") <= edits))
    told = met.select("a", "b", similarity(F.col("a"), F.col("b")).alias("similarity"))
    return told.where(F.round("similarity", 9) >= least(F.least(F.length("a"), F.length("b")))).distinct()
