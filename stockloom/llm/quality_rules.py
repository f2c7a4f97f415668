"""Quality rules: base counts, and divergence from language references (operator 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty, words

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of each language; other languages use all of them together.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "it"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "en"),
    "de": ("der", "die", "das", "den", "und", "in", "ein", "eine", "ist", "von"),
    "es": ("el", "la", "los", "de", "y", "en", "que", "un", "una", "del"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even if body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(items: Column, zero: int | float = 0) -> Column:
    return F.aggregate(items, F.lit(zero), lambda a, x: a + x)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in windows of so many words that occur twice or more."""

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return total(gap)

    def starts(ranked: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
        twice = F.transform(ranked, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

    def of_hashes(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ranked, lambda r: let(starts(r), covered)))

    def of_words(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.when(F.size(w) <= window, 0).otherwise(let(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, window))), of_hashes))

    return let(found, of_words)


def kept_chars(text: Column, chars: str) -> Column:
    """Number of the text's characters in the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def histogram(found: Column, lang: Column) -> Column:
    """Counts of the language's common words, in the order of COMMON, and of all other words."""
    rest = sorted({x for v in COMMON.values() for x in v})
    lists = [(lang == k, v) for k, v in COMMON.items()] + [(F.lit(True), rest)]
    chosen = F.coalesce(*(F.when(is_it, F.array(*map(F.lit, v))) for is_it, v in lists))

    def counts(pair: Column) -> Column:
        return F.transform(pair["names"], lambda x: F.size(F.filter(pair["words"], lambda y: x == y)))

    def of_names(names: Column) -> Column:
        plain = F.filter(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")), lambda x: F.array_contains(names, x))
        return let(F.struct(names.alias("names"), plain.alias("words")), counts)

    return let(chosen, of_names)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if one is empty."""
    a, b = total(p).cast("double"), total(q, 0.0)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(x: Column, y: Column) -> Column:
        u, v = x / a, y / b
        return part(u, (u + v) / 2) / 2 + part(v, (u + v) / 2) / 2

    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)))).otherwise(0.0)


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = 0.25, max_common: float = 0.25, least_words: int = 40, least_rows: int = 20) -> DataFrame:
    """One row for each row of df: the base counts, base_failed, the two distances and kept.

    A language's reference is a trimmed mean of its rows' histograms, of character classes and of its
    common words. Rows of at least least_words words that pass the base rules count; those beyond either
    greatest distance from their mean are left out, and the mean of the others is the reference. A language of
    fewer than least_rows counting rows has none, and its rows are at distance 0. A row is dropped if it
    failed the base rules, or if either distance exceeds its limit; texts under least_words words are
    not judged by their distances. Null texts have no words and fail the base rules. A null language is a
    language of its own. Repeated rows count and stay; an empty table gives an empty result. Other
    columns aren't carried.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = source.select(
        "id", "lang", F.length("text").alias("n_chars"),
        F.length(F.regexp_replace("text", SPACES, "")).alias("word_chars"), kept_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        kept_chars(F.col("text"), r"\p{Ll}").alias("lower"), kept_chars(F.col("text"), r"\p{Lu}").alias("upper"), kept_chars(F.col("text"), "0-9").alias("digits"), kept_chars(F.col("text"), ".,;:!?'\"()-").alias("stops"),
        repeated.alias("n_dup_lines"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), histogram(w, F.col("lang")).alias("common"))).alias("w"),
    )
    known = F.col("lower") + F.col("upper") + F.col("digits") + F.col("stops") + F.col("n_symbols")
    counted = counted.select(
        "id", "lang", "n_chars", F.col("w.n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words"),
        F.array("lower", "upper", "digits", "stops", "n_symbols", F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - known).alias("classes"),
        F.concat("w.common", F.array(F.col("w.n_words") - total(F.col("w.common")))).alias("common"),
    )
    counted = durable(counted)

    def mean(name: str, size: int, over: Column) -> Column:
        return F.array(*(F.coalesce(F.avg(F.when(over > 0, F.get(name, F.lit(i)) / over)), F.lit(0.0)) for i in range(size))).alias(f"{name}_of")

    most = max(len({x for v in COMMON.values() for x in v}), *map(len, COMMON.values())) + 1
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    long_enough = F.col("n_words") >= least_words
    near = (F.col("class_distance") <= max_class) & (F.col("common_distance") <= max_common)

    def reference(rows: DataFrame) -> DataFrame:
        means = rows.groupBy("lang").agg(F.count("*").alias("rows"), mean("classes", 7, F.col("n_chars")), mean("common", most, F.col("n_words")))
        return means.where(F.col("rows") >= least_rows).drop("rows").withColumnRenamed("lang", "of")

    def judged(rows: DataFrame, means: DataFrame) -> DataFrame:
        far = lambda name: F.round(F.coalesce(divergence(F.col(name), F.slice(f"{name}_of", F.lit(1), F.size(name))), F.lit(0.0)), 9)
        both = rows.join(means, F.col("lang").eqNullSafe(F.col("of")), "left")
        return both.withColumn("class_distance", far("classes")).withColumn("common_distance", far("common")).drop("of", "classes_of", "common_of")

    counting = counted.where(long_enough & ~failed)
    first = durable(reference(counting))
    trimmed = durable(reference(judged(counting, first).where(near)))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(counted, trimmed).select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & (near | ~long_enough)).alias("kept"), "class_distance", "common_distance")
