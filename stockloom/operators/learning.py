"""Learned names taken over from staged confirmations: dictionary, aliases, patterns and history, as tables before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def staged_once(staged: DataFrame) -> DataFrame:
    """One staged row of each supplier and name: the one confirmed most often, then the surest."""
    best = F.max(F.struct("occurrences", "confidence", "target", "source")).alias("r")
    return staged.where("supplier IS NOT NULL AND name IS NOT NULL AND target IS NOT NULL").groupBy("supplier", "name").agg(best).select("supplier", "name", "r.*")


def dictionary_with(staged: DataFrame, dictionary: DataFrame, prefix: str) -> DataFrame:
    """The dictionary (code, standard, approved, confidence, sources, aliases) with an approved entry for each staged target that it lacks."""
    known = dictionary.select(F.lower("standard").alias("low")).distinct()
    new = staged.withColumn("low", F.lower("target")).join(known, "low", "left_anti").groupBy("target").agg(F.max("confidence").alias("confidence"), F.sum("occurrences").alias("sources"))
    code = F.concat(F.lit(prefix), F.upper(F.left(F.md5("target"), F.lit(16))))
    new = new.select(code.alias("code"), F.col("target").alias("standard"), F.lit(True).alias("approved"), "confidence", "sources", F.lit(0).cast("long").alias("aliases"))
    return dictionary.unionByName(new.dropDuplicates(["code"]).join(dictionary.select("code"), "code", "left_anti"))


def coded(staged: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Staged rows with the code of their target: the approved entry first, then the surest, then the least code."""
    w = Window.partitionBy("low").orderBy(F.desc("approved"), F.desc("confidence"), "code")
    best = dictionary.select(F.lower("standard").alias("low"), "code", "approved", "confidence").withColumn("k", F.row_number().over(w)).where("k = 1").select("low", "code")
    return staged.withColumn("low", F.lower("target")).join(best, "low").drop("low")


def aliases_with(staged: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (supplier, name, raw, code, confidence, count) with the staged ones over them: what was surer or counted more stays so."""
    s = staged.select("supplier", "name", F.col("source").alias("r"), F.col("code").alias("c"), F.col("confidence").alias("s"), F.col("occurrences").alias("n"))
    both = aliases.join(s, ["supplier", "name"], "full")
    return both.select("supplier", "name", F.coalesce("r", "raw").alias("raw"), F.coalesce("c", "code").alias("code"), F.greatest("confidence", "s").alias("confidence"), F.greatest("count", "n").alias("count"))


def patterns_with(staged: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns (supplier, source, target, samples, successes, confidence, active): those that a staged row contradicts end, those that it repeats grow, new ones begin."""
    s = staged.groupBy("supplier", F.lower("source").alias("low")).agg(F.max(F.struct("occurrences", "confidence", "target", "source")).alias("s"))
    p = patterns.withColumn("low", F.lower("source")).join(s, ["supplier", "low"], "left")
    same = F.lower("target") == F.lower("s.target")
    grown = lambda c, v: F.when(same, F.greatest(c, v)).otherwise(F.col(c)).alias(c)
    old = p.select("supplier", "source", "target", grown("samples", "s.occurrences"), grown("successes", "s.occurrences"), grown("confidence", "s.confidence"), F.coalesce(same, F.col("active")).alias("active"))
    known = patterns.select("supplier", F.lower("source").alias("low"), F.lower("target").alias("low_target")).distinct()
    new = s.withColumn("low_target", F.lower("s.target")).join(known, ["supplier", "low", "low_target"], "left_anti")
    n = F.col("s.occurrences")
    return old.unionByName(new.select("supplier", "s.source", "s.target", n.alias("samples"), n.alias("successes"), "s.confidence", F.lit(True).alias("active")))


def history_with(staged: DataFrame, history: DataFrame) -> DataFrame:
    """History (supplier, raw, code, confidence, count, active): active entries of another code end, and each staged row without an active entry of its code begins one."""
    s = staged.groupBy("supplier", F.col("source").alias("raw")).agg(F.max(F.struct("occurrences", "confidence", "code")).alias("s"))
    old = history.join(s, ["supplier", "raw"], "left").withColumn("active", F.col("active") & F.coalesce(F.col("s.code") == F.col("code"), F.lit(True))).drop("s")
    known = history.where("active").select("supplier", "raw", F.col("code").alias("known")).distinct()
    new = s.join(known, (s["supplier"] == known["supplier"]) & (s["raw"] == known["raw"]) & (F.col("s.code") == F.col("known")), "left_anti")
    return old.unionByName(new.select("supplier", "raw", "s.code", "s.confidence", F.col("s.occurrences").alias("count"), F.lit(True).alias("active")))


def recounted(dictionary: DataFrame, aliases: DataFrame) -> DataFrame:
    """The dictionary with the numbers of its aliases; entries that have any are approved, and never less sure or less used than these."""
    c = aliases.groupBy("code").agg(F.count("*").alias("n"), F.sum("count").alias("s"), F.max("confidence").alias("sure"))
    d = dictionary.join(c, "code", "left")
    return d.select("code", "standard", (F.col("approved") | F.col("n").isNotNull()).alias("approved"), F.greatest("confidence", "sure").alias("confidence"), F.greatest("sources", "s").alias("sources"), F.coalesce("n", "aliases").alias("aliases"))


def synced(staged: DataFrame, tables: dict[str, DataFrame], prefix: str = "LEARNED-") -> dict[str, DataFrame]:
    """The four tables after all staged confirmations (supplier, source, name, target, confidence, occurrences). Syncing twice gives the same tables, as all are set to the greater value or looked up first."""
    once = staged_once(staged)
    dictionary = dictionary_with(once, tables["dictionary"], prefix)
    s = coded(once, dictionary)
    aliases = aliases_with(s, tables["aliases"])
    return {"dictionary": recounted(dictionary, aliases), "aliases": aliases, "patterns": patterns_with(s, tables["patterns"]), "history": history_with(s, tables["history"])}


def dry_run(staged: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, before, after): how many rows each table has and would have, of patterns and history the active ones. Nothing is written."""
    after = synced(staged, tables)
    live = lambda t: t.where("active") if "active" in t.columns else t
    rows = [live(t).select(F.lit(k).alias("kind"), F.lit(a).alias("before"), F.lit(b).alias("after")) for k in tables for t, a, b in ((tables[k], 1, 0), (after[k], 0, 1))]
    return reduce(DataFrame.unionByName, rows).groupBy("kind").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def confirmed(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Learning entries (supplier, name, product, confidence, count, auto, used) with a log of confirmations (the same, nulls for what it doesn't say): counts add up, the greatest confidence stays, the last word on auto holds."""
    both = entries.withColumn("given", F.lit(0)).unionByName(log.withColumn("count", F.coalesce("count", F.lit(1))).withColumn("given", F.lit(1)))
    last = F.max_by(F.col("auto"), F.when(F.col("auto").isNotNull(), F.struct("given", "used", "auto")))
    return both.groupBy("supplier", "name", "product").agg(F.coalesce(F.max("confidence"), F.lit(0)).alias("confidence"), F.sum("count").alias("count"), F.coalesce(last, F.lit(False)).alias("auto"), F.max("used").alias("used"))
