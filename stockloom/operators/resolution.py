"""Entity resolution of noisy product names: rules, aliases, fuzzy candidates and learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.names import HINTS, VENDOR, classified, clean, fingerprint, hinted_category, standard_aliases, standard_product, stated_category, storage_word, supplier_fingerprint
from stockloom.functions.scalars import similarity
from stockloom.operators.neighbours import similar_pairs
from stockloom.sources.sinks import written


def merge_rules(rules: DataFrame) -> DataFrame:
    """One rule for each (supplier, key): the best score of those with a confidence of 90 and a success, first target on ties."""
    ok = rules.where("confidence >= 90 AND success >= 1")
    w = Window.partitionBy("supplier", "key").orderBy(F.desc("score"), "target", F.desc("confidence"), F.desc("success"))
    return ok.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def without_conflicts(rules: DataFrame) -> DataFrame:
    """Rules whose key has one target only."""
    one = rules.groupBy("key").agg(F.countDistinct("target").alias("targets")).where("targets = 1").select("key")
    return rules.join(one, "key", "left_semi").dropDuplicates(["key"])


def fuzzy(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, target, category, similarity, margin, decision): the best entry of a dictionary for each name, from .5 on.

    dictionary: (target, category, alias), a fixed table of some hundred rows at most, as a product has few cuts. It is applied by itself
    only with at most 0, 1 or 2 edits by length, a similarity of .65, a lead over the next other target of .2 for names
    of up to three letters and else .12, and no unknown letters around the alias; a name's category hint must agree.
    """
    n = names.select("name", "hint").distinct().withColumn("k", fingerprint(F.col("name"))).where("k <> ''")
    d = dictionary.select("target", "category", fingerprint(F.col("alias")).alias("dk")).distinct()
    both = n.join(d, F.coalesce(F.col("hint"), F.col("category")) == F.col("category")).withColumn("similarity", F.round(similarity(F.col("k"), F.col("dk")), 9)).withColumn("distance", F.levenshtein("k", "dk"))
    best = both.groupBy("name", "hint", "k", "target", "category").agg(F.max(F.struct("similarity", (-F.col("distance")).alias("near"), "dk")).alias("b"))
    w = Window.partitionBy("name", "hint").orderBy(F.desc("b.similarity"), F.desc("b.near"), "target", "category")
    top = best.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("b.similarity").over(w)).where("rn = 1").select("name", "hint", "k", "target", "category", "next", "b.*")
    size, margin = F.greatest(F.length("k"), F.length("dk")), F.round(F.col("similarity") - F.coalesce("next", F.col("similarity") - 1), 9)
    most = F.when(size <= 2, 0).when(size <= 5, 1).otherwise(2)
    affix = (F.col("k") != F.col("dk")) & F.contains("k", F.col("dk")) & ~F.col("k").rlike("^.*(살|쌀|삽|삭)$")
    risky = ((F.col("target") == "가브리살") & ((F.length("k") <= 2) | (F.col("k").startswith("갈") & (F.col("k") != "갈비")))) | ((F.col("target") == "갈비") & F.col("k").startswith("가브"))
    sure = ~affix & ~risky & (-F.col("near") <= most) & (F.col("similarity") >= 0.65) & (margin >= F.when(size <= 3, 0.2).otherwise(0.12))
    decision = F.when(F.col("similarity") < 0.5, "NONE").when(sure, "AUTO").otherwise("REVIEW")
    return top.select("name", "hint", F.when(decision != "NONE", F.col("target")).alias("target"), "similarity", margin.alias("margin"), decision.alias("decision"))


def ranked(names: DataFrame, dictionary: DataFrame, most: int = 5) -> DataFrame:
    """The best entries for each name by the similarity of its best part, one for each category and target, ties by the longer target."""
    from stockloom.functions.names import term_similarity

    n = names.select("name").distinct().withColumn("k", fingerprint(F.col("name")))
    d = dictionary.select("target", "category", fingerprint(F.col("alias")).alias("dk")).distinct()
    best = n.join(d, F.col("dk") != "").groupBy("name", "category", "target").agg(F.round(F.max(term_similarity(F.col("k"), F.col("dk"))), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.desc(F.length("target")), "target", "category"))
    return best.withColumn("place", place).where(F.col("place") <= most)


def resolved(names: DataFrame, dictionary: DataFrame, auto: float = 0.80) -> DataFrame:
    """Each name's class, or where it has none the best ranked entry: applied by itself from `auto` on, for review from .65 on."""
    n = names.select("name").distinct().withColumn("x", classified(F.col("name")))
    top = ranked(n, dictionary, 1).select("name", F.col("target").alias("candidate"), "score")
    out = n.join(top, "name", "left")
    known = F.col("x.cut").isNotNull()
    decision = F.when(known, "CLASSIFIED").when(F.col("score") >= auto, "AUTO").when(F.col("score") >= 0.65, "REVIEW").otherwise("NONE")
    return out.select("name", F.when(known, F.col("x.cut")).when(decision.isin("AUTO", "REVIEW"), F.col("candidate")).alias("cut"), decision.alias("decision"))


def suggestions(names: DataFrame, dictionary: DataFrame, auto: float = 0.65, sure: float = 0.8) -> DataFrame:
    """(name, suggestion, confidence, review, others) of each name: the best entry from `auto` on, its score in percent, whether a person should confirm it, and the next two."""
    best = ranked(names, dictionary, 3)
    at = lambda n: F.max(F.when(F.col("place") == n, F.col("target")))
    x = best.groupBy("name").agg(F.max("score").alias("score"), at(1).alias("first"), F.concat_ws("|", at(2), at(3)).alias("others"))
    percent = F.floor(F.col("score") * 100 + 0.5).cast("long")
    return x.select("name", F.when(F.col("score") >= auto, F.col("first")).alias("suggestion"), percent.alias("confidence"), (percent <= sure * 100).alias("review"), "others")


#: A learned name's target in full: rules that agree in it don't compete.
IDENTITY = ("category", "storage", "print")
#: What a rule says of a product, and how surely.
RULE = ("target", "category", "storage", "confidence")


def learning_rank(rule: DataFrame) -> DataFrame:
    """Rules (supplier, source, target, category, storage, priority, confidence, success, day) with key, print (of the target) and rank; the last rule of a (supplier, key) by rank and target stays."""
    rank = F.col("priority").cast("long") * 1_000_000_000 + F.col("confidence") * 1_000_000 + F.least(F.col("success"), F.lit(999)) * 1000 + F.col("day")
    r = rule.withColumn("key", fingerprint(F.col("source"))).where("key <> ''").withColumn("print", fingerprint(F.col("target"))).withColumn("rank", rank)
    r = r.withColumn("said", storage_word(F.col("source")))
    kept = ["source", "target", "category", "storage", "priority", "print", "said", "confidence"]
    best = r.groupBy("supplier", "key").agg(F.max(F.struct("rank", *kept)).alias("r"))
    return best.select("supplier", "key", "r.*")


def top_two(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows (id, *group, *order, ...) by id: `best`, the row of the greatest order, and `rival`, that of the greatest one in another group; null without."""
    rest = [c for c in rows.columns if c not in ("id", *order)]
    best = rows.groupBy("id", *(F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in group)).agg(F.max(F.struct(*order, *rest)).alias("x"))
    w = Window.partitionBy("id").orderBy(F.desc("x"))
    return best.select("id", F.col("x").alias("best"), F.lead("x").over(w).alias("rival"), F.row_number().over(w).alias("n")).where("n = 1").drop("n")


def vendor_prefixes(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, *RULE) of names (id, supplier, name, key, hint) with a vendor's name behind the product's: the supplier's longest rule that begins the key.

    Rules of six letters or more count; shorter ones of four from a storage and category that name and hint
    don't contradict. No rule counts whose name states another storage, and none if a rule with another target is less than three letters shorter.
    """
    tail = names.where(F.col("supplier").isNotNull() & clean(F.col("name")).rlike(VENDOR)).withColumn("said_by_name", storage_word(F.col("name")))
    heads = tail.withColumn("head", F.explode(F.expr("transform(filter(sequence(4, greatest(4, length(key) - 1)), n -> n < length(key)), n -> left(key, n))")))
    own = rules.where("supplier IS NOT NULL AND length(key) >= 4").withColumnRenamed("key", "head")
    met = heads.join(own, ["supplier", "head"])
    agrees = lambda said: F.coalesce(said == F.col("category"), F.lit(True))
    short = F.col("storage").isin("냉장", "냉동") & F.col("category").isin(*(v for _, v in HINTS)) & F.coalesce(F.col("said_by_name") == F.col("storage"), F.lit(False)) & agrees(hinted_category(F.col("hint"))) & agrees(stated_category(F.col("name")))
    ok = met.where(((F.length("head") >= 6) | short) & F.coalesce(F.col("said_by_name") == F.col("said"), F.lit(True))).withColumn("size", F.length("head"))
    two = top_two(ok.select("id", *IDENTITY, "size", "rank", "target", "confidence"), list(IDENTITY), ["size", "rank"])
    return two.where(F.col("rival").isNull() | (F.col("best.size") - F.col("rival.size") >= 3)).select("id", *(F.col(f"best.{c}") for c in RULE))


def least_similarity(size: Column) -> Column:
    """Short names must agree more: by the shorter one's length."""
    return F.when(size <= 4, 0.95).when(size <= 7, 0.86).otherwise(0.82)


def fuzzy_rules(names: DataFrame, rules: DataFrame, margin: float = 0.06) -> DataFrame:
    """(id, *RULE, by, similarity) of names (id, supplier, name, key): the most similar rule of the supplier or for all, unless one with another target comes as near as margin.

    An own rule is ahead of one for all by .03, and priority by up to .005. Names and rules that both state a storage must state the same.
    """
    pairs = similar_pairs(names.select(F.col("key").alias("a")), rules.select(F.col("key").alias("b")), least_similarity)
    met = names.withColumn("said_by_name", storage_word(F.col("name"))).join(pairs, F.col("key") == F.col("a")).drop("key", "a")
    r = rules.select(F.col("supplier").alias("of"), F.col("key").alias("b"), *RULE, "print", "rank", "priority", "said")
    met = met.join(r, "b").where((F.col("of").isNull() | (F.col("of") == F.col("supplier"))) & F.coalesce(F.col("said_by_name") == F.col("said"), F.lit(True)))
    score = F.round(F.col("similarity") + F.when(F.col("of").isNotNull(), 0.03).otherwise(0.0) + F.least(F.col("priority"), F.lit(500)) / 100000, 9)
    scored = met.select("id", score.alias("score"), "rank", F.round("similarity", 9).alias("similarity"), "print", "target", F.when(F.col("of").isNotNull(), "supplier_fuzzy").otherwise("global_fuzzy").alias("by"), "category", "storage", "confidence")
    two = top_two(scored, ["print"], ["score", "rank"])
    apart = F.round(F.col("best.similarity") - F.col("rival.similarity"), 9) >= margin
    return two.where(F.col("rival").isNull() | apart).select("id", *(F.col(f"best.{c}") for c in RULE), "best.by", "best.similarity")


def found_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """What is learned of each name (id, supplier, name, hint): RULE, by and similarity of the supplier's own rule, its rule before a vendor's name, a rule for all, or the most similar rule; null without one.

    Equi joins throughout: the similar ones meet by shared segments, and only names that nothing else finds are asked there.
    """
    r = learning_rank(rules)
    n = names.select("id", "supplier", "name", "hint").withColumn("key", fingerprint(F.col("name")))
    rule = F.struct(*RULE)
    own = r.where("supplier IS NOT NULL").select("supplier", "key", rule.alias("own"))
    every = r.where("supplier IS NULL").select("key", rule.alias("every"))
    prefix = vendor_prefixes(n, r).select("id", rule.alias("prefix"))
    x = n.join(own, ["supplier", "key"], "left").join(every, "key", "left").join(prefix, "id", "left")
    by = F.when(F.col("own").isNotNull(), "supplier_exact").when(F.col("prefix").isNotNull(), "supplier_prefix").when(F.col("every").isNotNull(), "global_exact")
    x = x.select("id", "supplier", "name", "key", F.coalesce("own", "prefix", "every").alias("rule"), by.alias("by"))
    near = fuzzy_rules(x.where("by IS NULL AND key <> ''").select("id", "supplier", "name", "key"), r).select("id", rule.alias("near"), F.col("by").alias("near_by"), "similarity")
    sure = F.when(F.col("by") == "supplier_prefix", 0.97).when(F.col("by").isNotNull(), 1.0)
    return x.join(near, "id", "left").select("id", F.coalesce("rule", "near").alias("r"), F.coalesce("by", "near_by").alias("by"), F.coalesce(sure, "similarity").alias("similarity")).select("id", "r.*", "by", "similarity")


def classified_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, category, cut, qualifier, storage, confidence, code, by, key) of each name (id, supplier, name, hint): a standard product, else what is learned, else what the rules of cuts read.

    A standard product counts unless name, hint or skin state another category. Cuts that two species have take the stated one.
    The name's own storage goes before the learned one.
    """
    n = names.select("id", "name", "hint")
    x = n.withColumn("x", classified(F.col("name"))).withColumn("print", fingerprint(F.col("name")))
    declared = F.coalesce(stated_category(F.col("name")), hinted_category(F.col("hint")), F.when(F.col("x.skin") != "unknown", "돼지고기"))
    x = x.withColumn("declared", declared).withColumn("standard", standard_product(standard_aliases(F.col("x.name")), F.col("x.skin")))
    x = x.withColumn("standard", F.when(F.coalesce(F.col("standard.category") == F.col("declared"), F.lit(True)), F.col("standard")))
    learned = found_rules(names, rules).select("id", F.when(F.col("target").isNotNull(), F.struct(*RULE)).alias("learned"), F.col("by").alias("how"))
    x = x.join(learned, "id", "left")
    shared = F.when(F.col("x.cut").rlike("^(안심|등심|사태|갈비)$"), F.coalesce("declared", "x.category")).otherwise(F.col("x.category"))
    by = F.when(F.col("standard").isNotNull(), "standard").when(F.col("learned").isNotNull(), F.col("how")).when(F.col("x.cut").isNotNull(), "rule").otherwise("none")
    category, cut = F.coalesce("standard.category", "learned.category", shared), F.coalesce("standard.cut", "learned.target", "x.cut")
    sure = F.when(F.col("standard").isNotNull(), 100).when(F.col("learned").isNotNull(), F.least(F.lit(100), F.col("learned.confidence"))).when(F.col("x.cut").isNotNull(), F.col("x.confidence")).otherwise(60).cast("long")
    stated = F.when(F.col("x.storage") != "미표기", F.col("x.storage"))
    storage = F.coalesce(stated, F.when(F.col("learned.storage") != "", F.col("learned.storage")), F.lit("보관미상"))
    x = x.select("id", "print", category.alias("category"), cut.alias("cut"), storage.alias("storage"), sure.alias("confidence"), F.col("standard.code").alias("code"), by.alias("by"), F.col("x.skin").alias("skin"), F.coalesce("standard.qualifier", F.when(F.col("learned").isNull(), F.col("x.qualifier")), F.lit("")).alias("own"))
    pork = F.coalesce(F.col("category") == "돼지고기", F.lit(False))
    qualifier = F.when(pork & (F.col("skin") == "skin_on"), "미박").when(pork & (F.col("skin") == "skinless") & (F.col("cut") != "삼겹"), "박피").otherwise(F.col("own"))
    x = x.withColumn("qualifier", qualifier)
    key = F.lower(F.concat_ws("|", F.coalesce("category", F.lit("미분류")), "storage", F.coalesce("cut", "print"), "qualifier"))
    return x.select("id", "category", "cut", "qualifier", "storage", "confidence", "code", "by", key.alias("key"))


def storage_inferred(text: Column, context: Column, moved: Column, expiry: Column, slaughter: Column, shelf_days: Column, known: Column) -> Column:
    """(storage, source, confidence): what the name says, else the document, an expiry not yet past, an age within the shelf life, a learned rule."""
    say = lambda s, source, sure: F.struct(s.alias("storage"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    stated = lambda t: F.when(t.contains("냉동"), "냉동").when(t.contains("냉장"), "냉장")
    age = F.datediff(moved, slaughter)
    chilled = F.lit("냉장")
    return (
        F.when(stated(text).isNotNull(), say(stated(text), "explicit_name", 100)).when(stated(context).isNotNull(), say(stated(context), "document_context", 94)).when(F.datediff(moved, expiry) <= 0, say(chilled, "expiry_date", 96))
        .when((age >= 0) & (age <= shelf_days), say(chilled, "slaughter_age", 90)).when(known.isNotNull(), say(known, "learned_pattern", 90)).otherwise(say(F.lit("보관미상"), "unknown", 0))
    )


def matched(names: DataFrame, aliases: DataFrame, memory: DataFrame, least: float = 0.7) -> DataFrame:
    """Each name's product: by an exact alias, an exact memory, else the best of the similar aliases and memories; with status.

    An exact alias counts from a confidence of 90 on. A similar alias scores its similarity, a similar memory that times
    its own score, 99 at most; from 86 on it is for review, below a proposal for a new alias. Names that nothing resembles by `least`
    are new without a proposal. Similar names meet by shared segments, so none is lost. Of a key's memories of one product
    the greatest score decides. Only names whose best score a similarity below .85 can still reach are compared further.
    """
    a = aliases.groupBy("key").agg(F.max(F.struct("confidence", "product")).alias("a"))
    m = memory.groupBy("key").agg(F.max(F.struct("score", "product")).alias("m"))
    n = names.select("name").distinct().withColumn("key", fingerprint(F.col("name")))
    x = written(n.join(a, "key", "left").join(m, "key", "left"))
    rated = aliases.select("key", "product", F.lit(100).alias("most"), F.lit(1).alias("kind")).unionByName(memory.select("key", "product", F.col("score").alias("most"), F.lit(0).alias("kind")))
    rated = written(rated.groupBy(F.col("key").alias("b"), "product", "kind").agg(F.max("most").alias("most")))
    score = lambda most, alike: F.floor(F.least(most, alike) + 0.5).cast("long")
    s = score(F.when(F.col("kind") == 1, 100).otherwise(99), F.round("similarity", 9) * F.col("most"))
    asked, near = x.where("a IS NULL AND m IS NULL").select("key").distinct(), []
    for step in sorted({max(0.85, least), least}, reverse=True):
        pairs = similar_pairs(asked.select(F.col("key").alias("a")), rated.select("b"), lambda size, step=step: F.lit(step))
        found = pairs.join(rated, "b").groupBy(F.col("a").alias("key")).agg(F.max(F.struct(s.alias("s"), "kind", F.col("product").alias("p"))).alias("c"))
        best = written(found)
        sure = F.lit(step == least) | (F.col("c.s") > score(F.lit(100), F.lit(100 * step)))
        near.append(best.where(sure))
        asked = asked.join(near[-1], "key", "left_anti")
    x = x.join(reduce(DataFrame.unionByName, near), "key", "left")
    status = F.when(F.col("a").isNotNull(), F.when(F.col("a.confidence") >= 90, "matched").otherwise("needs_review")).when(F.col("m").isNotNull(), "learned_match").when(F.col("c.s") >= 86, "needs_review").otherwise("new_alias_candidate")
    score = F.coalesce("a.confidence", F.when(F.col("m").isNotNull(), F.least(F.lit(99), F.col("m.score"))), "c.s", F.lit(0)).cast("long")
    return x.select("name", F.coalesce("a.product", "m.product", "c.p").alias("product"), score.alias("score"), status.alias("status"))


def natural_labels(memory: DataFrame) -> DataFrame:
    """The display name of each product with the best score, ties by name."""
    return memory.groupBy("product").agg(F.max(F.struct("score", "label")).alias("b")).select("product", "b.label")


def halving_confidence(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Patterns from their log in order: samples and successes together; each entry's confidence is averaged with what was before and rounded.

    The fold runs as a stream over sorted rows; its last row counts.
    """
    from .delivery import sorted_fold

    rows = log.select(*keys, *order, "samples", "successes", "confidence")

    def step(state: tuple | None, r: tuple) -> tuple[tuple, tuple]:
        samples, successes, confidence = r[-3:]
        n, ok, sure = state or (0, 0, None)
        sure = int(confidence) if sure is None else min(100, int((sure + confidence) / 2 + 0.5))
        state = (n + int(samples), ok + int(successes), sure)
        return state, (*r[: len(keys)], *state)

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", samples long, successes long, confidence long"
    made = sorted_fold(rows, keys, order, step, schema)
    return made.groupBy(*keys).agg(F.max_by(F.struct("successes", "confidence"), "samples").alias("x"), F.max("samples").alias("samples")).select(*keys, "samples", "x.*")


def dictionary_score(name: Column, alias: Column, memory: Column, learning: Column, times: Column, sources: Column, history: Column) -> Column:
    """(confidence, route) of a dictionary candidate, each part within its limit."""
    parts = name * 0.38 + F.least(F.lit(20), alias * 0.2) + F.least(F.lit(15), memory * 0.15) + F.least(F.lit(15), learning / 10 + F.log2(times + 1.0) * 2) + F.least(F.lit(20), sources * 4) + F.least(F.lit(12), history * 3)
    sure = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(parts + 0.5))).cast("long")
    return F.struct(sure.alias("confidence"), F.when(sure >= 95, "AUTO_APPROVED").when(sure >= 80, "REVIEW_REQUIRED").when(sure >= 60, "USER_SELECT").otherwise("UNKNOWN").alias("route"))


def memory_score(source: Column, confidence: Column, uses: Column, verified: Column) -> Column:
    """A product of weights; it can exceed 1."""
    return source * confidence * (1 + F.least(F.lit(0.2), uses * 0.02)) * F.when(verified, 1.1).otherwise(1.0)


def memory_upsert(log: DataFrame) -> DataFrame:
    """The alias memory from its event log: greatest confidence, uses together, last target."""
    return log.groupBy("key").agg(F.max("confidence").alias("confidence"), F.count("*").alias("uses"), F.max_by("target", F.struct("seen", "target")).alias("target"))


def promotions(confirmed: DataFrame, times: int = 3, suppliers: int = 2) -> DataFrame:
    """Confirmed rules that hold for the whole business: those without a supplier, confirmed three times or by two suppliers."""
    c = confirmed.groupBy("key", "target").agg(F.count("*").alias("confirmations"), F.countDistinct("supplier").alias("suppliers"), F.max(F.col("supplier").isNull()).alias("free"))
    return c.where(F.col("free") | (F.col("confirmations") >= times) | (F.col("suppliers") >= suppliers)).drop("free")


def rule_conflicts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("key").agg(F.countDistinct("target").alias("targets"), F.countDistinct("supplier").alias("suppliers")).where("targets > 1")


def mapping_decision(first: Column, second: Column) -> Column:
    return F.when((first >= 0.9) & (first - F.coalesce(second, F.lit(0.0)) >= 0.1), "AUTO").when(first >= 0.75, "SUGGESTED").otherwise("NONE")


def suppliers_of(asked: DataFrame, known: DataFrame, printed: str) -> DataFrame:
    """asked with the supplier (least id) whose name has the same fingerprint as the printed one; null without one."""
    keys = known.groupBy(supplier_fingerprint(F.col("name")).alias("_key")).agg(F.min("id").alias("supplier"))
    return asked.withColumn("_key", supplier_fingerprint(F.col(printed))).join(keys, "_key", "left").drop("_key")


def by_resolved_name(rows: DataFrame, name: str, amount: str) -> DataFrame:
    """Rows by the product that their name means: number, sum, and the canonical names in order (a product has few)."""
    x = rows.select(classified(F.col(name)).alias("x"), amount)
    return x.groupBy("x.key").agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("amount"), F.array_sort(F.collect_set("x.name")).alias("names"))
