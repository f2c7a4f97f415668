"""Quality classifier by co-training a text view and a page-metadata view (operator 1)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty, words
from .quality_rules import COMMON, SPACES, kept_chars, let

BINS = 16
#: Of all rows without a label, a view labels this share for the other one: its surest ones, of either class in proportion to the labels.
SURE = 0.25
#: The weight of such a label, times how far the view beats chance on the held-out labels of the same scores.
PSEUDO = 0.5
ROUNDS = 2
#: One labelled row in so many is held out to calibrate and combine the views.
HELD = 4
#: Stands for a null language or source.
NONE = "\u0000"


def share(part: Column, whole: Column) -> Column:
    """A share's bin; small shares get the finer bins."""
    return F.when(whole > 0, F.least(F.lit(BINS - 1), F.floor(F.sqrt(part / whole) * BINS))).otherwise(0).cast("int")


def size(x: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.log2(x + 1.0))).cast("int")


def text_view(text: Column) -> Column:
    """Bins of what the text consists of: letter cases, marks, digits, word lengths, variety, common words, repeated lines."""
    common = sorted({x for v in COMMON.values() for x in v})

    def of_words(w: Column) -> Column:
        n = F.size(w)
        known = F.size(F.filter(w, lambda x: F.lower(x).isin(common)))
        return F.struct(n.alias("n"), F.size(F.array_distinct(w)).alias("kinds"), known.alias("common"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))

    def bins(s: Column) -> Column:
        w, lines = s["words"], s["lines"]
        letters = s["upper"] + s["lower"]
        return F.array(
            share(s["upper"], letters), share(s["symbols"], s["chars"]), share(s["stops"], s["chars"]), share(s["marks"], s["chars"]), share(s["digits"], s["chars"]),
            F.when(w["n"] > 0, F.least(F.lit(BINS - 1), F.floor(s["chars"] / w["n"]))).otherwise(0).cast("int"),
            share(w["n"] - w["kinds"], w["n"]), share(w["common"], w["n"]), share(lines["n"] - lines["kinds"], lines["n"]),
        )

    parts = F.struct(
        F.length(F.regexp_replace(text, SPACES, "")).alias("chars"), kept_chars(text, r"\p{Lu}").alias("upper"), kept_chars(text, r"\p{Ll}").alias("lower"),
        kept_chars(text, "#*$%&|<>{}=").alias("symbols"), kept_chars(text, ".,;:?").alias("stops"), kept_chars(text, "!").alias("marks"), kept_chars(text, "0-9").alias("digits"),
        let(words(text), of_words).alias("words"), let(F.split(text, "\n", -1), of_lines).alias("lines"),
    )
    return let(parts, bins)


def odds_of(n: np.ndarray, values: int) -> np.ndarray:
    """Log odds of good from counts (..., 2) of bad and good, smoothed over so many values."""
    smooth = (n + 0.5) / (n.sum(axis=-2, keepdims=True) + 0.5 * values)
    return np.log(smooth[..., 1] / smooth[..., 0])


def binned(told: DataFrame, bins: str) -> tuple[float, list[list[float]]]:
    """The prior and the log odds of good for each feature and bin, from (y, w, bins): at most features x BINS x 2 counts reach the driver."""
    counts = told.select("y", "w", F.posexplode(bins).alias("f", "bin")).groupBy("f", "bin", "y").agg(F.sum(F.col("w").cast("decimal(20,4)")).cast("double").alias("n")).collect()
    n = np.zeros((max((r["f"] for r in counts), default=0) + 1, BINS, 2))
    for r in counts:
        n[r["f"], r["bin"], r["y"]] = r["n"]
    totals = n[0].sum(axis=0)
    if not totals.all():
        return 0.0, np.zeros(n.shape[:2]).tolist()
    return math.log(totals[1] / totals[0]), odds_of(n, BINS).tolist()


def valued(told: DataFrame, name: str) -> DataFrame:
    """(name, name_odds): log odds of good for each exact value that the told rows have; other values are neutral."""
    weight = lambda y: F.sum(F.when(F.col("y") == y, F.col("w")).otherwise(0).cast("decimal(20,4)")).cast("double")
    n = durable(told.groupBy(name).agg(weight(0).alias("n0"), weight(1).alias("n1")))
    total = n.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("k")).first()
    if not total["t0"] or not total["t1"]:
        return n.select(name, F.lit(0.0).alias(f"{name}_odds"))
    part = lambda y: (F.col(f"n{y}") + 0.5) / (total[f"t{y}"] + 0.5 * total["k"])
    return n.select(name, F.round(F.log(part(1) / part(0)), 6).alias(f"{name}_odds"))


def fitted(told: DataFrame) -> tuple[tuple, tuple]:
    """The text model and the page model from told rows (y and w of either view)."""
    text = told.select(F.col("text_y").alias("y"), F.col("text_w").alias("w"), "text_bins").where("y IS NOT NULL")
    page = told.select(F.col("page_y").alias("y"), F.col("page_w").alias("w"), "page_bins", "lang", "source").where("y IS NOT NULL")
    return binned(text, "text_bins"), (*binned(page, "page_bins"), valued(page, "lang"), valued(page, "source"))


def scored(bins: str, prior: float, table: list[list[float]]) -> Column:
    odds = F.lit(prior)
    for f, row in enumerate(table):
        odds = odds + F.coalesce(F.get(F.array(*map(F.lit, row)), F.get(bins, F.lit(f))), F.lit(0.0))
    return F.round(odds, 6)


def with_odds(rows: DataFrame, models: tuple[tuple, tuple]) -> DataFrame:
    """rows with t and p, the log odds of good that the text and the page give."""
    text, (prior, table, langs, sources) = models
    both = rows.join(langs, "lang", "left").join(sources, "source", "left")
    page = scored("page_bins", prior, table) + F.coalesce("lang_odds", F.lit(0.0)) + F.coalesce("source_odds", F.lit(0.0))
    return both.withColumn("t", scored("text_bins", *text)).withColumn("p", F.round(page, 6)).drop("lang_odds", "source_odds")


def surest(scores: DataFrame, view: str, good: float) -> dict:
    """From which score on a view is sure of good, up to which of bad, and the weight of either label, from (label, held, t, p).

    Scores are counted in steps of a tenth, so the driver gets a bounded number of them.
    """
    counts = scores.select(F.round(F.col(view) * 10).cast("int").alias("s"), F.when(F.col("held"), F.col("label")).alias("y"), F.col("label").isNull().alias("open"))
    counts = counts.groupBy("s", "y", "open").agg(F.count("*").alias("n")).collect()
    steps = sorted({r["s"] for r in counts})
    free, told = ({s: 0 for s in steps} for _ in range(2))
    hit = dict(told)
    for r in counts:
        free[r["s"]] += r["n"] * r["open"]
        if r["y"] is not None:
            told[r["s"]] += r["n"]
            hit[r["s"]] += r["n"] * r["y"]

    def edge(order: list[int], share: float) -> int | None:
        left = SURE * share * sum(free.values())
        for s in order[:-1]:
            left -= free[s]
            if left <= 0:
                return s
        return None

    high, low = edge(steps[::-1], good), edge(steps, 1 - good)
    if high is None or low is None or low >= high:
        return {"high": None, "low": None, "weights": (0.0, 0.0)}

    def beats(y: int, inside: list[int]) -> float:
        n, k, chance = sum(told[s] for s in inside), sum(hit[s] for s in inside), good if y else 1 - good
        right = ((k if y else n - k) + chance) / (n + 1)
        return max(0.0, (right - chance) / (1 - chance)) if chance < 1 else 0.0

    weights = (beats(0, [s for s in steps if s <= low]), beats(1, [s for s in steps if s >= high]))
    return {"high": high, "low": low, "weights": weights}


def pseudo(view: str, sure: dict) -> tuple[Column, Column]:
    """The labels that a view gives to rows without one, and their weights."""
    if sure["high"] is None:
        return F.lit(None).cast("int"), F.lit(0.0)
    step, (bad, good) = F.round(F.col(view) * 10).cast("int"), sure["weights"]
    label = F.when(F.col("label").isNull(), F.when((step >= sure["high"]) & F.lit(good > 0), 1).when((step <= sure["low"]) & F.lit(bad > 0), 0))
    return label, F.when(label == 1, PSEUDO * good).otherwise(PSEUDO * bad)


def combined(held: DataFrame) -> tuple[float, float, float]:
    """Weights of the two views' log odds and a constant: logistic regression on held-out labels, by their counts over a grid of scores."""
    grid = lambda c: F.least(F.lit(40), F.greatest(F.lit(-40), F.round(F.col(c) * 2))).cast("int").alias(c)
    counts = held.select(grid("t"), grid("p"), "label").groupBy("t", "p", "label").agg(F.count("*").alias("n")).orderBy("t", "p", "label").collect()
    x = np.array([[r["t"] / 2, r["p"] / 2, 1] for r in counts]).reshape(-1, 3)
    y, n = np.array([r["label"] for r in counts], float), np.array([r["n"] for r in counts], float)
    beta = np.array([0.5, 0.5, 0.0])
    if not 0 < (y * n).sum() < n.sum():
        return tuple(beta)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 0.5 * (beta - [0.5, 0.5, 0])
        hessian = (x.T * (n * p * (1 - p))) @ x + 0.5 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def learn(rows: DataFrame, rounds: int = ROUNDS, report: list | None = None) -> tuple[tuple, DataFrame]:
    """The two views' models with the weights that combine them, and the rows with both scores; report gets the numbers of labels that each round exchanges."""
    held = F.pmod(F.xxhash64("id"), F.lit(HELD)) == 0
    known = F.when(F.col("label").isNotNull() & ~held, F.col("label"))
    share = rows.select(known.alias("y")).agg(F.avg("y"), F.count("y")).first()
    models = fitted(rows.select("*", *(x.alias(n) for n, x in (("text_y", known), ("page_y", known), ("text_w", F.lit(1.0)), ("page_w", F.lit(1.0))))))
    scores = durable(with_odds(rows, models))
    for _ in range(rounds if share[1] and 0 < share[0] < 1 else 0):
        told = {v: surest(scores.withColumn("held", held), v, share[0]) for v in "tp"}
        (by_text, text_sure), (by_page, page_sure) = (pseudo(v, told[v]) for v in "tp")
        if report is not None:
            report.append({f"{v}_{y}": n for v, x in (("text", by_text), ("page", by_page)) for y, n in zip(("bad", "good"), scores.agg(F.count_if(x == 0), F.count_if(x == 1)).first(), strict=True)})
        weight = lambda w: F.when(known.isNotNull(), 1.0).otherwise(w)
        models = fitted(scores.select("*", F.coalesce(known, by_page).alias("text_y"), weight(page_sure).alias("text_w"), F.coalesce(known, by_text).alias("page_y"), weight(text_sure).alias("page_w")))
        scores = durable(with_odds(rows, models), over=scores)
    return (models, combined(scores.where(F.col("label").isNotNull() & held))), scores


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", size_col: str = "n_chars", least: float = 0.5, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """One row for each row of df: id, text_odds, page_odds (log odds of good), quality (probability) and kept.

    Each view is a naive Bayes classifier: of the text by binned features of its content, of the page by
    its metadata alone: language and source by their exact values, the given size, and how many pages of
    what mean size the source has. Both start from the labelled rows; in each round, each view labels the
    rows without a label of which it is surest for the other view. The held-out labelled rows weigh such
    labels, and calibrate and combine the two views in the end. A row is kept if its quality is at least `least`.
    Several labels of one id count as the worst of them; labels other than 0 and 1 don't count. Null texts
    count as empty, null languages and sources as values of their own, a missing size as 0. Without labels of
    both kinds all odds are 0 and all rows kept. Repeated rows stay; an empty table gives an empty result.
    Other columns aren't carried.
    """
    out = judged(df, labels, id_col, text_col, lang_col, source_col, label_col, size_col, least, rounds, report)
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_odds"), F.col("p").alias("page_odds"), "quality", "kept")


def judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, label_col: str, size_col: str, least: float, rounds: int, report: list | None = None) -> DataFrame:
    rows = viewed(df, labels, id_col, text_col, lang_col, source_col, label_col, size_col)
    (_, (a, b, c)), scores = learn(rows, rounds, report)
    quality = F.round(1 / (1 + F.exp(-(F.col("t") * a + F.col("p") * b + c))), 6)
    return scores.select("id", "key", "t", "p", quality.alias("quality")).withColumn("kept", F.col("quality") >= least)


def viewed(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, label_col: str, size_col: str) -> DataFrame:
    """(id, key, label, text_bins, page_bins, lang, source): narrow rows, made in one pass over the texts; key is a hash of the text."""
    text, given = text_or_empty(text_col), F.col(size_col).cast("double") if size_col in df.columns else F.lit(0.0)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    seen = durable(df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text_view(text).alias("text_bins"), name(lang_col).alias("lang"), name(source_col).alias("source"), F.greatest(F.lit(0.0), F.coalesce(given, F.lit(0.0))).alias("chars")))
    site = seen.groupBy("source").agg(F.count("*").alias("pages"), F.avg("chars").alias("mean"))
    gold = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    page = F.array(size(F.col("chars")), size(F.col("pages")), size(F.col("mean")))
    both = seen.join(site, "source").withColumn("page_bins", page).join(gold, "id", "left")
    return durable(both.select("id", "key", "label", "text_bins", "page_bins", "lang", "source"), over=seen)


def good_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", size_col: str = "n_chars", least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """The rows of df that classify() keeps, with all their columns: the texts are scored once and dealt out by id once, at every size."""
    good = judged(df, labels, id_col, text_col, lang_col, source_col, label_col, size_col, least, rounds).where("kept")
    good = durable(good.select(F.col("id").alias("_good_id"), F.col("key").alias("_good_key")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_good_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_good_key"))
    return df.join(good.hint("merge"), same, "left_semi")
