"""From raw documents to packed sequences: classify, deduplicate, sanitise, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import mixing, near_dedup, packing, pii, quality_classifier
from stockloom.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps."""
    return quality_classifier.good_rows(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of the least id. The texts are dealt out by id once, at every size."""
    gone = durable(near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(COLUMNS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it masked; n_chars follows the text."""
    clean = pii.sanitise(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Equal rows share their copies evenly, rounded."""
    key = F.struct("doc_id", F.xxhash64("text", "lang", "source", "n_chars"))
    named = docs.select(COLUMNS).withColumn("key", key)
    copies = mixing.mix(named, id_col="key").groupBy(F.col("key").alias("k")).agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies > 0")
    taken = named.join(durable(copies).hint("merge"), F.col("key") == F.col("k"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("near-dedup", deduplicate),
    ("personal data", sanitise),
    ("source mixing", mix),
    ("packing", pack),
]

#: No SQL: tokenisation, sketches and the classifier are beyond it; tests/llm compares small runs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to all that the one before kept."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = last = durable(docs, over=last)
    return docs
