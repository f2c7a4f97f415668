"""Very long texts, ties, nulls, repeated rows, empty tables and clashing columns through all operators and pipeline stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockloom.llm import chat, licenses, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, spotsigs, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean, id string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(9)
    words = ["the", "of", "house", "river", "and", "mit", "license", "a@b.org", "10.1.2.3", "green", "x" * 30]
    long = " ".join(rnd.choice(words) for _ in range(300_000))  # about 2 MB
    lines = "\n".join(["same line of words here"] * 60_000)
    rows = [(1, long), (2, long), (3, lines), (4, None), (5, ""), (6, "the river"), (6, "the river"), (None, "the river"), (7, "x" * 1_000_000), (8, "  \n\t ")]
    full = [(i, t, [None, "en", "xx"][k % 3], [None, "s"][k % 2], None if k % 4 == 0 else len(t or ""), 5, True, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(4)


def labels(spark, rows=((1, 1), (3, 0), (4, 0), (6, 1), (6, 0), (None, 1), (5, None), (7, 3))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


OPERATORS = {
    "classify": lambda s, d: quality_classifier.classify(d, labels(s)),
    "pack": lambda s, d: packing.pack(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "pii": lambda s, d: pii.personal_data(d),
    "rules": lambda s, d: quality_rules.rules(d),
    "spots": lambda s, d: spotsigs.edited_fingerprints(d),
    "licences": lambda s, d: licenses.scan(d),
    "tokens": lambda s, d: tokens.token_counts(d),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    ids = [r.doc_id for r in got]
    assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert name == "pack" or len(ids) == 10
    assert OPERATORS[name](spark, odd.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["pack", "near", "pii", "rules", "spots", "tokens"])
def test_equal_texts_have_equal_rows(spark, odd, name):
    if name == "spots":  # what follows a row isn't its own
        a, b = (r.fingerprint for r in OPERATORS[name](spark, odd).where("doc_id IN (1, 2)").collect())
        assert a == b
        return
    own = {"pack": ["piece", "start", "length", "ids_crc32"], "near": ["n_shingles", "component_id"], "pii": ["n_email", "n_ip", "base_sha256", "spans"], "rules": ["n_words", "n_repeat_words", "base_failed"], "tokens": ["n_bytes", "n_tokens"]}[name]
    got = OPERATORS[name](spark, odd).where("doc_id IN (1, 2)").select("doc_id", *own).collect()
    of = lambda i: sorted(tuple(r)[1:] for r in got if r.doc_id == i)
    assert of(1) == of(2) and of(1)


def test_odd_conversations(spark):
    rows = [(1, 1, "user", "x" * 2_000_000), (1, 1, "user", "x"), (1, None, None, None), (None, 2, "assistant", ""), (2, 1, "assistant", "a"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 3, "q") for r in rows], "conv_id long, turn long, role string, text string, level int, formatted string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got == {1: (3, 0), None: (1, 0), 2: (2, 2)}


def test_ties_between_labels_and_licences(spark):
    d = spark.createDataFrame([(i, "same text here", "en", f"s{i % 2}", 14) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = quality_classifier.classify(d, labels(spark, [(i, i // 2 % 2) for i in range(20)])).select("text_odds").distinct().count()
    assert got == 1
    files = spark.createDataFrame([(1, "Licensed under CC BY 4.0.", "d/LICENSE"), (2, "Released under the MIT License.", "d/COPYING"), (3, "code", "d/a.c"), (4, "code", "d/b.c")], "doc_id long, text string, p string")
    found = {r.doc_id: r.license for r in licenses.scan(files, path=F.col("p")).collect()}
    assert found[3] == found[4] and found[3] in (found[1], found[2])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, stage, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = odd.where("doc_id IS NULL OR doc_id <> 1")
    got = run(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert set(ids) <= {2, 3, 4, 5, 6, 7, 8, None}
    if stage == "near-dedup":
        assert ids.count(6) == 2 and None in ids
    if stage == "personal data":
        texts = [r.text for r in got.collect()]
        assert len(texts) == 9 and not any("a@b.org" in (t or "") for t in texts)
    assert run(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0
