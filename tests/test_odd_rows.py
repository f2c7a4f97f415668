"""Queries beside their SQL on rows that the smallest tables lack."""

import os

import duckdb
from oracle import TABLES, same

from stockloom.plans import registry

SF = "/root/testdata"


def tables(folder, **own):
    """A folder of the smallest tables, some of them replaced by a query."""
    for t in TABLES:
        if t in own:
            duckdb.sql(f"COPY ({own[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/sf0.001/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


def agrees(spark, name, folder):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], folder)


def test_labels_without_an_amount(spark, tmp_path):
    events = f"SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value) FROM '{SF}/sf0.001/events.parquet'"
    agrees(spark, "bc_label_normalise", tables(tmp_path, events=events))


def test_lines_that_a_tolerance_just_reaches(spark, tmp_path):
    lines = f"SELECT * FROM '{SF}/sf0.1/lineitem.parquet' WHERE l_orderkey // 8 IN (1797, 4945, 12485, 15930)"
    agrees(spark, "doc_line_grouping", tables(tmp_path, lineitem=lines))


def test_prices_at_half_a_cent(spark, tmp_path):
    part = f"SELECT * REPLACE (903.0 AS p_retailprice, 2 AS p_size) FROM '{SF}/sf0.001/part.parquet'"
    agrees(spark, "pst_manual_sale", tables(tmp_path, part=part))


def test_targets_at_half_a_gram(spark):
    agrees(spark, "an_fresh_stock", f"{SF}/sf0.01")


def test_aliases_among_many_similar_names(spark):
    agrees(spark, "er_match_alias", f"{SF}/sf0.01")
