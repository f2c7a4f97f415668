"""The trie of conversation prefixes beside a brute-force version, over few and many shards."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stockloom.llm import prefix_trie, registry
from stockloom.llm.common import table

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    member, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            member[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for p in member:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(member, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        own_saving = (len(member[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own_saving + sum(saved[k] for k in kids[p])
    return sorted(
        (min(m), len(p), min(member[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in member.items()
    )


def found(df):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n long").repartition(3)


def made(rnd, n, few):
    """Conversations of few different turns: deep shared prefixes, copies, some of them long."""
    rows = []
    for c in rnd.sample(range(n * 2), n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8]) if rnd.random() > 0.01 else 60):
            rows.append((c, t if rnd.random() > 0.05 else None, rnd.choice(["user", "assistant"]) if few > 2 else "user", rnd.choice([f"w {k} " * (k % 3) for k in range(few)] + ["", None])))
    return rows


@pytest.mark.parametrize(("n", "few", "parts"), [(40, 2, 1), (200, 2, 30), (300, 6, 7), (300, 40, 30), (3, 1, 5)])
def test_nodes_equal_brute_force(spark, n, few, parts):
    rows = made(random.Random(n + few), n, few)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 2, "user", "x" * 1_000_000), (1, 2, "user", "y"), (1, 2, "user", "y"), (7, 1, "a", "bc"), (8, 1, "ab", "c"), (20, 1, "u", "one"), (-3, 1, "u", "two"), (21, 1, "u", "one"), (23, 1, "u", "one")]
    got = found(prefix_trie.prefix_trie(frame(spark, rows)))
    assert [r for r in got if r[1] == 0][0][3] == 7
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(prefix_trie.prefix_trie(frame(spark, positive))) == brute(positive)
    assert prefix_trie.prefix_trie(frame(spark, rows).where("conv_id < -9")).count() == 0


def test_copies_are_one_row_before_the_tree(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(3)]
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)
    kept = prefix_trie.rebuilt(frame(spark, rows))
    assert kept.select("key").distinct().count() == 1 and prefix_trie.endings(kept).select("n").first()[0] == 200


def test_medians_and_tree():
    assert sorted(prefix_trie.medians(13)) == list(range(13)) and next(prefix_trie.medians(13)) == 6
    tree, n = prefix_trie.TernaryTree(), 1000
    for k in prefix_trie.medians(n):
        tree.insert([k], k)

    def height(x):
        return 0 if not x else 1 + max(height(tree.low[x]), height(tree.high[x]))

    assert height(tree.equal[0]) == 10 and tree.find([17])[-1] and len(tree.walk()) == n + 1


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = registry.queries()["op13_prefix_trie"](spark, SF)
    assert dict(got.dtypes) == {n: "string" if n == "ends_sha256" else "bigint" for n in NAMES}
    assert found(got) == brute(rows)
    assert got.where(F.col("depth") == 0).count() == 1
