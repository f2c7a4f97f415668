"""Spelling variants beside a brute-force version that compares all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockloom.llm import registry, spelling
from stockloom.llm.common import table

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS} | {a + c + b for a, b in cuts for c in LETTERS}


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute(n):
    form, near = {}, {}
    for w in n:
        found = [x for x in edits(w) if x in n and x != w]
        near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], near[w], n[form[w]] if w in form else None))
    return out


def found(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mutated(rnd, w, letters):
    i = rnd.randrange(len(w))
    return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]])


def corpus(seed, letters="abÿ", n=400):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12))) for _ in range(12)]
    words = base * 30 + [mutated(rnd, rnd.choice(base), letters) for _ in range(n)]
    words += [mutated(rnd, mutated(rnd, rnd.choice(base), letters), letters) for _ in range(n)]
    words = [w.title() if rnd.random() < 0.2 else w for w in words * 2]
    rnd.shuffle(words)
    return [(k, " ".join(words[k::40]) + "×÷ 12 " + "Ü" * 9) for k in range(40)]


@pytest.mark.parametrize("limits", [{}, {"SLICE": 5}, {"SLICE": 3, "BLOCK": 2}, {"BLOCK": 100000}])
def test_words_equal_brute_force(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(spelling, name, v)
    rows = corpus(len(limits))
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    want = brute(counted(rows))
    assert any(f for _, f, *_ in want) and any(c for *_, c, _ in want)
    assert found(spelling.spelling_variants(df)) == want


@pytest.mark.parametrize("back", [False, True])
def test_recurrences(back):
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(300)})
    bucket = np.zeros(len(words), np.int64)
    index = spelling.PositionIndex(words, bucket)
    for equal in (True, False):
        half = 3
        q, w = index.near(words, bucket, half, equal, back)
        want = {(a, b) for a in words for b in edits(a) & set(words) if a != b and (len(a) == len(b)) == equal and not (back and a[:half] == b[:half])}
        assert {(words[i], words[j]) for i, j in zip(q, w, strict=True)} == want and len(q) == len(want)
    q, w = index.near(["zzzzzzz", "a" * 40], np.zeros(2, np.int64), 3, True, back)
    assert len(q) == 0


def test_chains_and_ties(spark):
    words = ["abcdefg"] * 2000 + ["abcdefgh"] * 200 + ["abcdefghi"] * 20 + ["abcdefghij"] * 2 + ["qqqqqqqb"] * 50 + ["qqqqqqqa"] * 50 + ["qqqqqqq"] * 3
    rows = [(k, w) for k, w in enumerate(words)]
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40).collect()}
    assert got["abcdefghij"].root == got["abcdefghi"].root == "abcdefg" and got["abcdefghij"].form == "abcdefghi"
    assert got["qqqqqqq"].form == "qqqqqqqa" and got["qqqqqqq"].n_near == 2 and got["qqqqqqqa"].form is None


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "wordword wordword wordwird"), (None, "wordword wordword wordwird"), (3, "x" * 300_000), (3, "x" * 300_000), (4, "y" * 299_999 + " " + "x" * 299_999), (5, "short ones ×")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, root string")
    got = found(spelling.spelling_variants(df))
    assert got == brute_long(counted(rows))
    assert spelling.spelling_variants(df.where("doc_id < 0")).count() == 0


def brute_long(n):
    assert all(len(w) < 20 or n[w] == 2 for w in n)
    short = {w: c for w, c in n.items() if len(w) < 20}
    return brute(short) | {(w, None, w, c, 0, None) for w, c in n.items() if w not in short}


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = registry.queries()["op11_spelling_variants"](spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert found(got) == brute(counted(rows))
