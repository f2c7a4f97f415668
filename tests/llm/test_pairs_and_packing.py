"""Near-duplicates, packing, token counts and mixing against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from oracle import same
from pyspark.sql import functions as F
from stockloom.llm import mixing, near_dedup, oracles, packing, tokens

DOCS = "doc_id long, text string, source string, lang string, n_tokens int, keys string"


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "en", 7, "x") for r in rows], DOCS)


def near(rows, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rnd, words = random.Random(5), [f"w{i}" for i in range(3000)]
    rows = []
    for copies, n in ((70, 60), (25, 150), (3, 12)):
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, 1 + n // 40)):
                text[rnd.randrange(n)] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    passage = [rnd.choice(words) for _ in range(80)]
    rows += [(len(rows) + i, " ".join([rnd.choice(words) for _ in range(rnd.choice([15, 40]))] + passage)) for i in range(60)]
    rows += [(len(rows) + i, t) for i, t in enumerate(("", None, "a b", "A  B", "a", "x" * 5000))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == near(rows)


def test_near_duplicates_edge_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (2, "a b c", None)]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.doc_id} == {1} and all(r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    common, a, b = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = near_dedup.sketch(np.r_[common, a]), near_dedup.sketch(np.r_[common, b])
    assert near_dedup.EMPTY not in x and abs((x == y).mean() - 0.75) < 0.15
    assert near_dedup.EMPTY not in near_dedup.sketch(common[:1])


def test_near_dedup_sql(spark):
    from stockloom.llm.registry import op3_near_dedup

    same(spark, op3_near_dedup, oracles.NEAR_DUPLICATES, "/root/testdata/sf0.001")


def one_by_one(lengths, capacity):
    """Best-fit decreasing as it is defined, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_piecewise_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 40), rnd.randint(1, 9), 17]) for _ in range(400)]
    runs, n = packing.best_fit_decreasing(Counter(lengths), 40)
    room, todo = [40] * n, Counter(lengths)
    for i, (length, rank, start, each, offset) in enumerate(runs):
        end = min([r[1] for r in runs[i + 1 :] if r[0] == length], default=todo[length])
        for k in range(end - rank):
            assert 40 - room[start + k // each] == offset + k % each * length
            room[start + k // each] -= length
    assert sorted(room) == one_by_one(lengths, 40)


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["tea", "house", "unbelievable", "\n\n"]) for _ in range(rnd.choice([3, 50, 700]))), "s") for i in range(60)]
    rows += [(90, None, "s"), (91, "", "s"), (91, "", "s"), (None, "x  y", "s")]
    path = tokens.default_path()
    got = packing.pack(docs(spark, rows), capacity=256).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text, _ in rows[:60] + [rows[-1]]:
        ids = np.append(tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1]) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 256 for p in parts[1:]) and [p.ids_crc32 for p in parts] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts]
    assert sum(r.length for r in by_doc[90] + by_doc[91]) == 3
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert [o for o, _ in v] == list(np.cumsum([0] + [n for _, n in v])[:-1]) and sum(n for _, n in v) <= 256
    assert len(bins) == len(one_by_one([r.length for r in got], 256))
    assert packing.pack(docs(spark, [])).count() == 0


def test_token_counts(spark):
    rnd = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "'s", "1", "é", "<|endoftext|>", ".", "\x85", "　", "word", "!!", "\x1c", "😀", "日本", "a" * 500]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))), "s") for i in range(500)] + [(-1, None, "s"), (None, "q", None)]
    path = tokens.default_path()
    want = {i: tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    for r in tokens.token_counts(docs(spark, rows), limit=10).collect():
        assert (r.n_tokens, r.over_limit) == (len(want[r.doc_id]), len(want[r.doc_id]) > 10)
    assert all(list(tokens.encode(t or "", path)) == want[i] for i, t, _ in rows)
    assert tokens.token_counts(docs(spark, [])).count() == 0


def test_whole_tokens_are_single():
    whole = tokens.whole_tokens(tokens.default_path())
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


def water(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return goal | {s: left * weight[s] / total for s in free}
        for s in over:
            goal[s] = cap * sizes[s]
        left, free = left - sum(goal[s] for s in over), free - over


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * 1 for _ in range(int(rnd.paretovariate(1.1) * 5) % 3000 + 1)), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "b")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    goal = water(sizes)
    for r in got:
        assert r.target == pytest.approx(goal[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in goal:
        assert taken[s] == pytest.approx(goal[s], rel=0.01)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    odd = mixing.mix(docs(spark, [(1, None, None), (1, None, None), (None, "a b", None)])).collect()
    assert len(odd) == 3


def test_mix_of_many_sizes(spark):
    got = mixing.mix(docs(spark, [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(60)])).collect()
    for s in (0, 1):
        part = [r for r in got if r.doc_id % 2 == s]
        assert sum(r.taken for r in part) == pytest.approx(part[0].target, abs=2)


def test_rates_are_the_entropy_optimum(spark):
    """The dual's rates meet each target, and no small change that still meets it has less relative entropy to one copy within 0 and cap."""
    rnd, cap = random.Random(12), 2.0
    sizes = {sid: {rnd.randint(1, 400): rnd.randint(1, 30) for _ in range(25)} for sid in (1, 2, 3)}
    words = {sid: sum(s * n for s, n in h.items()) for sid, h in sizes.items()}
    target = {sid: words[sid] * part for sid, part in ((1, 0.4), (2, 1.3), (3, 1.9))}
    mean = {sid: words[sid] / sum(h.values()) for sid, h in sizes.items()}
    hist = spark.createDataFrame([(sid, s, n) for sid, h in sizes.items() for s, n in h.items()], "sid int, size long, n long")
    goal = spark.createDataFrame([(sid, float(target[sid]), float(mean[sid])) for sid in sizes], "sid int, target double, mean double")
    found = mixing.balance(hist, goal, cap)
    rate = mixing.tilted(F.col("theta"), F.col("size"), F.col("mean"), cap)
    got = {(r.sid, r.size): (r.n, r.rate) for r in hist.join(goal, "sid").join(found, "sid").select("sid", "size", "n", rate.alias("rate")).collect()}

    def entropy(n, r):
        return n * (r * math.log(r) + (cap - r) * math.log((cap - r) / (cap - 1)))

    for sid, h in sizes.items():
        assert sum(n * r * s for (i, s), (n, r) in got.items() if i == sid) == pytest.approx(target[sid], rel=2e-5)
        for _ in range(200):
            a, b = rnd.sample(sorted(h), 2)
            (na, ra), (nb, rb) = got[sid, a], got[sid, b]
            step = rnd.choice([-1, 1]) * 1e-3
            other = -step * na * a / (nb * b)
            if 0 < ra + step < cap and 0 < rb + other < cap:
                assert entropy(na, ra + step) + entropy(nb, rb + other) >= entropy(na, ra) + entropy(nb, rb) - 1e-6


def test_equal_documents_share_the_copies_evenly(spark):
    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(5000 + i, "w " * 7, "b") for i in range(300)]
    got = mixing.mix(docs(spark, rows)).collect()
    for source in ("a", "b"):
        mine = [r for r in got if (r.doc_id >= 5000) == (source == "b")]
        copies = [r.copies for r in mine]
        assert max(copies) - min(copies) <= 1 and sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=10)
