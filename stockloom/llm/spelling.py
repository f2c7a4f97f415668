"""Spelling variants: words at one edit's distance by a bit-sliced index of positions and letters (operator 11)."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

#: Words of several small buckets, or queries, that one run of the recurrences takes at least and at most.
BLOCK = 512
#: Larger buckets are cut into slices of about so many words, each in a task's own memory; every word of the bucket visits them all.
SLICE = 4096
#: Characters of one run's words together.
ROOM = 1 << 20
FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, string.ascii_uppercase, string.ascii_lowercase)).otherwise(run)


def noised(run: Column, key: Column, every: int) -> Column:
    """run without one code point if the crc32 of `<key>:<run>` is a multiple of `every`: the one at that number modulo the length."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(df: DataFrame, id_col: str, text_col: str, letters: str, every: int, size: int, least: int) -> DataFrame:
    """(word, n): the words of all texts with at least `size` code points and `least` occurrences. Runs too short for that aren't even extracted."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"{letters}{{{size},}}+"), F.lit(0))).alias("run"))
    words = runs.select("key", lowered(F.col("run")).alias("run")).select(noised(F.col("run"), F.col("key"), every).alias("word"))
    return words.where(F.length("word") >= size).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keyed(words: DataFrame, size: int) -> DataFrame:
    """(key, word, n): each word in its buckets.

    Two words at one edit's distance agree, from the front and from the back together, in all letters of the shorter
    one but at most one; so they share a front half or a back half. A pair's class is the sum of both lengths, and class c's halves
    have (c + 1) / 4 letters, rounded down. A word is in the buckets of its two halves for each of its three
    classes, but for those in which the other word would be too short.
    """
    word, n = F.col("word"), F.length("word")
    kinds = F.filter(F.array(2 * n - 1, 2 * n, 2 * n + 1), lambda c: c >= 2 * size)
    half = lambda c: F.floor((c + 1) / 4).cast("int")
    keys = F.flatten(F.transform(kinds, lambda c: F.array(F.concat(c.cast("string"), F.lit("<"), F.left(word, half(c))), F.concat(c.cast("string"), F.lit(">"), F.right(word, half(c))))))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def sliced(buckets: DataFrame, most: int) -> DataFrame:
    """(key, slice, held, word, n): buckets of more than `most` words as slices. A word is held in one slice and asked for in all of them.

    Buckets are counted by a hash of their key, so a few get slices that don't need them. The hot ones are at most
    one in `most` of all rows.
    """
    hot = durable(buckets.groupBy(F.xxhash64("key").alias("h")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("h", F.ceil(F.col("c") / most).cast("int").alias("slices")))
    told = buckets.withColumn("h", F.xxhash64("key")).join(hot, "h", "left")
    slices = F.coalesce("slices", F.lit(1))
    every = told.select("key", "word", "n", F.pmod(F.xxhash64("word"), slices).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    return every.select("key", "slice", (F.col("own") == F.col("slice")).alias("held"), "word", "n")


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one word a row and padded with 0, and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), size.max() + 1), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, size


class PositionIndex:
    """For each (position, letter) the set of the words that have this letter there, as bits over the words."""

    def __init__(self, words: list[str], bucket: np.ndarray):
        points, self.size = codes(words)
        self.letters = np.unique(points)  # 0, the padding, is the first
        self.places = points.shape[1]
        wide = -(-len(words) // 64) * 64
        bits = lambda m: np.packbits(np.pad(m, [(0, 0)] * (m.ndim - 1) + [(0, wide - len(words))]), axis=-1, bitorder="little").view("<u8")
        self.has = np.zeros((self.places + 1, len(self.letters) + 1, wide // 64), np.uint64)  # a letter of no word comes last, and no word reaches the last place
        for i in range(self.places):
            self.has[i, 1:-1] = bits(points[:, i] == self.letters[1:, None])
        self.long = bits(self.size == np.arange(self.places + 1)[:, None])
        self.same = bits(bucket == np.arange(bucket.max() + 1)[:, None])

    def near(self, words: list[str], bucket: np.ndarray, half: int, equal: bool, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): the indexed words of a query's bucket at exactly one edit's distance from it.

        After i letters of all queries: `none` are the words without an error so far, `swapped` those with one letter replaced, `longer` and `shorter` those
        that read on one place ahead or behind because they have, or lack, one letter. equal: only words of equal length
        count, else only others. back: pairs that agree in the first `half` letters belong to a bucket of front halves.
        """
        points, size = codes(words)
        at = np.searchsorted(self.letters, points)
        at = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == points, at, len(self.letters))
        has, last = self.has, self.places
        none = self.same[bucket]
        swapped, longer, shorter, front = np.zeros_like(none), none.copy(), np.zeros_like(none), none
        found = np.zeros_like(none)
        long = lambda n: self.long[np.minimum(n, last)] * (n <= last)[:, None].astype(np.uint64)
        for i in range(points.shape[1] - 1):
            letter = at[:, i]
            here = has[min(i, last), letter]
            if equal:
                swapped = swapped & here | none & ~here
                none = none & here
            else:
                shorter = (shorter & has[min(i - 1, last), letter] if i else shorter) | none
                none = none & here
                longer = longer & has[min(i + 1, last), letter] | none
            if i + 1 == half:
                front = none
            if (done := size == i + 1).any():
                ends = swapped & long(size) if equal else longer & long(size + 1) | shorter & long(size - 1)
                found[done] = ends[done]
        if back:
            found &= ~front
        rows = np.flatnonzero(found.any(axis=1))
        q, w = np.nonzero(np.unpackbits(found[rows].view(np.uint8), axis=1, bitorder="little"))
        return rows[q], w


def parts(key: str) -> tuple[int, bool]:
    """A bucket's class, and whether its words share a back half."""
    cut = min(i for i in (key.find("<"), key.find(">")) if i > 0)
    return int(key[:cut]), key[cut] == ">"


def links(kind: tuple[int, bool], held: list[tuple[str, int, int]], asked: list[tuple[str, int]]) -> Iterator[tuple]:
    """(word, near, best_n, best) of the asked (word, bucket) among the held (word, n, bucket); the best near word has the largest n, then comes first."""
    total, back = kind
    index = PositionIndex([w for w, _, _ in held], np.array([b for *_, b in held]))
    best_first = sorted(range(len(held)), key=lambda k: (-held[k][1], held[k][0]))
    place = np.empty(len(held), np.int64)
    place[best_first] = np.arange(len(held))
    for x in range(0, len(asked), BLOCK):
        part = asked[x : x + BLOCK]
        q, w = index.near([a for a, _ in part], np.array([b for _, b in part]), (total + 1) // 4, total % 2 == 0, back)
        if len(q):
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            best, count = np.minimum.reduceat(place[w], starts), np.diff(np.append(starts, len(q)))
            for k, b, c in zip(q[starts].tolist(), best.tolist(), count.tolist(), strict=True):
                yield part[k][0], c, held[best_first[b]][1], held[best_first[b]][0]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bool], list, list]]:
    """(kind, held, asked) of rows sorted by bucket and slice, held ones first: several small buckets of a kind together, a long one's further queries in turns."""
    last, kind, bucket, held, asked, room = None, None, -1, [], [], 0

    for b in batches:
        for key, slice_, own, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, slice_) != last:
                new = parts(key)
                if new != kind or len(held) >= BLOCK or room >= ROOM:
                    if len(held) > 0 and len(asked) > 0:
                        yield kind, held, asked
                    bucket, held, asked, room = -1, [], [], 0
                last, kind, bucket = (key, slice_), new, bucket + 1
            if own:
                held.append((word, n, bucket))
                room += len(word)
            asked.append((word, bucket))
            if len(asked) >= 4 * SLICE and not own:  # a hot bucket's further queries, after all that it holds
                if held:
                    yield kind, held, asked
                asked = []
    if held and asked:
        yield kind, held, asked


def near_words(words: DataFrame, size: int) -> DataFrame:
    """(word, near, best_n, best) of each word of words (word, n) that has near ones: their number, and the one of largest n, then first in code-point order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for kind, held, asked in groups(batches):
            if len(held) + len(asked) > 2:
                out += links(kind, held, asked)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    rows = sliced(keyed(words, size), SLICE).repartition("key", "slice").sortWithinPartitions("key", "slice", F.desc("held"))
    found = rows.mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.order")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the end of each word's chain, by doubling. Along a chain n grows tenfold, so five rounds do for any corpus."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if not at.join(further, "root", "left_semi").limit(1).count():
            return at
        at = durable(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), over=at)


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = r"[A-Za-zÀ-ÿ]", every: int = 31, size: int = 7, least: int = 2, times: int = 10
) -> DataFrame:
    """One row for each word of the texts: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters, A-Z in lower case; where `every` divides the crc32 of `<id>:<run>`, one letter is
    deleted. Words of fewer than `size` code points or `least` occurrences don't count. Near words differ by one inserted,
    deleted or replaced code point; a word's form is the near word of largest n (ties: first in code-point order) if that is at least `times` its
    own n; root follows the forms to their end. Null texts have no words; null ids count as empty texts in the crc32;
    repeated rows count again; an empty table gives an empty result. Other columns aren't carried.

    Scale: counting combines before its shuffle. A word is then in six buckets at most, whose words share half their letters; all
    pairs within one are compared 64 at a time, and only sums and the best word leave the task.
    """
    words = durable(vocabulary(df, id_col, text_col, letters, every, size, least))
    near = near_words(words, size)
    formed = F.col("best_n") >= times * F.col("n")
    known = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), over=words)
    end = roots(known.where("form IS NOT NULL"))
    return known.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.col("n_near").cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
