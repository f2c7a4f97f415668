"""Near-duplicate classes by fast similarity sketching, banding and exact verification (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Coordinates of a sketch, in BANDS bands of ROWS. A pair of similarity s meets in some band but for (1 - s^4)^32: 5e-6 at 0.75.
ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
SALTS = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; of the whole word sequence if it is shorter."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, np.uint64(width) * STEP)
        for i in range(width):
            total = (total + words[i : len(words) - width + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mix(total))


def sketch(items: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes.

    In each of the first size rounds, every item goes to one bin at random; in the next size rounds, to
    the bin of the round's number. A bin keeps the least value, and values of later rounds are larger. The
    rounds end once every bin is filled, which the second half guarantees. Two sets agree in a bin with
    the probability of their Jaccard similarity, and the share of bins that agree is concentrated.
    """
    bins = np.full(size, EMPTY)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            x = mix(items + np.uint64(i + 1) * STEP)
            at = (x >> np.uint64(40)) % np.uint64(size) if i < size else np.full(len(x), i - size, np.uint64)
            value = (np.uint64(i) << np.uint64(40)) | (mix(x) >> np.uint64(24))
            np.minimum.at(bins, at.astype(np.int64), value)
            if EMPTY not in bins:
                break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP
        for row in bins.reshape(BANDS, ROWS).T:
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + row)
    return keys


def sketches(df: DataFrame, width: int) -> DataFrame:
    """id, n_shingles, digest of the set, and the band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys = [], [], []
            for text in b.column(1).to_pylist():
                items = shingles(text or "", width)
                n.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys.append(band_keys(sketch(items)).view(np.int64) if len(items) else np.zeros(0, np.int64))
            edges = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["id", "n_shingles", "digest", "keys"])

    return df.mapInArrow(run, "id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(df: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(text or "", width).view(np.int64) for text in b.column(1).to_pylist()]
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], names=["id", "items"])

    return df.mapInArrow(run, "id long, items array<long>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) for each node: comp is the least id that links (a, b) reach.

    Each round hooks a component to the least component it is linked with and then shortens the chains;
    links inside a component drop out. The number of rounds is logarithmic in the length of the chains.
    """
    label = nodes.select("id", F.col("id").alias("comp"))
    before, kept = None, None
    while True:
        ends = links.join(label.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
        links = before = durable(ends.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), over=before)
        if links.isEmpty():
            return label
        hooks = links.groupBy("a").agg(F.min("b").alias("b"))
        up = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
        for _ in range(2):
            hooks = hooks.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        label = kept = durable(label.join(hooks.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("b", "comp").alias("comp")), over=kept)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes i and u of the intersection and union of their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return both.select("a", "b", common.alias("i"), (F.size("s") + F.size("t") - common).alias("u"))


def linked(percent: int) -> Column:
    return F.col("i") * 100 >= F.col("u") * percent


def of_family(rows: DataFrame, told: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what is told about their family. A family may hold a large part of all rows, so these are dealt out over SALTS parts."""
    parts = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("m", F.lit(SALTS)).cast("int")).join(parts, ["fam", "salt"], how).drop("salt")


def offered(rows: DataFrame, groups: list[str], size: Column, need: Column) -> DataFrame:
    """The prefixes of sets given as rows (m, item, df, ...): a set's rarest `size - need + 1` items, with their place and size.

    Two sets that have `need` items in common, and items ordered alike, share one of these.
    """
    order = Window.partitionBy("m").orderBy("df", "item")
    return rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size - need + 1).select(*groups, "item", "node", "comp", "at", size.alias("size"), "n", "e")


def family_pairs(apart: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sure links and candidate pairs (a, b) between components of one family, from (m, node, comp, fam, n, items), a row for each set.

    A family's centre holds the items of most of its members, and each member is told by its difference D
    from the centre. As |A xor B| = |D(A) xor D(B)|, a link means 2q |D(A) and D(B)| >= e(A) + e(B), where
    e = q |D| - r n, q = 100 + percent and r = 100 - percent. A pair with e(A) + e(B) <= 0 links for sure, and
    the family's member of the least e links with both. Any other pair has items of D in common, so it
    shares one of each one's rarest, of so many as the least e among the other components asks for.
    """
    q, r = 100 + percent, 100 - percent
    sizes = apart.groupBy("fam").agg(F.count("*").alias("members")).where("members > 1")
    rows = of_family(apart, sizes)
    centre = rows.select("fam", "members", F.explode("items").alias("item")).groupBy("fam", "item").agg(F.count("*").alias("df"), F.first("members").alias("members"))
    centre = centre.where("2 * df > members").groupBy("fam").agg(F.collect_list("item").alias("centre"))  # at most twice as many as a member has on average
    held = F.coalesce("centre", F.array().cast("array<bigint>"))
    told = of_family(rows, centre, "left").withColumn("d", F.concat(F.array_except("items", held), F.array_except(held, "items"))).withColumn("e", q * F.size("d") - r * F.col("n"))
    told = durable(told.select("m", "node", "comp", "fam", "n", "d", "e"))
    by_comp = told.groupBy("fam", "comp").agg(F.min(F.struct("e", "node")).alias("least"))
    first = by_comp.groupBy("fam").agg(F.min(F.struct("least", "comp")).alias("f"))
    both = by_comp.join(first, "fam")
    second = both.where("comp != f.comp").groupBy("fam").agg(F.min("least.e").alias("second"))
    ends = durable(first.join(second, "fam").select("fam", F.col("f.least.node").alias("a"), F.col("f.least.e").alias("low"), F.col("f.comp").alias("x"), "second"))
    rows = of_family(told, ends)
    sure = rows.where("comp != x AND e + low <= 0").select("a", F.col("node").alias("b"))

    rows = rows.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("e") + F.when(F.col("comp") == F.col("x"), F.col("second")).otherwise(F.col("low"))) / (2 * q))).cast("int"))
    item = rows.where(F.size("d") >= F.col("need")).select("fam", "m", "node", "comp", "n", "e", "need", F.explode("d").alias("item"))
    df = item.groupBy("fam", "item").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").drop("low", "high")
    item = item.join(df, ["fam", "item"]).withColumn("size", F.count("*").over(Window.partitionBy("m"))).where("size >= need")
    prefix = durable(offered(item, ["fam"], F.col("size"), F.col("need")))
    left, right = (prefix.select("fam", "item", *(F.col(c).alias(f"{side}{c}") for c in ("node", "comp", "at", "size", "e"))) for side in "ab")
    met = left.join(right, ["fam", "item"]).where("anode < bnode AND acomp != bcomp AND ae + be > 0")
    met = met.where(2 * q * (1 + F.least(F.col("asize") - F.col("aat"), F.col("bsize") - F.col("bat"))) >= F.col("ae") + F.col("be"))
    return sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), met.select(F.col("anode").alias("a"), F.col("bnode").alias("b"))


def foreign_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) between components of different families: sets that share one of each one's rarest items.

    Items within one family don't count. A link needs percent / 100 of either set, so of a set's items known to several
    families, all but so many are its prefix; most sets have too few of them for any link.
    """
    item = apart.select("m", "node", "comp", "fam", "n", F.explode("items").alias("item"))
    df = item.groupBy("item").agg(F.count("*").alias("df"), F.min("fam").alias("low"), F.max("fam").alias("high")).where("low != high").drop("low", "high")
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    item = item.join(df, "item").withColumn("size", F.count("*").over(Window.partitionBy("m"))).where(F.col("size") >= need).withColumn("e", F.lit(0))
    prefix = durable(offered(item, ["fam"], F.col("size"), need))
    fams = prefix.select("item", "fam").distinct()
    across = fams.select("item", F.col("fam").alias("afam")).join(fams.select("item", F.col("fam").alias("bfam")), "item").where("afam < bfam")
    left, right = (prefix.select("item", *(F.col(c).alias(f"{side}{c}") for c in ("fam", "node", "comp", "at", "size", "n"))) for side in "ab")
    met = across.join(left, ["item", "afam"]).join(right, ["item", "bfam"]).where("acomp != bcomp")
    most = 1 + F.least(F.col("asize") - F.col("aat"), F.col("bsize") - F.col("bat"))
    met = met.where(most * (100 + percent) >= (F.col("an") + F.col("bn")) * percent)
    return met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, kept.

    A component joins all rows that chains of links reach, a link being a Jaccard similarity of the
    shingle sets of at least percent / 100. Rows without words link with nothing. Null texts have no words. Rows with a null id stay, alone
    and kept. Rows that repeat an id are one document to the links. Other columns aren't carried.

    Equal sets are one node. A shingle that no other node of the buckets has can't be common to two, so
    a node of which such shingles are more than a quarter links with none and leaves the buckets: texts
    that only share passages do. The nodes of a band bucket are compared with the bucket's hub first, the
    node that meets most others over all its buckets: the original of a group of copies, as a rule. That
    joins such groups by as many pairs as members. Nodes of buckets that still hold several components
    form families, by hubs that they share a quarter with; what links between them is then found by
    prefixes of their sets, or of their differences from the family's centre, which lose no pair. All
    candidates are verified on their full sets. So no link that a band found is lost, and no pair within
    a component is made for its own sake.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = durable(sketches(source, width))
    named = docs.where("id IS NOT NULL AND digest IS NOT NULL")
    nodes = durable(named.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.max("n_shingles").alias("n")))
    member = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("key")
    met = durable(member.join(shared, "key").select("key", "node", "n"))
    sets = durable(shingle_sets(source.join(met.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"), width))
    alone = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.min("id").alias("node"), F.count("*").alias("df")).where("df = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("own"))
    held = met.join(alone, "node", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * 100 >= F.col("n") * percent)
    held = durable(held.select("key", "node").distinct())
    size = held.groupBy("key").agg(F.count("*").alias("met"))
    score = held.join(size, "key").groupBy("node").agg(F.sum("met").alias("score"))
    buckets = durable(held.join(score, "node").select("key", "node", "score"), over=held)
    wanted = durable(buckets.select(F.col("node").alias("id")).distinct())

    hubs = buckets.groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    pairs = buckets.join(hubs, "key").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = durable(compared(pairs, sets))
    links = tried.where(linked(percent)).select("a", "b")
    label = components(wanted, links)

    active = buckets.join(label.withColumnRenamed("id", "node"), "node")
    state = active.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    open_ = durable(active.join(state, "key").select("node", "comp").distinct())
    if not open_.isEmpty():
        family = components(wanted, tried.where("4 * i >= u").select("a", "b"))
        apart = open_.join(family.select(F.col("id").alias("node"), F.col("comp").alias("fam")), "node").join(sets.withColumnRenamed("id", "node"), "node")
        apart = durable(apart.select(F.monotonically_increasing_id().alias("m"), "node", "comp", "fam", F.size("items").alias("n"), "items"))
        sure, near = family_pairs(apart, percent)
        pairs = near.unionByName(foreign_pairs(apart, percent)).distinct()
        found = durable(compared(pairs, sets).where(linked(percent)).select("a", "b").unionByName(sure))
        label = components(wanted, links.unionByName(found))

    copies = nodes.where("copies > 1").select("digest", "node")
    out = docs.join(copies, "digest", "left").select("id", "n_shingles", F.coalesce("node", "id").alias("node"))
    out = out.join(label.withColumnRenamed("id", "node"), "node", "left").select("id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
