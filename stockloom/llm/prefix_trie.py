"""Trie of conversation prefixes: ternary search trees over range shards, merged at the shards' edges (operator 13)."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, durable, text_or_empty

#: Conversations of one block of so many ids share the first turns of the block's first; at most SHARED - 1 of them.
BLOCK, SHARED = 20, 4
ENDS = pa.schema([("key", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
NODE = pa.schema([
    ("edge", pa.bool_()), ("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()),
    ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
])
#: Output rows in one Arrow batch.
ROWS = 20_000
NO_ENDS = hashlib.sha256().hexdigest()


def turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(base, conv, turns): each conversation's turns in order, as a digest of role and text with the text's number of words.

    One shuffle, by the block of ids, in which texts don't take part.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    conv = F.col(conv_col).cast("long")
    rows = df.where(F.col(conv_col).isNotNull()).select(
        (conv - conv % BLOCK).alias("base"), conv.alias("conv"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), count_words(text).alias("words")).alias("t"),
    )
    return rows.repartition("base").groupBy("base", "conv").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, key, path, words): each conversation with its block's first turns in place of its own first ones.

    path is the sequence of turn digests, key a digest of it, words the texts' numbers of words.
    """
    own = turns(df, conv_col, turn_col, role_col, text_col)
    head = F.first(F.when(F.col("conv") == F.col("base"), F.slice("turns", 1, SHARED - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("int")
    empty = F.array().cast("array<struct<digest:binary,words:bigint>>")
    rest = F.slice("turns", shared + 1, F.size("turns"))
    own = own.select("conv", F.concat(F.slice(F.coalesce(head, empty), F.lit(1), shared), rest).alias("turns"))
    path = F.transform("turns", lambda t: t["digest"])
    key = F.unhex(F.sha2(F.array_join(F.transform(path, F.hex), ""), 256))
    return own.select("conv", key.alias("key"), path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def endings(rows: DataFrame) -> DataFrame:
    """(key, conv, n, ends) of each key of rows (key, conv): the least conv, their number, and the digest of all of them, ascending and comma-joined.

    A digest is sequential by nature, so the sorted ids pass through it as a stream; no key's ids are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, n, state, out = None, None, 0, None, []
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, least, n, state.hexdigest()))
                    key, least, n, state = k, c, 1, hashlib.sha256(str(c).encode())
                else:
                    n += 1
                    state.update(f",{c}".encode())
                if len(out) >= ROWS:
                    yield batch(out, ENDS)
                    out = []
        if key is not None:
            out.append((key, least, n, state.hexdigest()))
        if out:
            yield batch(out, ENDS)

    return rows.select("key", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(run, "key binary, conv long, n long, ends string")


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before those of its halves."""
    open_ = deque([(0, n)])
    while open_:
        low, high = open_.popleft()
        if low < high:
            mid = (low + high) // 2
            yield mid
            open_ += ((low, mid), (mid + 1, high))


class TernaryTree:
    """A ternary search tree over sequences of codes. Node 0 is the root, which has no code; links of 0 lead nowhere."""

    def __init__(self):
        self.code, self.low, self.equal, self.high = [-1], [0], [0], [0]
        #: By node: the one above in the trie, the depth, the sequence that made it, the sequence that ends there (-1: none).
        self.up, self.depth, self.maker, self.end = [-1], [0], [0], [-1]

    def insert(self, codes: list[int], k: int) -> None:
        links, at, above = self.equal, 0, 0
        code, low, high = self.code, self.low, self.high
        for d, c in enumerate(codes, 1):
            x = links[at]
            while x and code[x] != c:
                links, at = (low, x) if c < code[x] else (high, x)
                x = links[at]
            if not x:
                x = len(code)
                for column, v in ((code, c), (low, 0), (self.equal, 0), (high, 0), (self.up, above), (self.depth, d), (self.maker, k), (self.end, -1)):
                    column.append(v)
                links[at] = x
            links, at, above = self.equal, x, x
        self.end[above] = k

    def find(self, codes: list[int]) -> list[int]:
        """The nodes along a sequence that is in the tree, from the root."""
        nodes, x = [0], 0
        for c in codes:
            x = self.equal[x]
            while self.code[x] != c:
                x = self.low[x] if c < self.code[x] else self.high[x]
            nodes.append(x)
        return nodes

    def walk(self) -> list[int]:
        """All nodes, each before those below it, by a stack of its own."""
        order, open_ = [0], [self.equal[0]]
        while open_:
            x = open_.pop()
            if x:
                order.append(x)
                open_ += (self.high[x], self.equal[x], self.low[x])
        return order


def shard(rows: list[tuple]) -> Iterator[tuple]:
    """The trie nodes (as NODE) of ascending distinct sequences (path, words, conv, n, ends).

    Only a prefix of the first or of the last of them can also be in another shard: these are the edge nodes. Their children,
    leaves and savings are of inner nodes alone, and the merge adds the rest. Inner nodes are complete, but
    for the parent's least member if that is an edge node; its key then stands in `up`.
    """
    codes = {d: i for i, d in enumerate(sorted({d for path, *_ in rows for d in path}))}
    digests = list(codes)
    tree = TernaryTree()
    for k in medians(len(rows)):
        tree.insert([codes[d] for d in rows[k][0]], k)
    size = len(tree.code)
    keys: dict[int, bytes] = {0: b""}
    for path in (rows[0][0], rows[-1][0]):
        nodes = tree.find([codes[d] for d in path])
        for above, x in zip(nodes, nodes[1:], strict=False):
            keys[x] = hashlib.sha256(keys[above] + digests[tree.code[x]]).digest()
    n, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    order = tree.walk()
    words = [rows[k][1][d - 1] if d else 0 for k, d in zip(tree.maker, tree.depth, strict=True)]
    for x in reversed(order):
        if (k := tree.end[x]) >= 0:
            n[x] += rows[k][3]
            least[x] = rows[k][2] if least[x] is None else min(least[x], rows[k][2])
        if x not in keys:
            leaves[x] += not children[x]
            saved[x] += (n[x] - 1) * words[x]
        if (a := tree.up[x]) >= 0:
            n[a] += n[x]
            least[a] = least[x] if least[a] is None else min(least[a], least[x])
            if x not in keys:
                children[a], leaves[a], saved[a] = children[a] + 1, leaves[a] + leaves[x], saved[a] + saved[x]
    for x in order:
        a = tree.up[x]
        ends = rows[tree.end[x]][4] if tree.end[x] >= 0 else None
        inner = a >= 0 and a not in keys
        yield x in keys, keys.get(x), None if inner or a < 0 else keys[a], tree.depth[x], least[x], least[a] if inner else None, n[x], children[x], leaves[x], saved[x], words[x], ends


def shards(paths: DataFrame) -> DataFrame:
    """The nodes of each range shard of distinct sequences (path, words, conv, n, ends). A shard is a partition, whose number follows the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        out = []
        for node in shard(rows) if rows else ():
            out.append(node)
            if len(out) >= ROWS:
                yield batch(out, NODE)
                out = []
        if out:
            yield batch(out, NODE)

    cut = paths.select("path", "words", "conv", "n", "ends").repartitionByRange("path").sortWithinPartitions("path")
    return cut.mapInArrow(run, "edge boolean, key binary, up binary, depth long, conv long, parent long, n long, children long, leaves long, saved long, words long, ends string")


def merged_edges(nodes: DataFrame) -> DataFrame:
    """The edge nodes, each once and complete: (key, up, depth, conv, n, children, leaves, saved, ends).

    Children, leaves and savings of the edge nodes below are summed by doubling: after round k each node has those of all within
    2^k levels, and knows its ancestor 2^k levels up. The rounds follow the depth's logarithm.
    """
    least, most = F.min("conv").alias("conv"), F.max("ends").alias("ends")
    total = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    own = nodes.where("edge").groupBy("key", "up", "depth").agg(least, *total, F.max("words").alias("words"), most)
    own = durable(own)
    below = own.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("more"))
    own = durable(own.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more"))
    leaf = F.when(F.col("children") == 0, 1).otherwise(0)
    sums = durable(own.select("key", F.col("up").alias("far"), (F.col("leaves") + leaf).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved")))
    depth, step = own.agg(F.max("depth")).first()[0] or 0, 1
    while step <= depth:
        gain = sums.where("far IS NOT NULL").groupBy(F.col("far").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        next_ = sums.select(F.col("key").alias("far"), F.col("far").alias("farther"))
        grown = sums.join(gain, "key", "left").join(next_, "far", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = durable(grown.select("key", F.col("farther").alias("far"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved")), over=sums)
        step *= 2
    return own.drop("leaves", "saved").join(sums.drop("far"), "key")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns (node) of the rebuilt conversations, the root included.

    Returns conv_id (least member), depth, parent_conv_id (the parent's; root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Turns are ordered by turn, nulls first; then by role and a digest of role and
    text. Null roles and texts count as empty. Rows without a conversation id belong to no conversation and take no part. Repeated
    rows are repeated turns. An empty table has no conversation, so no root either. A block's first id is c - c % 20,
    with the remainder's sign as in SQL. Other columns aren't carried.

    Scale: texts are digested where they are read. Copies of a sequence become one row before the tree is
    built, so no range holds more than others by them; a shard is one partition of distinct sequences in memory.
    """
    rows = durable(rebuilt(df, conv_col, turn_col, role_col, text_col))
    paths = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words")).join(endings(rows), "key")
    nodes = durable(shards(durable(paths)))
    edges = durable(merged_edges(nodes))
    own = [F.col(c) for c in ("depth", "conv", "parent", "n", "children", "leaves", "saved", "ends")]
    above = edges.select(F.col("key").alias("up"), F.col("conv").alias("parent"))
    inner = nodes.where("NOT edge")
    known = inner.where("up IS NULL").select(*own)
    told = inner.where("up IS NOT NULL").drop("parent").join(above, "up").select(*own)
    edge = edges.join(above, "up", "left").select(*own)
    every = known.unionByName(told).unionByName(edge)
    return every.select(
        F.col("conv").alias(conv_col), "depth", F.col("parent").alias(f"parent_{conv_col}"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
