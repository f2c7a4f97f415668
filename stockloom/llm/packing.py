"""Best-fit decreasing packing of token pieces into sequences (operator 2)."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .tokens import default_path, encode


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)

    def set(self, room: int, present: bool) -> None:
        i = room + self.size
        self.any[i] = int(present)
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least need, in logarithmic time."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs histogram[length] pieces of each length; returns runs and the number of bins.

    A run (length, first rank, first bin, pieces a bin, offset) places the pieces of that length from
    that rank on: so many in each of the bins from first bin on, from that offset. Bins of equal
    remaining capacity are alike, so they are kept as ranges and the work depends on the number of
    lengths, not of pieces. The outcome is that of placing the pieces one by one, longest first: the
    tightest bin takes pieces of a length until no more fit, as it stays the tightest.
    """
    tree, rooms, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            rooms[room].append((start, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                start, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                start, n = rooms[room].popleft()
                if not rooms[room]:
                    tree.set(room, False)
            runs.append((length, rank, start, each, capacity - room))
            full = min(n, left // each)
            put(room - each * length, start, full)
            rank, left = rank + full * each, left - full * each
            if full < n:
                part = 1 if left else 0
                put(room - left * length, start + full, part)
                put(room, start + full + part, n - full - part)
                rank, left = rank + left, 0
    return runs, bins


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str) -> DataFrame:
    """Pieces of each row's ids plus end_id; part and nth number the pieces of a length within an input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(text or "", path), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((k, i, x, y - x, zlib.crc32(ids[x:y].tobytes()), seen[y - x]))
                    seen[y - x] += 1
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:]), pa.array(np.full(len(cols[0]), part, np.int32))], names=["id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Packs every row's tokens and a closing end_id into as few sequences of at most capacity tokens as best fit finds.

    Only rows longer than capacity are cut: into pieces of capacity tokens, of which the first may be
    shorter. Returns id, piece, start, length, ids_crc32, sequence_id and offset of each piece.
    Null or empty texts give one piece with end_id alone. Repeated rows and repeated or null ids are
    packed row by row. An empty table gives an empty result. Other columns aren't carried.

    Scale: only the histogram of lengths (at most capacity rows) reaches the driver, and the runs made
    from it go back. A piece's rank among those of its length is its place in its input partition plus
    the counts of the partitions before, which a window over (partition, length) counts gives; these counts
    grow with the input, so they meet the pieces (some 50 bytes each) by a shuffle.
    """
    spark = df.sparkSession
    pieces = durable(token_pieces(df, id_col, text_col, capacity, end_id, path or default_path()))
    counts = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    runs.sort()
    plan = np.array(runs, np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((plan, np.searchsorted(plan[:, 0], np.arange(capacity + 2))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("length", "part", before.alias("before")).hint("merge"), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, edge = sent.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = length == x
                at[rows] = edge[x] + np.searchsorted(plan[edge[x] : edge[x + 1], 1], rank[rows], "right") - 1
            _, first, start, each, offset = plan[at].T if len(at) else np.zeros((5, 0), np.int64)
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(start + nth // np.maximum(each, 1)), pa.array(offset + nth % np.maximum(each, 1) * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return out.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
