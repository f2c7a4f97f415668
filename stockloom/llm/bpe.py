"""Byte-level BPE by an index of pair occurrences: encoding, decoding and their round trip (operator 12)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_of, default_path, tokenizer, vocabulary

#: Pieces that a worker keeps with their ids, and bytes of them, before it forgets them all.
CACHED, CACHED_BYTES = 700_000, 48_000_000
#: Characters of text whose new pieces are merged together at least, and the most of one text that is split at once.
CHUNK, LONG = 12_000_000, 2_000_000
#: Ids that are turned into bytes at once.
BLOCK = 1_000_000
#: Ids are below it.
ID_RANGE = 1 << 16
#: In UTF-8, code points from U+0400 on begin with this byte or a greater one. All those before U+0530 are assigned.
HIGH_BYTE = 0xD0


@cache
def unassigned():
    """Matches a code point that this Python's Unicode tables don't have. Libraries differ on what those are, so the tokenizer's own splitter decides."""
    odd = (c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    runs = ([c for _, c in run] for _, run in groupby(enumerate(odd), lambda x: x[1] - x[0]))
    return re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]")


class Merges:
    """A vocabulary file's merges: by rank the two ids and the id they make; by pair the rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_of()
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in parts], np.int64)
        self.right = np.array([ids[b] for _, b in parts], np.int64)
        self.made = np.array([ids[a + b] for a, b in parts], np.int64)
        pair = self.left * ID_RANGE + self.right
        self.order = np.argsort(pair, kind="stable")
        self.pairs = pair[self.order]
        self.single = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.single[byte] = ids[letter]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no merge has it."""
        key = left * ID_RANGE + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], -1)


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of one pair, as in aaa, each second one from the first on. at ascends; after is each one's right half."""
    follows = np.concatenate([[False], after[:-1] == at[1:]])
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(follows, 0, place))
    return at[(place - start) % 2 == 0]


def merged(pieces: list[bytes], rules: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has.

    All pieces lie in one row of symbols, linked within each piece. The index has all positions of each
    pair by its rank. Ranks are applied in ascending order, each to all its positions at once, from left to
    right where they overlap; the pairs that this makes with both neighbours join the lists of their ranks, and positions
    of pairs that are gone fail the comparison when their turn comes. Pieces don't meet, so each gets
    what it would get alone.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbol = rules.single[np.frombuffer(b"".join(pieces), np.uint8)]
    n, ends = len(symbol), np.cumsum(size)
    follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    follow[ends[size > 0] - 1] = -1
    before[(ends - size)[size > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Enters the pairs that begin at these ascending positions."""
        rank = rules.ranks(symbol[at], symbol[follow[at]])
        known = rank >= 0
        if not known.all():
            at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        edges = [0, *cuts.tolist(), len(rank)]
        for r, x, y in zip(rank[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            if r in index:
                index[r].append(at[x:y])
            else:
                index[r] = [at[x:y]]
                heapq.heappush(active, r)

    add(np.flatnonzero(follow >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
        left, right = rules.left[r], rules.right[r]
        at = at[symbol[at] == left]
        after = follow[at]
        good = (after >= 0) & (symbol[after] == right)
        at = at[good]
        if left == right and len(at) > 1:
            at = apart(at, after[good])
        if not len(at):
            continue
        gone = follow[at]
        beyond = follow[gone]
        symbol[at], symbol[gone], follow[at] = rules.made[r], -1, beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        ahead = before[at]
        touched = np.concatenate([ahead[ahead >= 0], at[inner]])
        if len(touched) > 1:
            touched.sort()
            touched = touched[np.concatenate([[True], touched[1:] != touched[:-1]])]
        if len(touched):
            add(touched)
    kept = np.concatenate([[0], np.cumsum(symbol >= 0)])
    return symbol[symbol >= 0].astype(np.uint32), kept[ends] - kept[ends - size]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat of these starts and sizes, one after the other."""
    total = int(size.sum())
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]


class Codec(dict):
    """Pieces (pre-tokens and special strings) by number, with their ids; new pieces wait until flush() merges them together."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        self.path, self.rules = path, merges(path)
        ranks, self.special, pattern = vocabulary(path)
        self.split = regex.compile(pattern)
        table = {i: raw for raw, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        raw = [table.get(i, b"") for i in range(max(table) + 1)]
        self.token_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.token_start, self.token_bytes = np.cumsum(self.token_size) - self.token_size, np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.start, self.size, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def pieces(self, text: str) -> Iterable[str]:
        """The pieces of a text without special strings, by the vocabulary's pattern."""
        if not text.isascii() and (np.frombuffer(text.encode(), np.uint8) >= HIGH_BYTE).any() and unassigned().search(text):
            return (text[x:y] for _, (x, y) in tokenizer(self.path).pre_tokenizer.pre_tokenize_str(text))
        return self.split.findall(text) if len(text) <= LONG else (m.group() for m in self.split.finditer(text))

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of all pieces of a text; a special string is a piece of its own, as a tuple, so that no pre-token equals it."""
        parts = [text]
        for s in self.special:
            parts = [y for x in parts for y in self.cut(x, s)]
        return np.concatenate([np.array([self[x]]) if isinstance(x, tuple) else np.fromiter(map(self.__getitem__, self.pieces(x)), np.int64) for x in parts])

    @staticmethod
    def cut(part, special: str) -> list:
        if isinstance(part, tuple) or special not in part:
            return [part]
        texts = part.split(special)
        return [texts[0], *(y for x in texts[1:] for y in ((special,), x))]

    def flush(self) -> None:
        """Merges the new pieces."""
        words = [b"" if isinstance(p, tuple) else p.encode() for p in self.new]
        ids, size = merged(words, self.rules)
        own = [k for k, p in enumerate(self.new) if isinstance(p, tuple)]
        ids = np.insert(ids, (np.cumsum(size))[own], [self.special[self.new[k][0]] for k in own]) if own else ids
        size[own] = 1
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size, self.held = np.concatenate([self.flat, ids]), np.concatenate([self.size, size]), self.held + sum(map(len, words))
        self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.start[numbers], self.size[numbers])

    def text(self, ids: np.ndarray) -> str:
        """The ids' text; ids that the vocabulary lacks stand for nothing, bytes that aren't UTF-8 become U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.token_size))].astype(np.int64)
        return b"".join(gathered(self.token_bytes, self.token_start[x], self.token_size[x]).tobytes() for x in (ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))).decode(errors="replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(texts: Iterator[tuple[object, str]], path: str) -> Iterator[tuple[object, np.ndarray]]:
    """(key, ids) of each (key, text), in order. New pieces of about CHUNK characters of text are merged together."""
    own, waiting, n = codec(path), [], 0
    for key, text in texts:
        waiting.append((key, own.numbers(text)))
        n += len(text)
        if n >= CHUNK:
            yield from flushed(own, waiting)
            waiting, n = [], 0
    yield from flushed(own, waiting)


def flushed(own: Codec, waiting: list) -> Iterator[tuple[object, np.ndarray]]:
    own.flush()
    for key, numbers in waiting:
        yield key, own.ids(numbers)
    if len(own) > CACHED or own.held > CACHED_BYTES:
        own.forget()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, object]]:
    for b in batches:
        yield from zip(b.column(0), b.column(1).to_pylist(), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `most` bytes: each row ends with its own size."""
    held, size = [], 0
    for row in rows:
        held.append(row[:-1])
        size += row[-1] + 100
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each row of df: its id, and ids (array of int) as the tokenizers library gives them without added special tokens.

    Null texts count as empty and have no ids. Special strings inside texts become their ids. A null id stays
    null; repeated rows stay repeated; an empty table gives an empty result. Other columns of df aren't carried, so none can clash.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((k, x or "") for k, x in rows_of(batches))
        made = ((k, ids.astype(np.int32), 4 * len(ids)) for k, ids in encoded(texts, path))
        yield from keyed(made, [("ids", pa.list_(pa.int32()))])

    return mapped(df, id_col, F.col(text_col).cast("string"), run, "ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row for each row of df: its id and the text of its ids, special tokens included.

    Null arrays and arrays of no ids give an empty text; null ids and ids that the vocabulary lacks stand for nothing, and bytes
    that aren't UTF-8 become U+FFFD. Repeated rows and null keys stay; other columns aren't carried.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        texts = ((k, own.text(np.array([i for i in x or () if i is not None], np.int64))) for k, x in rows_of(batches))
        yield from keyed(((k, t, len(t)) for k, t in texts), [("text", pa.string())])

    return mapped(df, id_col, F.col(ids_col), run, "text string")


def round_trips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode() and decode() of each row of df in one pass: id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (UTF-8). Odd rows as there."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        pairs = encoded(((k, x or "") for k, x in rows_of(batches)), path)
        made = ((k, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.text(ids).encode()).hexdigest(), 200) for k, ids in pairs)
        yield from keyed(made, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    return mapped(df, id_col, F.col(text_col).cast("string"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def keyed(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose first value is an Arrow scalar, the id."""
    rows = iter(rows)
    first = next(rows, None)
    if first is None:
        return

    def plain() -> Iterator[tuple]:
        for k, *rest in (r for part in ([first], rows) for r in part):
            yield k.as_py(), *rest

    yield from batched(plain(), pa.schema([("id", first[0].type), *fields]))


def mapped(df: DataFrame, id_col: str, value, run, made: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), value.alias("value")).mapInArrow(run, f"id {kind}, {made}")
    return out.withColumnRenamed("id", id_col)
