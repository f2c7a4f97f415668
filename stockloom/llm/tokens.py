"""Token ids and token counts for a byte-level BPE vocabulary file (operator 9)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space, as the tokenizer's \s has them.
SPACE = "\\t-\\r \\x85" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A run of white space before other text gives its last character to what follows.
RUN_END = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
#: Longer pre-tokens go to the tokenizer's own merge, whose time doesn't grow with the square of the length.
LONG_WORD = re.compile(f"[^{SPACE}]{{400}}")
CACHED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_of() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int], str]:
    """Bytes of each entry with its id, the special strings, and the pre-token pattern."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_of()
    ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return ranks, special, public_tokenizers.PATTERN


@cache
def encoder(path: str):
    """The same vocabulary for fast bulk encoding; its pattern needs no look-ahead, because RUN_END does that part."""
    import tiktoken

    ranks, special, pattern = vocabulary(path)
    return tiktoken.Encoding("bulk", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, path: str) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens."""
    if LONG_WORD.search(text):
        return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    bulk, special = encoder(path), vocabulary(path)[1]
    for s, i in special.items():
        if s in text:
            parts = [encode(x, path) for x in text.split(s)]
            return np.concatenate([parts[0], *(y for x in parts[1:] for y in ([i], x))]).astype(np.uint32)
    parts = [bulk.encode_to_numpy(s, disallowed_special=()) for s in RUN_END.split(text)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer, given them alone, returns as one token: the proof is made once, before any text is read."""
    ranks, special, _ = vocabulary(path)
    strings = []
    for raw, i in ranks.items():
        try:
            strings.append((raw.decode(), i))
        except UnicodeDecodeError:
            continue
    found = tokenizer(path).encode_batch([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(strings, found, strict=True) if e.ids == [i] and s not in special)


class PreTokenCounts(dict):
    """Tokens of a pre-token: 1 for whole tokens, else what the merges give. Forgets all when CACHED others are known."""

    def __init__(self, path: str):
        super().__init__(dict.fromkeys(whole_tokens(path), 1))
        self.path, self.whole = path, len(self)

    def __missing__(self, piece: str) -> int:
        if len(self) > self.whole + CACHED:
            self.clear()
            self.update(dict.fromkeys(whole_tokens(self.path), 1))
        n = len(tokenizer(self.path).encode(piece, add_special_tokens=False).ids) if len(piece) > 400 else len(encoder(self.path)._core_bpe.encode_single_piece(piece.encode()))
        if len(piece) <= 64:
            self[piece] = n
        return n


@cache
def counts_of(path: str) -> PreTokenCounts:
    return PreTokenCounts(path)


def count(text: str, path: str) -> int:
    import regex

    _, special, pattern = vocabulary(path)
    split = regex.compile(pattern)
    known, n, parts = counts_of(path), 0, [text]
    for s in special:
        parts = [y for x in parts for y in x.split(s)]
    n = len(parts) - 1
    for x in parts:
        n += sum(map(known.__getitem__, split.findall(x)))
    return n


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row for each row of df: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes and 0 tokens. A null id stays null; repeated rows stay repeated;
    an empty table gives an empty result. Other columns of df aren't carried, so none can clash.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = np.fromiter((count(x, path) for x in texts), np.int64, len(texts))
            size = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
