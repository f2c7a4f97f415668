"""Encoding and decoding beside the tokenizers library, whole texts and odd ones."""

import hashlib
import random
import struct

import numpy as np
import pytest

from stockloom.llm import bpe, registry
from stockloom.llm.common import table
from stockloom.llm.tokens import default_path, tokenizer

SF = "/root/testdata/sf0.001"
BITS = [
    "a", "aa", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "​", "　", "é", "ß", "日本", "😀", "՘", "࢏", "͸", "1", "12", "'s", "'ll", "'", "<|endoftext|>", "<|",
    "endoftext", "\x00", "ab" * 30, "́", "Ⅷ", "�", "x" * 500, " " * 70, "\U00011de1", "ﬁ", "İ",
]


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    return [*made, "x" * 1_000_000, "ab" * 500_000, "".join(rnd.choice("abcdefgh") for _ in range(300_000)), "", "<|endoftext|>" * 3]


def test_ids_and_texts_equal_the_library():
    path, given = default_path(), texts()
    library, own = tokenizer(path), bpe.codec(path)
    for k, ids in bpe.encoded(enumerate(given), path):
        want = library.encode(given[k], add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.text(ids) == library.decode(want, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_does():
    library, own, rnd = tokenizer(default_path()), bpe.codec(default_path()), random.Random(2)
    for _ in range(2000):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert own.text(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", ["aaaa", "aaaaa", "abababab", "x", "", "hello", "aabaabaa"])
def test_overlaps(piece):
    rules = bpe.merges(default_path())
    ids, size = bpe.merged([piece.encode()] * 3 + [b""], rules)
    want = tokenizer(default_path()).encode(piece, add_special_tokens=False).ids
    assert ids.tolist() == want * 3 and size.tolist() == [len(want)] * 3 + [0]


def test_forgetting_changes_nothing(monkeypatch):
    given = texts()[:300]
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "CACHED", 10)
    library = tokenizer(default_path())
    assert [ids.tolist() for _, ids in bpe.encoded(enumerate(given), default_path())] == [library.encode(t, add_special_tokens=False).ids for t in given]


def test_query_over_the_whole_table(spark):
    library = tokenizer(default_path())
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = registry.queries()["op12_bpe_round_trip"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_encode_and_decode_tables(spark):
    rows = [(1, "the <|endoftext|> é"), (1, "the <|endoftext|> é"), (None, "x"), (2, None), (3, ""), (4, "y" * 300_000)]
    df = spark.createDataFrame([(*r, [1], "z") for r in rows], "doc_id long, text string, ids array<int>, id string")
    ids = bpe.encode(df)
    assert ids.columns == ["doc_id", "ids"] and dict(ids.dtypes)["ids"] == "array<int>"
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode(ids).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 99999, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd).collect()} == {1: "", 2: "", 3: "a"}
    none = df.where("doc_id < 0")
    assert bpe.encode(none).count() == bpe.decode(bpe.encode(none)).count() == bpe.round_trips(none).count() == 0
