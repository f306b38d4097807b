"""Byte-level BPE against the library that the vocabulary is for, and its round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from siltstone.llm import byte_bpe
from siltstone.llm.byte_bpe import codec, decoded, encoded, op11_byte_bpe

from .test_sql import CASES, FOLDER, written


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_made_up_texts(library):
    rng, bpe = random.Random(5), codec()
    words = [t.decode("utf-8", "ignore") for t in bpe.ranks]
    some = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", " ", "é", "中", "本", "1", "²", "!", "==", "й", "ा", "न", "😀", "‍", "ا", "'s", "'S", "<|endoftext|>", "\x00", "\x85"]
    for k in range(4000):
        text = "".join(rng.choice(words if k % 2 else some) for _ in range(rng.randint(0, 12)))
        assert bpe.encode(text) == library.encode_ordinary(text), text
        piece = rng.randbytes(rng.randint(1, 40))
        assert bpe.piece(piece) == library._core_bpe.encode_single_piece(piece), piece


def test_long_pieces(library):
    """Pieces of 100,000 letters, and of one letter, in time that a quadratic search would not keep."""
    rng, bpe = random.Random(6), codec()
    for text in ("".join(rng.choice("abcdefghij") for _ in range(100_000)), "a" * 100_000, "ab" * 50_000, " " * 50_000, "é" * 50_000):
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_long_texts_are_streamed(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STREAMED", 10)
    text = "a text of several words, 123 numbers\n\n and lines"
    assert codec().encode(text) == library.encode_ordinary(text)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    bpe = byte_bpe.ByteBPE(codec().ranks, public_tokenizers.PATTERN)
    text = "unforgettable memorabilia of antidisestablishmentarianism, pseudopseudohypoparathyroidism " * 3
    assert bpe.encode(text) == library.encode_ordinary(text)
    assert len(bpe.pieces) <= 3 and len(bpe.borders) <= 3


def test_ranks_that_no_merges_make():
    with pytest.raises(ValueError, match="no merge"):
        byte_bpe.ByteBPE({bytes([b]): b for b in range(256)} | {b"abc": 256}, public_tokenizers.PATTERN)


@pytest.mark.parametrize("group", [1, 1 << 23])
def test_query(spark, library, tmp_path, monkeypatch, group):
    monkeypatch.setattr(byte_bpe, "GROUP", group)
    at, _ = written(spark, tmp_path, [*CASES, (8, "<|endoftext|> 'll  \n\n ÀÉ 東京 1234", "a")])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    plain = lambda i, t: (i, len(ids := library.encode_ordinary(t or "")), digest(",".join(map(str, ids)).encode()), digest((t or "").encode()))
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    assert sorted(map(tuple, op11_byte_bpe(spark, at).collect()), key=str) == sorted((plain(r.doc_id, r.text) for r in docs), key=str)


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op11_byte_bpe(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary(docs[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_columns_stay(spark):
    d = spark.createDataFrame([(1, "one", "x"), (2, None, None)], "ids int, text string, decoded string")
    got = decoded(encoded(d), ids="ids_")
    assert got.columns == ["ids", "text", "decoded", "ids_", "decoded_"]
    assert [(r.ids, r.decoded, bytes(r.decoded_)) for r in got.orderBy("ids").collect()] == [(1, "x", b"one"), (2, None, b"")]
    assert encoded(d.where("false")).count() == 0


def test_ids_without_bytes(spark):
    d = spark.createDataFrame([(1, None), (2, [0, None]), (3, [10**6]), (4, []), (5, [-1])], "k int, ids array<int>")
    assert [r.decoded for r in decoded(d).orderBy("k").collect()] == [None, None, None, b"", None]
