"""Aligned tokens against a plain walk over both tokenizers' own output."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siltstone.llm import alignment
from siltstone.llm.alignment import aligned, both, bytes_of, op13_alignment, pack, pair_counts

from .test_sql import CASES, FOLDER, written


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_VOCABULARY))


def spans(libraries, text):
    """(id, start, end) of the tokens of both, or none."""
    a, b = libraries
    if not text:
        return [], []
    back = bytes_of()
    out = [[(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
    out.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    if any(b"".join(t for _, t in x) != (" " + text).encode() for x in out):
        return [], []
    both_ = []
    for x in out:
        at, got = 0, []
        for i, t in x:
            got.append((i, at, at + len(t)))
            at += len(t)
        both_.append(got)
    return both_


def plain(libraries, docs):
    """Rows of the contract for [(doc_id, text)], by comparing tokens one by one."""
    rows, total = [], Counter()
    for doc_id, text in docs:
        a, b = spans(libraries, text)
        links, groups, i, j = [], [], 0, 0
        while i < len(a):
            x, y = [a[i]], [b[j]]
            while x[-1][2] != y[-1][2]:
                if x[-1][2] < y[-1][2]:
                    i += 1
                    x.append(a[i])
                else:
                    j += 1
                    y.append(b[j])
            i, j = i + 1, j + 1
            links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
            groups.append(",".join(str(p[0]) for p in x) + "|" + ",".join(str(q[0]) for q in y))
        total.update(links)
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, a, b, g, len(k), sum(total[x] == most[x[1]] for x in k), sum(total[x] for x in k), h) for d, a, b, g, k, h in rows], total


ODD = ["<|endoftext|><s></s><unk><0x41> ▁", "a▁b", "  two  spaces ", " ", "   ", "\n\t\r\n", "東京都に住んでいます。これは長い文です", "naïve café Ünïcødé 😀👩‍👩‍👧", "a" * 500, "\x00\x01", "don't WE'LL 12345678 !!!???", "Привет, мир", "नमस्ते दुनिया"]


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, libraries, tmp_path, monkeypatch, small):
    """With packs and slices of few tokens the answer is the same."""
    if small:
        monkeypatch.setattr(alignment, "PACK", 300)
        monkeypatch.setattr(alignment, "SLICE", 50)
    at, _ = written(spark, tmp_path, [*CASES, *[(100 + k, t, "x") for k, t in enumerate(ODD)]])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_alignment(spark, at).collect()), key=str) == sorted(plain(libraries, docs)[0], key=str)


def test_whole_table(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows, total = plain(libraries, docs)
    assert sorted(map(tuple, op13_alignment(spark, FOLDER).collect()), key=str) == sorted(rows, key=str)
    packs = aligned(spark.read.parquet(f"{FOLDER}/documents.parquet"), ["lang"])
    assert {(r.a, r.b): r["count"] for r in pair_counts(packs).collect()} == total
    assert packs.columns[:2] == ["lang", "pack"]


def test_encoders_are_the_tokenizers(libraries):
    rng, encode = random.Random(8), both()
    some = ["a", "the", "ing", " ", "  ", "   ", "\n", "\t", "é", "中", "本", "1", "!", "😀", "\xa0", "　", "<s>", "</s>", "<|endoftext|>", "'s", "\x00", "ﬁ", "Å"]
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 12)))
        a, b = encode(text)
        assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == libraries[1].encode(text), text


def test_pack_of_nothing():
    made = pack([None, ""], both(), duckdb.connect())
    assert made["n_links"].to_pylist() == [0, 0] and made["groups"].to_pylist() == ["", ""] and made["pairs"].to_pylist() == [[], None]


def test_empty_table(spark, tmp_path):
    at, _ = written(spark, tmp_path, [])
    assert op13_alignment(spark, at).count() == 0


def test_alphabet():
    with open(public_tokenizers.path(alignment.A_VOCABULARY), encoding="utf-8") as f:
        assert {c for t in json.load(f)["model"]["vocab"] for c in t if t != "<|endoftext|>"} <= set(bytes_of())
