"""Byte-level BPE: texts to token ids and back.

A text is cut by the vocabulary's pattern, and each piece is encoded by itself. A piece that
is a token is that token. Any other is searched from its end by an Aho-Corasick automaton over
the reversed tokens (bytes as Latin-1 characters), which gives the longest token at every
place. From left to right the longest one is taken whose border with the token before holds;
where none does, the token before is taken back for its next shorter prefix, and the place is
never tried again. A border holds if merging would not have crossed it, told by undoing the
merges on both sides from the last to the first; the answer is remembered per pair of tokens.
There is one sequence of tokens whose borders all hold, that of the merges, and each place is
left once, so the time is linear in the piece.

Pieces are remembered too, a bounded number of short ones.

Defined cases: a null or empty text has no ids (an empty array), and no ids are no bytes; null
ids, an id that is null or not in the vocabulary give null bytes; equal texts get equal ids;
repeated rows stay; an empty table gives an empty result; other columns are kept, and the new
ones get underscores behind their names where these are taken. Texts are never cut short.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import fresh, spread, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most pieces and borders that a worker remembers, and the longest piece (in characters).
REMEMBERED, LONGEST_PIECE = 400_000, 64
#: Texts longer than this (characters) are cut into pieces one by one; batches are returned by about GROUP bytes.
STREAMED, GROUP = 1 << 20, 1 << 23


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Remembered(dict):
    """ids of pieces, as the bytes of an array; those that were not met yet are encoded. Holds REMEMBERED short pieces at most."""

    def __init__(self, encode: Callable[[str], Iterable[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(piece)).tobytes()
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """An encoder and decoder of one vocabulary: ranks of tokens in the order of their merges, and the pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.raw: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.bytes = pa.array(self.raw, pa.binary())
        #: By id: length, longest shorter token that it begins with, the two it was merged of (none: a byte).
        self.size = [len(t or b"") for t in self.raw]
        self.shorter = [-1] * len(self.raw)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.raw)
        self.borders: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.parts[rank] = self._merged_of(token, rank)
        self.borders.clear()  # of part of the vocabulary
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.shorter[rank] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            self.longest.add_word(token[::-1].decode("latin-1"), rank)
        self.longest.make_automaton()
        self.cut = regex.compile(pattern)
        self.pieces = Remembered(lambda piece: self.piece(piece.encode("utf-8", "surrogatepass")))

    def _merged_of(self, token: bytes, rank: int) -> tuple[int, int]:
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and self._holds(a, b, rank):
                return a, b
        raise ValueError(f"no merge of earlier tokens makes {token!r}")

    def _holds(self, a: int, b: int, before: int) -> bool:
        """Whether merges with ranks below `before` leave the border between tokens a and b."""
        while True:
            joined = self.ranks.get(self.raw[a] + self.raw[b])
            if joined is not None and joined < before:
                return False
            left, right = self.parts[a], self.parts[b]
            if left and (not right or a > b):
                before, a = a, left[1]
            elif right:  # of equal merges the left one comes first, so the right one is undone first
                before, b = b + 1, right[0]
            else:
                return True

    def holds(self, a: int, b: int) -> bool:
        known = self.borders.get((a, b))
        if known is None:
            if len(self.borders) >= REMEMBERED:
                self.borders.clear()
            known = self.borders[a, b] = self._holds(a, b, len(self.raw))
        return known

    def piece(self, b: bytes) -> list[int]:
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        n, size = len(b), self.size
        longest = array("i", [-1]) * n
        for end, token in self.longest.iter(b[::-1].decode("latin-1")):  # of one end the longest comes first
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        shorter, known = self.shorter, self.borders.get
        token = longest[0]
        out = [token]
        left = bytearray(n + 1)
        at = size[token]
        while at < n:
            last, token = out[-1], longest[at]
            while token >= 0 and (left[at + size[token]] or not (self.holds(last, token) if (held := known((last, token))) is None else held)):
                token = shorter[token]
            # Nothing follows `last`: the place is left, and so is each token before that has no shorter one that goes on.
            while token < 0:
                left[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]
                while token >= 0 and (left[at + size[token]] or out and not self.holds(out[-1], token)):
                    token = shorter[token]
            out.append(token)
            at += size[token]
        return out

    def packed(self, text: str) -> bytes:
        """ids as the bytes of an array of ints."""
        found = self.cut.findall(text) if len(text) <= STREAMED else (m.group() for m in self.cut.finditer(text))
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes | None:
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError:  # a null or unknown id
            return None

    def decode_lists(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list: tokens are taken from the vocabulary one behind the other, and cut where lists end."""
        flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        known = flat.null_count == 0 and (not len(flat) or 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(self.raw))
        taken = pc.take(self.bytes, flat) if known else None
        if taken is None or taken.null_count:
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.binary())
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(flat) + 1][np.concatenate(([0], np.cumsum(n)))]
        whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), taken.buffers()[2]])
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary())) if lists.null_count else whole


@cache
def codec(path: str | None = None) -> ByteBPE:
    """One of a Python worker, for all of its tasks."""
    import public_tokenizers

    return ByteBPE(read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


def slices(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about GROUP bytes by their sizes (null: 0); one empty run if there are no rows."""
    cuts = np.flatnonzero(np.diff(np.cumsum(pc.fill_null(sizes, 0).to_numpy(), dtype=np.int64) // GROUP)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a column ids, array<int>, of the column `text`."""
    schema = StructType([*docs.schema.fields]).add(fresh(docs, "ids"), ArrayType(IntegerType(), False), False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for i, j in slices(pc.binary_length(texts)):
                ids = [bpe.packed(t or "") for t in texts.slice(i, j - i).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    return spread(docs).mapInArrow(run, schema)


def decoded(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column decoded, the bytes of the column `ids`."""
    schema = StructType([*docs.schema.fields]).add(fresh(docs, "decoded"), BinaryType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for i, j in slices(pc.multiply(pc.list_value_length(lists), 4)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, bpe.decode_lists(lists.slice(i, j - i))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded(ids).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
