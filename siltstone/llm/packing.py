"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents of one length are interchangeable, and so are sequences with one gap. What rounds
work on is therefore tables of runs of equal sizes: a row per length that still has documents
(`capacity` at most, whatever the input), and a row per gap and run of neighbouring
sequences. A round is a Spark job over these tables:

1. documents and gaps are sorted together by size;
2. a sweep over them in that order gives each gap its best fit, the nearest smaller document
   that no gap before it takes (a stack of runs in a task of its own; a run is as many
   documents or gaps of one size as there are, so it is short whatever the input);
3. conflicts, several gaps on one length, are settled by rank: the documents of a length go
   to its gaps in order, one each, and what is left fills the same sequences with as many more
   of that length as fit;
4. gaps are updated, and the next round begins. When no gap fits any document, sequences are
   opened for the longest documents, as many as the tokens left would fill.

The driver only looks at three totals of a round. The rows themselves are never gathered:
each piece gets its rank within its length by distributed prefix counts, and finds its
sequence by a join with the rank intervals that the rounds left.

Defined cases: a null or empty text is the single end token; equal rows, and rows without or
with one doc_id, are packed separately; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, spread, stored, table

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
REMEMBERED, LONGEST_WORD = 500_000, 64
BLOCK_BITS = 16  # ranks are looked up in blocks
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters for which str.lower and the pattern below do what the tokenizer does.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\x00-\x1b\x20-\x7e¿¡À-ÖØ-öø-ÿ]*")
#: The byte-level alphabet: bytes that aren't printable Latin-1 are moved behind U+0100, in order.
_BYTES = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 324), strict=True))
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, exactly as the tokenizer gives them.

    VOCABULARY splits a text at white space and into parts before it merges bytes, so with it
    the words of plain Latin text are encoded once and remembered; any other text, and every
    text with another vocabulary, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.by_words = os.path.basename(path) == VOCABULARY
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.by_words or "<|" in text or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            pass
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return b"".join([self.words.get(w) or self.word(w) for w in words])

    def word(self, w: str) -> bytes:
        ids = b"".join([self.part(x) for x in _PARTS.findall(w)])
        if len(w) <= LONGEST_WORD:
            self.words[w] = ids
        return ids

    def part(self, x: str) -> bytes:
        if (ids := self.parts.get(x)) is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            # The model sees each byte as a printable character: ASCII as itself.
            shown = x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTES)
            ids = np.array([t.id for t in self.merge(shown)], "<u4").tobytes()
            if len(x) <= LONGEST_WORD:
                self.parts[x] = ids
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One of a Python worker, for all of its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document: its place and the CRC-32 of its ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return spread(docs.select("doc_id", "text")).mapInPandas(cut, PIECES)


STATE = "kind string, size long, at long, many long, length long, copies long, start long"


def _opened(docs: DataFrame, need: int, first: int, capacity: int) -> DataFrame:
    """Rows of STATE: sequences from `first` on for the longest of docs (size, at, many), the documents put there, and those left.

    All documents over half a sequence get one each, of the others the longest `need` in all.
    """
    longest = Window.orderBy(F.desc("size"))  # a row per length: `capacity` rows at most
    before = F.sum("many").over(longest) - F.col("many")
    d = docs.withColumn("before", before)
    d = d.withColumn("open", F.when(F.col("size") * 2 > capacity, F.col("many")).otherwise(F.greatest(F.lit(0), F.least("many", F.lit(need) - F.col("before")))))
    seq = (F.lit(first) + F.sum("open").over(longest) - F.col("open")).alias("seq")
    d = d.select("size", "at", "many", "open", seq)
    row = lambda kind, size, at, many, length=None, copies=None, start=None: F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if v is None else v).cast("long").alias(n) for n, v in (("size", size), ("at", at), ("many", many), ("length", length), ("copies", copies), ("start", start))])
    put = row("put", F.lit(capacity), F.col("seq"), F.col("open"), F.col("size"), F.lit(1), F.col("at"))
    left = row("doc", F.col("size"), F.col("at") + F.col("open"), F.col("many") - F.col("open"))
    gap = row("gap", F.lit(capacity) - F.col("size"), F.col("seq"), F.col("open"))
    return d.select(F.explode(F.array(put, left, gap)).alias("r")).select("r.*").where("many > 0 AND size > 0")


def _nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sweep, over runs in order of size (documents before gaps): each gap meets the nearest smaller document that no gap before it took."""
    open_, found = [], []
    for batch in batches:
        for size, gap, at, many in zip(*[batch[c].tolist() for c in ("size", "gap", "at", "many")], strict=True):
            if not gap:
                open_.append([size, many])
                continue
            while many and open_:
                length, left = open_[-1]
                n = min(many, left)
                found.append((size, at, n, length))
                at, many, open_[-1][1] = at + n, many - n, left - n
                if left == n:
                    open_.pop()
            if many:
                found.append((size, at, many, None))
    yield pd.DataFrame(found, columns=["size", "seq", "n", "length"]).astype({"length": "Int64"})


#: What follows a sweep: conflicts by rank, and gaps anew. The documents of a length come first in `ranked` (null size), then its gaps.
SETTLE = """
WITH met AS (
  SELECT size, seq, n, length, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS there FROM {swept}
  UNION ALL SELECT NULL, NULL, NULL, size, at, many FROM {state} WHERE kind = 'doc'),
ranked AS (
  SELECT size, seq, n, length, max(start) OVER whole AS start, max(there) OVER whole AS there, t,
    coalesce(sum(n) OVER whole, 0) AS ones, coalesce(sum(n) OVER upto, 0) AS one, coalesce(sum(n * t) OVER upto, 0) AS asked, coalesce(sum(n * t) OVER whole, 0) AS all_asked
  FROM (SELECT *, IF(n IS NULL, 0, size div length - 1) AS t FROM met)
  WINDOW whole AS (PARTITION BY length), upto AS (PARTITION BY length ORDER BY size, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (
  SELECT *, least(all_asked, there - ones) AS all_given, greatest(0, least(coalesce(n * t, 0), there - ones - asked)) AS given FROM ranked),
settled AS (
  SELECT *, IF(t > 0, given div t, 0) AS full, IF(t > 0, given % t, 0) AS rest, IF(t > 0 AND given % t > 0, 1, 0) AS one_more, n IS NOT NULL AND length IS NOT NULL AS hit FROM shared)
SELECT r.* FROM (SELECT explode(CASE WHEN hit THEN array({hit}) WHEN size IS NULL THEN array({doc}) ELSE array({gap}) END) AS r FROM settled)
WHERE r.many > 0 AND r.size > 0
"""


def _row(kind: str, *values: str) -> str:
    """A struct of STATE in SQL."""
    names = ("size", "at", "many", "length", "copies", "start")
    fields = [f"CAST({v} AS BIGINT) AS {n}" for n, v in zip(names, [*values, *["NULL"] * (len(names) - len(values))], strict=True)]
    return f"struct('{kind}' AS kind, {', '.join(fields)})"


HIT = ", ".join([
    _row("put", "size", "seq", "n", "length", "1", "start + one"),
    _row("put", "size - length", "seq", "full", "length", "t", "start + ones + asked"),
    _row("put", "size - length", "seq + full", "one_more", "length", "rest", "start + ones + asked + full * t"),
    _row("gap", "size - length * (t + 1)", "seq", "full"),
    _row("gap", "size - length * (rest + 1)", "seq + full", "one_more"),
    _row("gap", "size - length", "seq + full + one_more", "n - full - one_more"),
])
SETTLE = SETTLE.replace("{hit}", HIT).replace("{doc}", _row("doc", "length", "start + ones + all_given", "there - ones - all_given")).replace("{gap}", _row("gap", "size", "seq", "n"))


def _swept(state: DataFrame) -> DataFrame:
    """One round: the documents (kind doc) and gaps (kind gap) left, and what was put where (kind put).

    put: `many` sequences from `at` on, whose gap was `size`, get `copies` documents of `length`
    each, those with ranks from `start` on. The table is a few rows per length, however many
    documents there are, so one partition holds it.
    """
    one = state.coalesce(1)
    runs = one.where("kind <> 'put'").select("size", (F.col("kind") == "gap").alias("gap"), "at", "many").sortWithinPartitions("size", "gap", "at")
    swept = runs.mapInPandas(_nearest, "size long, seq long, n long, length long")
    return state.sparkSession.sql(SETTLE, swept=swept, state=one)


def pack_runs(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """counts: length, n (documents of it, a row each). Returns length, start, many, copies, sequence, offset:

    documents of that length with ranks from start on go to `many` sequences from `sequence`
    on, `copies` to each, the first at offset.
    """
    shared_dir(counts.sparkSession)
    state = counts.select(F.lit("doc").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("at"), F.col("n").cast("long").alias("many"), *[F.lit(None).cast("long").alias(c) for c in ("length", "copies", "start")]).coalesce(1).checkpoint()
    kept, sequences, opening = [], 0, True
    n, put, top = (F.when(F.col("kind") == kind, v) for kind, v in (("doc", F.col("many")), ("put", F.col("many")), ("put", F.col("at") + F.col("many"))))
    totals = [F.sum(n).alias("left"), F.sum(n * F.col("size")).alias("tokens"), F.sum(put).alias("put"), F.max(top).alias("top")]
    t = state.agg(*totals).first()
    while t["left"]:
        if opening:
            opened = _opened(state.where("kind = 'doc'").select("size", "at", "many"), max(1, -(-int(t["tokens"]) // capacity)), sequences, capacity)
            state = opened.unionByName(state.where("kind = 'gap'")).coalesce(1).checkpoint()
        else:
            state = _swept(state).coalesce(1).checkpoint()
        t = state.agg(*totals).first()
        if t["put"]:
            kept.append(state.where("kind = 'put'"))
            sequences = max(sequences, int(t["top"]))
        opening = not opening and not t["put"]
    none = counts.sparkSession.createDataFrame([], STATE)
    found = none
    for k in kept:
        found = found.unionByName(k)
    return found.select("length", "start", "many", "copies", F.col("at").alias("sequence"), (F.lit(capacity) - F.col("size")).alias("offset"))


def pack(table_of_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length."""
    # A row's bucket is the partition that made it, so no key, however frequent, is in one bucket.
    p = stored(table_of_pieces.withColumn("pk_bucket", F.spark_partition_id()), "pieces")
    sums = stored(p.groupBy("length", "pk_bucket").agg(F.count("*").alias("many")), "lengths")
    runs = stored(pack_runs(sums.groupBy("length").agg(F.sum("many").alias("n")), capacity), "runs")
    before = F.sum("many").over(Window.partitionBy("length").orderBy("pk_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("length", "pk_bucket", F.coalesce(before, F.lit(0)).alias("pk_before"))
    inside = Window.partitionBy("length", "pk_bucket").orderBy("doc_id", "piece")
    ranked = p.join(offsets, ["length", "pk_bucket"]).withColumn("pk_rank", F.col("pk_before") + F.row_number().over(inside) - 1).withColumn("pk_block", F.shiftright("pk_rank", BLOCK_BITS))
    stop = F.col("start") + F.col("many") * F.col("copies")
    # A run is met by the blocks of ranks that it reaches into: N / 2^16 rows more than there are runs.
    blocks = runs.select("length", F.col("start").alias("r_start"), stop.alias("r_stop"), "copies", "sequence", F.col("offset").alias("r_offset"))
    blocks = blocks.withColumn("pk_block", F.explode(F.sequence(F.shiftright("r_start", BLOCK_BITS), F.shiftright(F.col("r_stop") - 1, BLOCK_BITS))))
    found = ranked.join(blocks, ["length", "pk_block"]).where("pk_rank >= r_start AND pk_rank < r_stop")
    nth = F.col("pk_rank") - F.col("r_start")
    sequence = F.col("sequence") + F.floor(nth / F.col("copies"))
    offset = F.col("r_offset") + nth % F.col("copies") * F.col("length")
    return found.select(*[found[c] for c in table_of_pieces.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
