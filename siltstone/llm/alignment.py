"""Alignment of two tokenizers' tokens over the same bytes.

Vocabulary A is byte-level BPE and gets a space before the text; B is a sentencepiece model,
which adds that space itself. Where the joined bytes of both are that space and the text, the
tokens of both cover the same bytes. In a task, DuckDB holds the tokens of a pack of texts as
interval tables on one axis of bytes:

* a full join on the ends tells the cuts, where tokens of both end; a window that counts them
  along the axis numbers the groups between two cuts;
* every end is the end of one overlap of an A and a B token. At a cut both are known. An end
  of A alone lies in the B token with the nearest end behind it (ASOF join), an end of B alone
  in the A token whose range holds it (range join).

So a link is found once, and there are as many as ends. A pack's links are counted per id pair;
Spark merges these partial counts into those of the corpus, takes each B id's highest, and
sends every pack the counts of its own pairs. A pack is PACK bytes of whole texts; its tokens
come to DuckDB in slices of about SLICE, cut where both vocabularies have an end.

Defined cases: a text that is null or empty, or whose tokens of A or B don't spell it (a
text with U+2581, which B reads as a space), has no tokens: counts of 0 and an empty string;
control strings are plain text; repeated rows stay rows, and their links count each time; an
empty table gives an empty result; of other columns those named in `keep` stay. A text is
worked on whole, in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import fresh, spread, stored, table

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a pack's texts, and A tokens of a slice.
PACK, SLICE = 1 << 22, 1 << 19
MADE = "n_a long, n_b long, n_groups long, n_links long, groups string, keys array<int>, times array<int>, pairs array<struct<a: int, b: int, n: bigint>>"

#: The tokens of a slice: ta (d, i, e) and tb (i, e), with document, id and end. All ends in order, with the ids of the tokens that end there
#: (d: of A's) and the group: the cuts up to here, this one left out.
TOKENS = """
SELECT e, a, b, d, CAST(count(a + b) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) - CAST(a IS NOT NULL AND b IS NOT NULL AS INTEGER) AS g
FROM (SELECT coalesce(x.e, y.e) AS e, x.i AS a, y.i AS b, x.d FROM ta x FULL JOIN tb y ON x.e = y.e)"""
ODD = "SELECT * FROM tokens WHERE a IS NULL OR b IS NULL"
#: Groups with an end of one vocabulary alone, and their tokens of A with their starts (or the last end before, of such a group; none of those ends is between).
NEAR = "SELECT * FROM tokens SEMI JOIN odd USING (g)"
RANGES = "SELECT *, lag(e, 1, -1) OVER (ORDER BY e) AS s FROM near WHERE a IS NOT NULL"
LINKS = """
SELECT d, a, b, CAST(count(*) AS INTEGER) AS n FROM (
  SELECT d, a, b FROM tokens WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT o.d, o.a, n.b FROM (SELECT * FROM odd WHERE b IS NULL) o ASOF JOIN (SELECT * FROM near WHERE b IS NOT NULL) n ON o.e <= n.e
  UNION ALL SELECT n.d, n.a, o.b FROM (SELECT * FROM odd WHERE a IS NULL) o JOIN ranges n ON n.s < o.e AND o.e < n.e)
GROUP BY ALL"""


def bytes_of() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable Latin-1 is itself, the others are moved behind U+0100, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Both:
    """Both encoders, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            known = json.load(f)
        special = {t["content"] for t in known["added_tokens"]}
        back = bytes_of()
        # Ids of byte-level BPE are in the order of its merges, so they are the ranks.
        ranks = {bytes(back[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.none = np.zeros(0, np.int32)
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        #: Decimal ids with what may follow them: another of the group, the other vocabulary, the next group.
        n, m = range(len(self.a_size)), range(len(self.b_size))
        self.shown = [f"{i}," for i in n] + [f"{i}|" for i in n] + [f"{i}," for i in m] + [f"{i};" for i in m]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """ids of A and B; none if they don't spell the text behind a space."""
        if not text:
            return self.none, self.none
        whole, b = " " + text, self.b.encode(text)
        spelt = whole.encode("utf-8", "surrogatepass")
        a = np.array(self.a.encode_ordinary(whole), np.int32)  # byte-level: bytes are never changed, so their number tells
        if self.a_size[a].sum() != len(spelt) or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            return self.none, self.none
        return a, np.array(b, np.int32)


@cache
def both(a_path: str | None = None, b_path: str | None = None) -> Both:
    """One of a Python worker, for all of its tasks."""
    import public_tokenizers

    return Both(a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY))


def slices(a_end: np.ndarray, b_end: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of A and B tokens of about SLICE, each up to a common end."""
    i = j = 0
    while i < len(a_end):
        at, more = i + SLICE - 1, None
        while more is None and at < len(a_end):
            ends = a_end[at : at + 4096]
            there = np.searchsorted(b_end, ends)
            hit = np.flatnonzero(b_end[np.minimum(there, len(b_end) - 1)] == ends)
            more = (at + int(hit[0]) + 1, int(there[hit[0]]) + 1) if len(hit) else None
            at += 4096
        ni, nj = more or (len(a_end), len(b_end))
        yield slice(i, ni), slice(j, nj)
        i, j = ni, nj


def overlaps(db, doc: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Group of each A token and of each B token, and the links: d, a, b, and how often (n)."""
    a_group, b_group, links, groups = [], [], [], 0
    for x, y in slices(a_end, b_end):
        begin = a_end[x.start - 1] if x.start else 0
        small = lambda v, off=0: pa.array((v - off).astype(np.int32))
        db.register("ta", pa.table({"d": small(doc[x]), "i": small(a[x]), "e": small(a_end[x], begin)}))
        db.register("tb", pa.table({"i": small(b[y]), "e": small(b_end[y], begin)}))
        for name, sql in (("tokens", TOKENS), ("odd", ODD), ("near", NEAR), ("ranges", RANGES)):
            db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {sql}")
        links.append(db.execute(LINKS).fetchnumpy())
        told = db.execute("SELECT g, a IS NOT NULL AS a, b IS NOT NULL AS b FROM tokens ORDER BY e").fetchnumpy()
        for group, side in ((a_group, "a"), (b_group, "b")):
            group.append(told["g"][told[side]].astype(np.int64) + groups)
        groups = int(a_group[-1][-1]) + 1
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(a_group), join(b_group), {c: join([np.asarray(x[c]) for x in links]).astype(np.int64) for c in ("d", "a", "b", "n")}


def pack(texts: list[str | None], encode: Both, db) -> dict[str, pa.Array]:
    """Columns of MADE for the texts of a pack; its pairs are in the first row."""
    tokens = [encode(t) for t in texts]
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    a_end, b_end = np.cumsum(encode.a_size[a]), np.cumsum(encode.b_size[b])
    a_group, b_group, links = overlaps(db, np.repeat(np.arange(len(texts)), n_a), a, a_end, b, b_end)

    # The tokens of both, group by group.
    last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
    order = np.empty(len(a) + len(b), np.int64)
    many = len(encode.a_size)
    order[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + many * last(a_group)
    order[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = 2 * many + b + len(encode.b_size) * last(b_group)
    cuts = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    groups = ["".join(map(encode.shown.__getitem__, order[x:y].tolist()))[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]
    a_cuts = np.cumsum(n_a)
    n_groups = np.array([int(a_group[y - 1] - a_group[y - n]) + 1 if n else 0 for y, n in zip(a_cuts, n_a, strict=True)], np.int64)

    pairs, key = np.unique(links["a"] << 32 | links["b"], return_inverse=True)
    count = np.zeros(len(pairs), np.int64)
    np.add.at(count, key, links["n"])
    by_doc = np.argsort(links["d"], kind="stable")
    ends = np.searchsorted(links["d"][by_doc], np.arange(len(texts) + 1))
    times = links["n"][by_doc]
    total = np.concatenate(([0], np.cumsum(times)))[ends]
    listed = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
    found = pa.StructArray.from_arrays([pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(count)], names=["a", "b", "n"])
    first = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), found)
    rest = pa.nulls(len(texts) - 1, first.type)
    return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(np.diff(total)), "groups": pa.array(groups, pa.string()), "keys": listed(key[by_doc]), "times": listed(times), "pairs": pa.concat_arrays([first, rest])}


def aligned(docs: DataFrame, keep: list[str], text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row per document: the columns `keep`, the pack, and MADE.

    groups: the groups as `a1,a2|b1;a3|b2,b3` in ids of A and B. keys and times: the id pairs
    of its links, numbered within the pack, and how often each occurs. pairs: in the first row
    of a pack, its id pairs in the order of these numbers, with their links in the pack.
    """
    schema = StructType([docs.schema[c] for c in keep]).add("pack", "long")
    schema = StructType([*schema.fields, *_parse_datatype_string(MADE).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        encode, number = both(a_path, b_path), TaskContext.get().partitionId() << 32
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                texts, kept = batch.column(len(keep)), [batch.column(k) for k in range(len(keep))]
                if not len(texts):
                    continue
                step = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // PACK
                cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    made = pack(texts.slice(i, j - i).to_pylist(), encode, db)
                    columns = [*[c.slice(i, j - i) for c in kept], pa.array(np.full(j - i, number)), *made.values()]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    number += 1

    named = [F.col(f"`{c}`") for c in keep]
    return spread(docs.select(*named, F.col(f"`{text}`").alias(fresh(docs, "aligned_text")))).mapInArrow(run, schema)


def pair_counts(packs: DataFrame) -> DataFrame:
    """Of each id pair (a, b) that is linked: its links in the corpus (count), and whether no pair of this b has more (best)."""
    counts = stored(packs.where("pairs IS NOT NULL").select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(packs: DataFrame) -> DataFrame:
    """packs (stored, from `aligned`) with n_best and count_sum instead of keys, times and pairs."""
    own = packs.where("pairs IS NOT NULL").select("pack", F.posexplode("pairs").alias("key", "x")).select("pack", "key", "x.a", "x.b")
    own = own.join(pair_counts(packs), ["a", "b"]).select(F.col("pack").alias("pack"), "key", "count", "best")  # a column of its own, though both sides come from packs
    rows = packs.drop("pairs")
    schema = StructType([f for f in rows.schema.fields if f.name not in ("keys", "times")]).add("n_best", "long").add("count_sum", "long")

    def totals(docs: pa.Table, known: pa.Table) -> pa.Table:
        key = known["key"].to_numpy()
        count, best = np.zeros((2, len(key)), np.int64)
        count[key], best[key] = known["count"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
        keys, times = (docs[c].combine_chunks() for c in ("keys", "times"))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(keys).to_numpy())))
        k, n = (x.flatten().to_numpy() for x in (keys, times))
        summed = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[ends]))
        return docs.drop_columns(["keys", "times"]).append_column("n_best", summed(n * best[k])).append_column("count_sum", summed(n * count[k]))

    return rows.groupBy("pack").cogroup(own.groupBy("pack")).applyInArrow(totals, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = aligned(table(spark, sf_dir, "documents"), ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    packs = stored(told.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_counts(packs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
