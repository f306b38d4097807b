"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two blocks of 23 bits and a rest. In each block the anchors
are the words of the binary Golay code: its covering radius is 3, so a fingerprint has one
home, the pair of codewords within 3 of its blocks. Of two fingerprints that differ in at
most 2 bits, one lies within 3+a and 3+b of the other's home with a+b <= 2. Each
fingerprint is therefore sent to all anchors within those radii (61 on average of 16.8
million), and every home is compared with what reached its anchor. No pair is missed, and
only distinct fingerprints take part: copies are one node.

Defined cases: a null or empty text has fingerprint zero and links like any other; equal
texts share a fingerprint; repeated rows stay separate rows of the result; a null doc_id
never names a component (one of null ids only has a null component_id), but its row links
like any other; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import KEY, components, least_rows, spread, stored, table, with_key

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Generator polynomial of the [23, 12] Golay code.
GENERATOR, BLOCK, RADIUS = 0b101011100011, 23, 3


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the word shingles of a text."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - SHINGLE + 1)
    last = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    hashes = b"".join([xxh64_digest(flat[i:j], SEED) for i, j in zip(starts[:n].tolist(), last, strict=True)])
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t if isinstance(t, str) else None) for t in batch], dtype="int64")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial, of 23-bit words."""
    r = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@cache
def coset_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each syndrome the error patterns of weight 5 or less, the lightest first: patterns,
    levels (weight over 3, 0 at least), and where each syndrome's run begins."""
    words = np.zeros(1, np.int64)
    found = [words]
    for _ in range(RADIUS + THRESHOLD):
        words = np.unique((words[:, None] | (1 << np.arange(BLOCK))).ravel())
        found.append(words)
    patterns = np.unique(np.concatenate(found))
    weight = np.bitwise_count(patterns).astype(np.int64)
    s = syndrome(patterns)
    order = np.lexsort((patterns, weight, s))
    return patterns[order], np.maximum(weight[order] - RADIUS, 0), np.searchsorted(s[order], np.arange(2049))


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all anchors that the fingerprints reach."""
    patterns, levels, begin = coset_patterns()
    blocks = [fps & (2**BLOCK - 1), (fps >> BLOCK) & (2**BLOCK - 1)]
    (x, sx), (y, sy) = ((b, syndrome(b)) for b in blocks)
    near = []
    for b, s in ((x, sx), (y, sy)):
        many = begin[s + 1] - begin[s]
        row = np.repeat(np.arange(len(b)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[s][row]
        near.append((many, at, np.cumsum(many) - many, b[row] ^ patterns[at]))
    (n1, a1, _, c1), (n2, a2, b2, c2) = near
    row1 = np.repeat(np.arange(len(fps)), n1)
    many = n2[row1]
    i = np.repeat(np.arange(len(row1)), many)
    j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + b2[row1[i]]
    keep = levels[a1[i]] + levels[a2[j]] <= THRESHOLD
    i, j = i[keep], j[keep]
    home = (a1[i] == begin[sx][row1[i]]) & (a2[j] == begin[sy][row1[i]])
    return row1[i], c1[i] << BLOCK | c2[j], home


def homes(fps: np.ndarray) -> np.ndarray:
    """The home of each fingerprint: the anchor whose cell it lies in."""
    patterns, _, begin = coset_patterns()
    x, y = fps & (2**BLOCK - 1), (fps >> BLOCK) & (2**BLOCK - 1)
    return (x ^ patterns[begin[syndrome(x)]]) << BLOCK | (y ^ patterns[begin[syndrome(y)]])


def _reach(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy("int64")
        for at in range(0, len(fps), 1024):
            part = fps[at : at + 1024]
            row, anchor, _ = anchors(part)
            yield pd.DataFrame({"anchor": anchor, "fp": part[row]})


def _home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"anchor": homes(batch["other"].to_numpy("int64")), "other": batch["other"]})


def links(fps: DataFrame) -> DataFrame:
    """Pairs (fp, other) of distinct fingerprints, column fp of fps, within the threshold."""
    reached = fps.select("fp").mapInPandas(_reach, "anchor long, fp long")
    home = fps.select(F.col("fp").alias("other")).mapInPandas(_home, "anchor long, other long")
    met = reached.join(home, "anchor").where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= THRESHOLD) & (F.col("fp") != F.col("other")))
    return met.select(F.least("fp", "other").alias("fp"), F.greatest("fp", "other").alias("other"))


def grouped(docs: DataFrame, *more: str) -> DataFrame:
    """Per row of docs: doc_id, the columns `more`, fp (signed), component (its least fingerprint), component_id.

    Fingerprints are the nodes, so rows without ids join what they lie between, and an id with
    two texts is two nodes; component_id, the least doc_id of the component, is looked up last.
    """
    prints = stored(spread(docs.select("doc_id", "text", *more)).select("doc_id", *more, fingerprints("text").alias("fp")), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes).distinct(), "fp", "other").withColumnRenamed("node", "fp")
    named = stored(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    first = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "first")
    named = stored(named.join(first, "component").select("fp", "component", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", *more, "fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fp (signed), component_id."""
    return grouped(docs).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each component keeps one, see least_rows."""
    keyed = with_key(docs)
    return least_rows(keyed, grouped(keyed, KEY)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
