"""Documents of similar text: Jaccard similarity of their sets of five-word shingles.

Documents with the same set are one node. Nodes meet where the BANDS x ROWS least hashes of
their sets agree in all rows of a band; pairs that meet are held against each other by the
whole sets, so no link is wrong. Of the pairs with a similarity of 0.8, a share of
(1 - 0.8^5)^32 = 3e-6 meets nowhere; of those with a higher one, less.

Nodes also meet by the anchor-point covering of simhash.py: their five-word SimHash
fingerprints differ in at most 2 bits. That alone can't reach a similarity of 0.8, where some
10 of 64 bits differ, so it comes beside the bands, and both kinds of candidates are held
against each other by their whole sets.

Of the nodes that meet in a band, each is first held against one, the hub. Links only matter
between components, so after that only pairs from different components are left to check:
a large group around one text costs a number of pairs that grows with its size. Of the
other pairs those whose sketches (SKETCH bits, a share of (1 - similarity) / 2 differs) are
over 4.75 standard deviations from a similarity of 0.8 are left out, 1 in 10^6 wrongly; the
rest is taken once, in the first band that both share.

Defined cases: words are cut at ASCII space and A-Z are folded; a text of one to four words is
one shingle; null and blank texts have the empty set and are one node that links to no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import KEY, components, delete, least_rows, made, spread, stored, with_key
from .simhash import links

SHINGLE, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS = 32, 5
#: Edges of a partition while components are found.
EDGES = 100_000
#: Bits of a sketch, and how many may differ: the mean and 4.75 standard deviations at LEAST.
SKETCH = 2048
DIFFER = int(SKETCH * 0.1 + 4.75 * (SKETCH * 0.1 * 0.9) ** 0.5)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - SHINGLE + 1)]
    last = ends[min(SHINGLE, len(words)) - 1 :] - 1
    return np.unique(np.frombuffer(b"".join([xxh64_digest(flat[i:j], SEED) for i, j in zip(starts.tolist(), last.tolist(), strict=True)]), ">u8").astype(np.uint64))


@cache
def _mixers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flip, times, weights = rng.integers(0, 2**64 - 1, (3, n), np.uint64)
    return flip[:, None], times[:, None] | np.uint64(1), weights | np.uint64(1)


def least_hashes(found: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Of each of n hash functions the least value over a set."""
    flip, times, _ = _mixers(n, seed)
    least = np.full(n, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 256):
        least = np.minimum(least, ((found[at : at + 256] ^ flip) * times).min(axis=1))
    return least


def bands(found: np.ndarray) -> np.ndarray:
    """A signed 64-bit value per band; sets that agree in it meet. The empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least, weights = least_hashes(found, BANDS * ROWS, SEED), _mixers(BANDS * ROWS, SEED)[2]
    return (least * weights).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH bits as signed 64-bit words: of each of as many hash functions a bit of the least value."""
    least = least_hashes(found, SKETCH, SEED + 1) * _mixers(SKETCH, SEED + 1)[2]
    return np.packbits((least >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bits(found: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    if not len(found):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">i8")[0])


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("bits", LongType()), StructField("bands", ArrayType(LongType()))]))
def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh64_intdigest

    for batch in texts:
        sets = [shingles(t if isinstance(t, str) else None) for t in batch]
        fps = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        yield pd.DataFrame({"fp": fps, "bits": np.array([bits(s) for s in sets], np.int64), "bands": [bands(s) for s in sets]})


@F.pandas_udf(ArrayType(LongType()))
def sketches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([sketch(shingles(t)) for t in batch])


def _held(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, a = None, None
    for batch in batches:
        keep = []
        for fp, x, y in zip(batch["a"], batch["x"], batch["y"], strict=True):
            if fp != last:
                last, a = fp, shingles(x)
            keep.append(similarity(a, shingles(y)) >= LEAST)
        yield batch.loc[keep, ["a", "b"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts, fp and text of texts, are similar by their whole sets."""
    x, y = texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    met = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return stored(met.mapInPandas(_held, "a long, b long"), "similar")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with component: the least fp of what the edges join, else their own."""
    return nodes.join(components(edges, "a", "b", EDGES).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def _covered(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose SimHash fingerprints (column bits) are linked by the covering.

    Of the nodes with one fingerprint the least stands for it: the others are paired with that one.
    """
    nodes = rows.where(F.size("bands") > 0).groupBy("fp").agg(F.first("bits").alias("bits"))
    first = stored(nodes.groupBy("bits").agg(F.min("fp").alias("rep")), "simhashes")
    pairs = links(first.select(F.col("bits").alias("fp"))).distinct()
    apart = pairs.join(first.select(F.col("bits").alias("fp"), F.col("rep").alias("a")), "fp").join(first.select(F.col("bits").alias("other"), F.col("rep").alias("b")), "other")
    same = nodes.join(first, "bits").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    return same.union(apart.select("a", "b"))


def grouped(docs: DataFrame) -> DataFrame:
    """Per row of docs (key, doc_id, text): key, doc_id, fp, component."""
    begin = len(made)
    rows = stored(spread(docs).select(KEY, "doc_id", "text", prints("text").alias("p")).select(KEY, "doc_id", "text", "p.fp", "p.bits", "p.bands"), "prints")
    near = stored(_covered(rows), "covered")
    reached = stored(rows.select("fp", "bands").dropDuplicates(["fp"]).select("fp", F.posexplode("bands").alias("band", "value")), "reached")
    # The hub of a band's value is the node with the most company: of near-copies of one text, that text.
    many = reached.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(reached.join(stored(many, "many"), ["band", "value"]), "met")
    ranked = stored(met.join(met.groupBy("fp").agg(F.sum("n").alias("company")), "fp").select("band", "value", "fp", "company"), "ranked")
    hubs = stored(ranked.groupBy("band", "value").agg(F.max(F.struct("company", "fp"))["fp"].alias("hub")), "hubs")
    met = stored(ranked.join(hubs, ["band", "value"]).select("band", "value", "hub", "fp"), "members")
    some = met.select("fp").union(near.select("a")).union(near.select("b")).distinct()
    texts = stored(rows.select("fp", "text", "bands").join(some, "fp", "left_semi").dropDuplicates(["fp"]), "texts")
    tried = met.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).union(near)
    edges = verified(tried.distinct(), texts)
    # What is in another component than its hub is held against the others that it meets.
    whose = _named(texts.select("fp"), edges)
    whose = stored(whose, "whose")
    met = met.join(whose, "fp").join(whose.select(F.col("fp").alias("hub"), F.col("component").alias("main")), "hub")
    met = stored(met.select("band", "value", "fp", "component", (F.col("component") != F.col("main")).alias("apart")), "parted")
    open_ = met.groupBy("band", "value").agg(F.max("apart").alias("any")).where("any").drop("any")
    met = stored(met.join(stored(open_, "open"), ["band", "value"]), "left")
    drawn = stored(spread(texts.join(met.select("fp").distinct(), "fp", "left_semi")).select("fp", sketches("text").alias("bits"), F.col("bands").alias("all")), "sketches")
    met = stored(met.join(drawn, "fp"), "sketched")
    side = lambda fp, bits, of: met.select("band", "value", F.col("fp").alias(fp), F.col("bits").alias(bits), F.col("all").alias(f"{bits}_all"), F.col("component").alias(of), F.col("apart").alias(f"{of}_apart"))
    differ = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(SKETCH // 64)), F.lit(0))
    # Two nodes that are apart are so in every band that they share: they count in the first one.
    before = F.exists(F.zip_with(F.slice("p_all", F.lit(1), F.col("band")), F.slice("q_all", F.lit(1), F.col("band")), lambda x, y: x == y), lambda x: x)
    both = side("b", "p", "c").where("c_apart").join(side("a", "q", "d"), ["band", "value"]).where((F.col("c") != F.col("d")) & (~F.col("d_apart") | (F.col("a") < F.col("b"))) & (differ <= DIFFER) & ~before)
    more = verified(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts)
    named = stored(_named(rows.select("fp").distinct(), edges.union(more)), "components")
    delete(docs.sparkSession, made[begin + 1 : -1])  # all but the rows and their components
    return rows.select(KEY, "doc_id", "fp").join(named, "fp").select(KEY, "doc_id", "fp", "component")


def without_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each component of similar texts keeps one, see least_rows."""
    keyed = with_key(docs)
    return least_rows(keyed, grouped(keyed)).select(*[F.col(f"`{c}`") for c in docs.columns])
