"""Embedding near-duplicates by product quantisation.

A bounded sample of vectors gives coarse centroids and, for the residuals to them, a
codebook in each subspace. Every vector is in the inverted list of its label and nearest
centroid, as residual codes with its quantisation error. A query probes every list in which
a vector within the link distance can be: those to whose cell no border is further than
that distance. In a list, distances are sums of table look-ups; by the
triangle inequality a code further away than link distance plus its quantisation error is
no link, the others are compared by exact cosine in double precision. So recall is that of
brute force, whatever the quality of the fit.

Equal vectors are one entry. Lists are cut into blocks by hash and met by blocks of
queries, so a list of a third of all vectors is many groups of bounded size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or
have no label, link with nothing and are their own component; vectors of different lengths
never link; repeated rows link with each other; a null vec_id never names a component, but its
row links like any other (a component without ids has a null component_id); an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, spread, stored, table

COSINE = 0.98
SAMPLE = 32_768
LISTS = 1024
SUBSPACES, CODES = 16, 256
BLOCK, QUERIES = 2048, 4096
ITERATIONS = 8
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        near = nearest(x, c)
        many = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(many)
        c[full] = np.add.reduceat(x[order], (np.cumsum(many) - many)[full], axis=0) / many[full, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], c).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids and codebooks; its size depends on parameters and the vectors' length only."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.width = -(-sample.shape[1] // SUBSPACES)
        self.books = [kmeans(s, CODES, 2 + m) for m, s in enumerate(self.split(rest))]

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a : a + self.width] for a in range(0, x.shape[1], self.width)]

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of unit vectors."""
        lists = nearest(x, self.centroids)
        rest = self.split(x - self.centroids[lists])
        codes = [nearest(r, b) for r, b in zip(rest, self.books, strict=True)]
        error = sum(((r - b[c]) ** 2).sum(1) for r, b, c in zip(rest, self.books, codes, strict=True))
        return lists, np.array(codes).T.astype(np.uint8), np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): every list that can hold a vector within reach of a row.

        A vector in the list of c is no further from c than from each of m rivals, so than
        from them on average; to get there from x it must cross the plane where both are
        equal, which the margin and the distance of c to the rivals' mean tell.
        """
        c = self.centroids
        d = distances(x, c)
        order = np.argsort(d, axis=1)
        near = np.ones(d.shape, bool)
        for m in (1, 2, 4, 8):
            if m <= len(c):
                rivals = order[:, :m]
                middle = c[rivals].mean(1)
                margin = d - np.take_along_axis(d, rivals, 1).mean(1)[:, None]
                near &= margin <= 2 * reach * np.sqrt(distances(middle, c)) + SLACK
        near[np.arange(len(x)), order[:, 0]] = True
        return np.nonzero(near)

    def tables(self, x: np.ndarray, number: int) -> list[np.ndarray]:
        """Per subspace, squared distances of queries (residuals to a list's centroid) to the codes."""
        return [distances(r, b) for r, b in zip(self.split(x - self.centroids[number]), self.books, strict=True)]


def unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows in double precision, padded with zeros to a common width."""
    x = np.zeros((len(vectors), width))
    if len(vectors) and all(len(v) == width for v in vectors):
        x[:] = np.stack(vectors.to_list())
    else:
        for k, v in enumerate(vectors):
            x[k, : len(v)] = v
    return x / np.sqrt((x * x).sum(1))[:, None]


def entries(embeddings: DataFrame) -> DataFrame:
    """Rows with usable, the 128-bit key of label and vector, and what they are compared by."""
    v = F.col("embedding")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    e = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), sound.alias("usable"))
    return e.select("vec_id", "label", "v", "usable", F.when(F.col("usable"), F.xxhash64("label", "v")).alias("k1"), F.when(F.col("usable"), F.xxhash64("v", F.lit("second"), "label")).alias("k2"))


def fitted(vectors: DataFrame, n: int) -> tuple[Index, int]:
    """An index from a bounded sample of `vectors`, those with the least hash; and the width."""
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    sample = vectors.select("rep", "v", F.xxhash64("k1", "k2").alias("h")).orderBy("h", "rep").limit(SAMPLE).toPandas()
    lists = int(max(1, min(LISTS, round(n**0.5 / 2), len(sample) // 16)))
    return Index(unit(sample["v"], width), lists), width


def links(embeddings: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their keys, entries (k1, k2, rep, least, n), and per entry and group its links: k1, rep, root, m).

    m counts the vectors an entry links with, root is an entry that links lead to.
    """
    spark = embeddings.sparkSession
    rows = stored(entries(spread(embeddings)), "vectors")
    found = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Entries are numbered, so one without ids links like any other, and an id with two vectors is two.
    reps = stored(found.withColumn("rep", F.monotonically_increasing_id()), "entries")
    n = reps.count()
    if not n:
        return rows, reps, spark.createDataFrame([], "k1 long, rep long, root long, m long")
    model, width = fitted(reps, n)
    shared = spark.sparkContext.broadcast(model)
    # From the cosine in exact arithmetic; SLACK covers rounding.
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit(b["v"], width)
            lists, codes, error = shared.value.add(x)
            yield pd.DataFrame({"rep": b["rep"], "n": b["n"], "k1": b["k1"], "label": b["label"], "dim": b["v"].map(len), "list": lists, "codes": [c.tobytes() for c in codes], "error": error, "v": b["v"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                got = b.iloc[at : at + 1024]
                row, number = shared.value.probes(unit(got["v"], width), reach)
                got = got.iloc[row]
                yield pd.DataFrame({"rep": got["rep"], "n": got["n"], "k1": got["k1"], "label": got["label"], "dim": got["v"].map(len), "list": number, "v": got["v"]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in probe(batches):
            yield b[["label", "dim", "list"]]

    where = ["label", "dim", "list"]
    by = [*where, "block", "part"]
    vector = reps.schema["v"].dataType.simpleString()
    indexed = stored(reps.mapInPandas(index, "rep long, n long, k1 long, label string, dim int, list int, codes binary, error double, v " + vector), "index")
    probed = reps.mapInPandas(probe, "rep long, n long, k1 long, label string, dim int, list int, v " + vector)
    probes = reps.mapInPandas(count, "label string, dim int, list int")
    sizes = stored(indexed.groupBy(where).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(probes.groupBy(where).agg(F.ceil(F.count("*") / QUERIES).alias("parts")), where), "lists")

    def piece(own: str) -> F.Column:
        return F.pmod(F.xxhash64("k1", "rep"), F.col(own)).cast("int")

    def every(other: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int")))

    x = indexed.join(sizes, where).withColumn("block", piece("blocks")).withColumn("part", every("parts")).select(*by, "rep", "n", "k1", "codes", "error", "v")
    q = probed.join(sizes, where).withColumn("part", piece("parts")).withColumn("block", every("blocks"))
    q = q.select(*[F.col(c).alias(c) for c in (*by, "rep", "n", "k1", "v")])  # its own columns, though both sides come from one table of lists

    def compare(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        """Per entry with links here: how many vectors it links with, and the least entry of its component here."""
        found = []
        if len(queries) and len(entries):
            model = shared.value
            y, error = unit(entries["v"], width), entries["error"].to_numpy()
            codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(entries), -1)
            reps, keys = (np.concatenate([queries[c].to_numpy(), entries[c].to_numpy()]) for c in ("rep", "k1"))
            for at in range(0, len(queries), 256):
                z = unit(queries["v"].iloc[at : at + 256], width)
                d = sum(t[:, codes[:, m]] for m, t in enumerate(model.tables(z, int(entries["list"].iloc[0]))))
                i, j = np.nonzero(np.sqrt(d) <= reach + error + SLACK)
                q, e = at + i, len(queries) + j
                # Each pair is met from both sides; it counts once.
                once = reps[q] < reps[e]
                linked = once & (np.einsum("ij,ij->i", z[i], y[j]) >= cosine)
                found.append((q[linked], e[linked]))
        if not any(len(q) for q, _ in found):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("k1", "rep", "root", "m")})
        q, e = (np.concatenate(x) for x in zip(*found, strict=True))
        n = np.concatenate([queries["n"].to_numpy(), entries["n"].to_numpy()])
        many = np.bincount(q, n[e], len(n)) + np.bincount(e, n[q], len(n))
        root, before = reps.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            least = np.minimum(root[q], root[e])
            np.minimum.at(root, q, least)
            np.minimum.at(root, e, least)
        got = np.flatnonzero(many)
        return pd.DataFrame({"k1": keys[got], "rep": reps[got], "root": root[got], "m": many[got].astype(np.int64)})

    # A row per entry and group that it has links in, not one per link: a group of near-copies stays linear.
    told = q.groupBy(by).cogroup(x.groupBy(by)).applyInPandas(compare, "k1 long, rep long, root long, m long")
    return rows, reps, stored(told, "links")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id, kept."""
    rows, reps, linked = links(embeddings, cosine)
    many = linked.groupBy("rep").agg(F.sum("m").alias("m"))
    found = components(linked, "rep", "root").withColumnRenamed("node", "rep")
    told = reps.select("k1", "k2", "rep", "least", "n").join(many, "rep", "left").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = stored(told, "joined")
    first = stored(told.groupBy("component").agg(F.min("least").alias("component_id")), "first")
    told = told.join(first, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    told = stored(told, "told")  # plain shuffles on both sides of the join: a vector with many copies is split
    sound = rows.where("usable").select("vec_id", "k1", "k2").join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id
"""
