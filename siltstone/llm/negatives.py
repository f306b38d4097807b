"""Hard negatives: for anchors and their positives, the best rows of other labels within a window of scores.

Scores are integer inner products, so they are exact. Candidates are sorted by norm, the
longest first, and cut into shelves of equal size; a shelf is a group of a Spark job, and in
it buckets of BUCKET rows follow each other. By the Cauchy-Schwarz inequality no row of a
bucket scores above the anchor's norm times that of the bucket's first row. A bucket is
left out for an anchor if this bound is below what each of its windows still asks for: the
window's lower limit, or the score of its k-th row so far if that is higher. As norms fall, so
are all buckets behind it.

Shelves are searched in rounds of 1, 2, 4, ... shelves. Anchors are dealt in parts of at most
PART; a round joins a part with the shelves that its least demanding anchor may still need,
compares them group by group, and merges what was found with what is kept (k rows per window
at most). The search ends when no part needs a further shelf. Positives are found in the
same way, among shelves of one label, without limits.

Defined cases: rows whose label or vector is null take no part, nor do those with a null
component; a shorter vector is filled up with zeros, an empty one scores 0; components
are clipped to +-2^53 and scores to the range of a long; repeated rows are rows of their own,
so a copy of an anchor can be its positive; an anchor that occurs twice is answered twice; a
null id comes last among ties, and an anchor without id keeps a null one; an anchor without
positives, or a window that nothing falls into, gives no rows; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, shared_dir, spread, stored, table

POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score, as shares of the positive's.
LOW, HIGH, OF = 30, 90, 100
#: Anchors of a group, rows of a bucket, and numbers (rows x width) of a shelf.
PART, BUCKET, SHELF = 512, 1024, 1 << 19
LEAST_SHELF, MOST_SHELF = 64, 8192
EXACT = 2**53
#: Norms are square roots in double precision.
SLACK = 1e-9
FOUND = "rid long, w int, score long, crid long, id long"


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    return x


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x (whole numbers up to 2^53), exact, as int64."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, unnamed: np.ndarray, number: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher scores, then smaller ids (null ones last), then rows."""
    if len(score) > k:  # the k-th score first, so that only its ties are sorted
        score_k = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= score_k)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rid[some], number[some], unnamed[some], ~score[some]))[:k]]  # ~ reverses the order and can't overflow


def ceil_of(score: Column, share: int, of: int) -> Column:
    return F.ceil(score.cast("decimal(19,0)") * F.lit(share) / F.lit(of)).cast("long")


def floor_of(score: Column, share: int, of: int) -> Column:
    return F.floor(score.cast("decimal(19,0)") * F.lit(share) / F.lit(of)).cast("long")


def dealt(rows: DataFrame, same: bool, size: int, number: str) -> DataFrame:
    """rows with their group g (the label, or one for all) and a number: runs of at most `size` rows of a group, by falling norm, from 0."""
    d = rows.withColumn("g", F.col("label") if same else F.lit("")).withColumn("fall", -F.col("norm"))
    d = running(d, ["g", "fall", "rid"], {"before": F.lit(1)}).withColumn("run", F.floor(F.col("before") / size))
    first = d.groupBy("g").agg(F.min("run").alias("first"))
    return d.join(first, "g").withColumn(number, (F.col("run") - F.col("first")).cast("long")).drop("first", "run", "before", "fall")


def search(rows: DataFrame, anchors: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """rid, w, rank, score, crid, id: the best k rows for each window of each anchor.

    rows: rid, id, label, v, norm. anchors: rid, label, v, norm, windows (array of w, lo, hi).
    same: among rows of the anchor's label, itself left out; else among those of other labels.
    """
    spark = rows.sparkSession
    size = max(LEAST_SHELF, min(MOST_SHELF, SHELF // max(1, width)))
    shelves = stored(dealt(rows, same, size, "shelf"), "shelves")
    tops = stored(shelves.groupBy("g", "shelf").agg(F.max("norm").alias("top")), "tops")
    asked = stored(dealt(anchors, same, PART, "part"), "anchors")
    last = tops.agg(F.max("shelf")).first()[0]
    kept, begin = spark.createDataFrame([], FOUND), 0
    order = Window.partitionBy("rid", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "crid")

    def compare(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        c = c.sort_values(["norm", "rid"], ascending=[False, True])
        x, rid, norm, label = matrix(c["v"], width), c["rid"].to_numpy(np.int64), c["norm"].to_numpy(), c["label"].to_numpy()
        unnamed, number = c["id"].isna().to_numpy(), c["id"].fillna(0).to_numpy(np.int64)
        q, q_norm, q_rid, q_label = matrix(a["v"], width), a["norm"].to_numpy(), a["rid"].to_numpy(), a["label"].to_numpy()
        # Per anchor and window: limits, and what this shelf gave.
        lo, hi = ([[w[n] for w in windows] for windows in a["windows"]] for n in ("least", "hi"))
        places: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * len(w) for w in lo]
        values: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * len(w) for w in lo]
        need = np.array([min((low for low, high in zip(*w, strict=True) if low <= high), default=np.inf) for w in zip(lo, hi, strict=True)], float)
        for at in range(0, len(c), BUCKET):
            alive = np.flatnonzero(q_norm * norm[at] * (1 + SLACK) + SLACK >= need)
            if not len(alive):
                break
            part = slice(at, at + BUCKET)
            for i, s in zip(alive.tolist(), scores(q[alive], x[part]), strict=True):
                # The label tells which rows count: all here if `same`, but the anchor itself.
                some = np.flatnonzero(rid[part] != q_rid[i] if same else label[part] != q_label[i])
                s = s[some]
                for w, (low, high) in enumerate(zip(lo[i], hi[i], strict=True)):
                    hit = np.flatnonzero((s >= low) & (s <= high))
                    if len(hit):
                        there, those = np.concatenate((places[i][w], some[hit] + at)), np.concatenate((values[i][w], s[hit]))
                        first = best(those, unnamed[there], number[there], rid[there], k)
                        places[i][w], values[i][w] = there[first], those[first]
                        if len(first) == k:
                            lo[i][w] = max(low, int(those[first[-1]]))
                need[i] = min((low for low, high in zip(lo[i], hi[i], strict=True) if low <= high), default=np.inf)
        out = [(q_rid[i], w["w"], p, s) for i, windows in enumerate(a["windows"]) for w, p, s in zip(windows, places[i], values[i], strict=True) if len(p)]
        many = [len(p) for _, _, p, _ in out]
        there = np.concatenate([p for _, _, p, _ in out]) if out else np.zeros(0, np.int64)
        return pd.DataFrame({
            "rid": np.repeat(np.array([r for r, *_ in out], np.int64), many), "w": np.repeat(np.array([w for _, w, *_ in out], np.int32), many),
            "score": np.concatenate([s for *_, s in out]) if out else there, "crid": rid[there], "id": pd.array(number[there], "Int64"),
        }).assign(id=lambda d: d["id"].mask(unnamed[there]))

    while last is not None and begin <= last:
        end = 2 * begin + 1
        # What a window asks for: its lower limit, or its k-th score if it has k rows.
        full = kept.groupBy("rid", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        windows = asked.select("rid", F.explode("windows").alias("x")).select("rid", "x.*").join(full, ["rid", "w"], "left")
        windows = windows.withColumn("least", F.greatest("lo", "kth")).where("least <= hi").groupBy("rid").agg(F.collect_list(F.struct("w", "least", "hi")).alias("windows"), F.min("least").alias("need"))
        now = stored(asked.drop("windows").join(windows, "rid"), "asking")
        threshold = F.when(F.col("norm") > 0, F.col("need") / F.col("norm")).when(F.col("need") <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        parts = now.groupBy("g", "part").agg(F.min(threshold).alias("t"))
        todo = stored(tops.where(F.col("shelf").between(begin, end - 1)).join(parts, "g").where(F.col("top") * (1 + SLACK) + SLACK >= F.col("t")).select("g", "part", "shelf"), "todo")
        if todo.isEmpty():
            break
        by = ["g", "part", "shelf"]
        a = now.join(todo, ["g", "part"]).select(*by, "rid", "label", "v", "norm", "windows")
        c = shelves.join(todo.select(*[F.col(x).alias(x) for x in by]), ["g", "shelf"]).select(*by, "rid", "id", "label", "v", "norm")
        found = a.groupBy(by).cogroup(c.groupBy(by)).applyInPandas(lambda a, c: compare(a, c) if len(a) and len(c) else pd.DataFrame({x.split()[0]: [] for x in FOUND.split(", ")}), FOUND)
        kept = stored(kept.union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "kept")
        begin = end
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, of: int = OF) -> DataFrame:
    """vectors: vec_id, label, vector (array of whole numbers), anchor (boolean). A row per anchor, positive and negative.

    An anchor's positives are its best rows of the same label; a positive's negatives the best
    of other labels with low * positive_score <= of * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    v = F.transform("vector", lambda x: F.greatest(F.lit(-float(EXACT)), F.least(F.lit(float(EXACT)), x.cast("double"))))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    d = vectors.where(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), v.alias("v"), F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Numbered and stored once, so that a row's number holds.
    d = stored(spread(d).withColumn("norm", norm).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    width = d.agg(F.max(F.size("v"))).first()[0]
    rows, anchors = d.drop("anchor"), d.where("anchor").select("rid", "id", "label", "v", "norm")
    least, most = -(2**63), 2**63 - 1
    window = F.struct(F.lit(0).alias("w"), F.lit(least).alias("lo"), F.lit(most).alias("hi"))
    good = stored(search(rows, anchors.drop("id").withColumn("windows", F.array(window)), True, positives, width or 0), "positives")
    limits = F.struct(F.col("rank").cast("int").alias("w"), ceil_of(F.col("score"), low, of).alias("lo"), floor_of(F.col("score"), high, of).alias("hi"))
    windows = good.groupBy("rid").agg(F.collect_list(limits).alias("windows"))  # `positives` of them at most
    bad = search(rows, anchors.drop("id").join(windows, "rid"), False, negatives, width or 0)
    told = good.select("rid", F.col("rank").cast("int").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = bad.select("rid", "w", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = found.join(told, ["rid", "w"]).join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(EXACT)), F.least(F.lit(float(EXACT)), c.cast("double") * 256))))
    return hard_negatives(e.select("vec_id", label.alias("label"), F.when(finite, scaled).alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")))


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS v FROM r WHERE label IS NOT NULL AND e IS NOT NULL AND coalesce(list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))), true)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM s a JOIN s b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM p WHERE same) WHERE n <= 5),
h AS (SELECT g.a, g.b AS positive, g.score AS positive_score, p.b AS negative, p.score AS negative_score, row_number() OVER (PARTITION BY g.a, g.b ORDER BY p.score DESC, p.b) AS n
  FROM g JOIN p ON p.a = g.a AND NOT p.same AND 30 * g.score <= 100 * p.score AND 100 * p.score <= 90 * g.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(n AS INTEGER) AS "rank", negative AS negative_id, positive_score, negative_score FROM h WHERE n <= 10
"""
