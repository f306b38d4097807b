"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the byte n-grams of a text in lower case (A-Z), hashed to 2^20 numbers, on
levels: that it occurs at least once, twice, four times. From the training rows every feature
gets its naive Bayes log-count ratio. Those that occur in LEAST_ROWS rows and tell the
classes apart beyond chance (chi-square of SIGNIFICANT, one in a thousand) and by a factor of
FACTOR or more are kept, however many they are, and a logistic regression with an L1 penalty is fitted over them, each scaled
by its ratio. The penalty is that of PENALTIES with the least loss on a fold of the training rows.

The fit is on a bounded sample: at most TRAIN_ROWS labelled documents, those with the least
md5 of their doc_id, a text each (of a doc_id with several the least), equal texts of a class once. Scores cover whole texts
of all rows. What is broadcast is a number per hash and a weight per kept n-gram and level.

Defined cases: a null or empty text has no features and gets the score of the intercept;
a doc_id with several labels is toxic if any says so; null labels are no labels; without
labelled rows of both classes every score is the share of toxic rows, or 0 if there are
none; repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, spread, stored, table

SIZES = (3, 5, 7)
#: Occurrences from which on a level of an n-gram is a feature.
LEVELS = (1, 2, 4)
BITS = 20
TRAIN_ROWS = 20_000
SIGNIFICANT, FACTOR, LEAST_ROWS = 10.83, 4, 3
FOLDS = 5
SMOOTHING = 1.0
PENALTIES, STEPS = (2.5e-4, 5e-4, 1e-3), 80
#: Bytes that are hashed at a time; a batch of longer texts is cut into such groups.
GROUP = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def grams(texts: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the wanted n-grams of each text, a feature per level: number * len(LEVELS) + level. wanted: number by hash, or -1."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).astype(np.uint32)
    found = []
    h = np.zeros(len(whole), np.uint32)
    for k in range(max(SIZES)):
        h = h[: len(whole) - k] * np.uint32(0x01000193) + whole[k:] + np.uint32(1)
        if k + 1 in SIZES:
            f = wanted[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)]
            at = np.flatnonzero(f >= 0)
            row = np.searchsorted(ends, at, side="right")
            inside = at + k < ends[row] - 1
            found.append(row[inside].astype(np.int64) << 32 | f[at[inside]])
        if len(h) <= 1:
            break
    pairs, many = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    on = [many >= least for least in LEVELS]
    row = np.concatenate([pairs[x] >> 32 for x in on])
    feature = np.concatenate([(pairs[x] & 0xFFFFFFFF) * len(LEVELS) + level for level, x in enumerate(on)])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order]


def grouped(texts: Iterable) -> Iterator[list[bytes]]:
    """Lower-case bytes of texts, in order, in groups of about GROUP bytes."""
    group, size = [], 0
    for t in texts:
        group.append(t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"")
        size += len(group[-1])
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most `rows` labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # At most `rows` ids are broadcast; of repeated ids one text comes back, so the sample is bounded in rows.
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "text").distinct()


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every, size = np.arange(1 << BITS, dtype=np.int32), len(LEVELS) << BITS
    n = np.zeros((2, size), np.int64)
    for batch in batches:
        toxic, at = batch["toxic"].to_numpy(), 0
        for group in grouped(batch["text"]):
            row, feature = grams(group, every)
            kind = toxic[at + row]
            for c in (0, 1):
                n[c] += np.bincount(feature[kind == c], minlength=size)
            at += len(group)
    f = np.flatnonzero(n.sum(axis=0))
    yield pd.DataFrame({"feature": f, "clean": n[0, f], "toxic": n[1, f]})


def telling(train: DataFrame, clean: int, toxic: int) -> DataFrame:
    """(feature, toxic, clean): features that tell the classes apart, with the training rows of each class that have them."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(float(toxic)) - a, F.lit(float(clean)) - b
    chi = F.pow(a * d - b * c, 2) * (toxic + clean) / ((a + b) * F.greatest(F.lit(1.0), c + d) * toxic * clean)
    counts = train.mapInPandas(_counts, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((a + SMOOTHING) / (toxic + 2 * SMOOTHING)) - F.log((b + SMOOTHING) / (clean + 2 * SMOOTHING))
    return counts.where((F.col("clean") + F.col("toxic") >= LEAST_ROWS) & (chi >= SIGNIFICANT) & (F.abs(ratio) >= float(np.log(FACTOR)))).select("feature", "toxic", "clean")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(number of each hash or -1, weight by number and level, intercept)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    train = stored(training_rows(docs, labels, rows).repartition(cores), "training")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    wanted = np.full(1 << BITS, -1, np.int32)
    if not clean or not toxic:
        return wanted, np.zeros(len(LEVELS)), np.inf if toxic else -np.inf
    best = telling(train, clean, toxic).orderBy("feature").toPandas()  # at most one row per hash and level, some thousands as a rule
    feature = best["feature"].to_numpy(np.int64)
    p, q = best["toxic"].to_numpy(float) + SMOOTHING, best["clean"].to_numpy(float) + SMOOTHING
    ratio = np.log(p / (toxic + 2 * SMOOTHING)) - np.log(q / (clean + 2 * SMOOTHING))
    hashes = np.unique(feature // len(LEVELS))
    wanted[hashes] = np.arange(len(hashes), dtype=np.int32)
    # Levels of an n-gram that weren't kept have no column.
    column = np.full(len(hashes) * len(LEVELS), -1, np.int64)
    place = wanted[feature // len(LEVELS)].astype(np.int64) * len(LEVELS) + feature % len(LEVELS)
    column[place] = np.arange(len(feature))
    shared = docs.sparkSession.sparkContext.broadcast((wanted, column))

    def rows_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, column = shared.value
        for batch in batches:
            toxic, at = batch["toxic"].to_numpy(), 0
            for group in grouped(batch["text"]):
                row, feature = grams(group, wanted)
                row, feature = row[column[feature] >= 0], column[feature][column[feature] >= 0]
                cuts = np.searchsorted(row, np.arange(1, len(group)))
                yield pd.DataFrame({"toxic": toxic[at : at + len(group)], "features": [np.sort(x).astype("<i4").tobytes() for x in np.split(feature, cuts)]})
                at += len(group)

    got = train.mapInPandas(rows_of, "toxic int, features binary").toPandas()  # `rows` rows of the kept features that each has
    got = got.sort_values(["toxic", "features"], kind="stable")  # the order of rows doesn't depend on partitions
    each = [np.frombuffer(x, "<i4") for x in got["features"]]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    col = np.concatenate(each).astype(np.int64)
    w, intercept = chosen(row, col, got["toxic"].to_numpy(float), ratio)
    weights = np.zeros(len(column))
    weights[place] = w
    return wanted, weights, intercept


def chosen(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """The fit with the penalty that does best on every fourth row when fitted on the others; rows of a class follow each other."""
    apart = np.arange(len(y)) % 4 == 3
    losses = []
    if 0 < (y[apart] > 0).sum() < apart.sum() and 0 < (y[~apart] > 0).sum() < (~apart).sum():
        number = np.cumsum(~apart) - 1
        own = ~apart[row]
        for penalty in PENALTIES:
            w, intercept = logistic(number[row[own]], col[own], y[~apart], ratio, penalty)
            z = (np.bincount(row, w[col], minlength=len(y)) + intercept)[apart]
            losses.append(float((balanced(y[apart]) * np.logaddexp(0, np.where(y[apart] > 0, -z, z))).sum()))
    return logistic(row, col, y, ratio, PENALTIES[int(np.argmin(losses))] if losses else PENALTIES[len(PENALTIES) // 2])


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights of rows: both classes weigh alike in sum."""
    return np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))


def logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights (times ratio) and intercept: logistic loss of features scaled by ratio, with an L1 penalty, by accelerated proximal gradient steps."""
    share, scale, n = balanced(y), ratio[col], len(ratio)
    margin = lambda w: np.bincount(row, w[col] * scale, minlength=len(y)) + w[-1]
    loss = lambda z: (share * np.logaddexp(0, np.where(y > 0, -z, z))).sum()
    w = ahead = np.zeros(n + 1)
    t = curve = 1.0
    for _ in range(STEPS):
        z = margin(ahead)
        e = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope, here = np.append(np.bincount(col, e[row] * scale, minlength=n), e.sum()), loss(z)
        while True:  # until the step is short enough for the curvature
            new = ahead - slope / curve
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / curve, 0)
            step = new - ahead
            if loss(margin(new)) <= here + slope @ step + curve / 2 * (step @ step) + 1e-12:
                break
            curve *= 2
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t, curve = new, new + (t - 1) / later * (new - w), later, curve * 0.9
    return w[:-1] * ratio, float(w[-1])


def scorer(model: tuple[np.ndarray, np.ndarray, float], spark: SparkSession) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted, weights, intercept = shared.value
        for batch in texts:
            z = []
            for group in grouped(batch):
                row, feature = grams(group, wanted)
                z.append(np.bincount(row, weights[feature], minlength=len(group)) + intercept)
            z = np.concatenate(z) if z else np.zeros(0)
            with np.errstate(over="ignore"):
                yield pd.Series(1 / (1 + np.exp(-z)))

    return score


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with a column toxicity_score (underscores behind it if docs has one); the classifier is fitted on labels and docs."""
    spark = docs.sparkSession
    return spread(docs).withColumn(fresh(docs, "toxicity_score"), scorer(fit(docs, labels, rows), spark)(F.col("text")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic."""
    score = scorer(fit(docs, labels), docs.sparkSession)
    return spread(docs).where(score(F.col("text")) < 0.5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
