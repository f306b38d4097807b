"""Hard negatives against brute force: ties, hot labels, norms of all sizes, numbers that doubles can't hold."""

import random

import numpy as np
import pytest

from siltstone.llm import negatives
from siltstone.llm.negatives import hard_negatives, op12_negatives

KIND = "vec_id long, label string, vector array<long>, anchor boolean"


def brute(rows, k=5, n=10, low=30, high=90, of=100):
    """rows: (id, label, vector, anchor). Rows of a null id come last among ties."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, label, v, anchor) in enumerate(rows):
        if not anchor:
            continue
        same = sorted(((score(v, r[2]), r[0]) for j, r in enumerate(rows) if j != i and r[1] == label), key=by)[:k]
        other = sorted(((score(v, r[2]), r[0]) for r in rows if r[1] != label), key=by)
        for p, p_id in same:
            got = [(s, b) for s, b in other if low * p <= of * s <= high * p][:n]
            out += [(a, p_id, m, b, p, s) for m, (s, b) in enumerate(got, 1)]
    return sorted(out, key=str)


def answer(d, **how):
    return sorted(map(tuple, hard_negatives(d, **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed, monkeypatch):
    """Shelves of 64 rows and buckets of 8, so that there are many rounds; a label holds most rows."""
    monkeypatch.setattr(negatives, "SHELF", 1)
    monkeypatch.setattr(negatives, "BUCKET", 8)
    monkeypatch.setattr(negatives, "PART", 7)
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        size = rng.choice([1, 1, 3, 20, 100])
        v = [rng.randint(-size, size) + size // 3 for _ in range(rng.choice([4, 4, 4, 3, 0]))]
        rows.append((i, rng.choice("aaaaabc"), v, i % 20 == 0))
    assert answer(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_ties_repeats_and_nulls(spark):
    rows = [(100, "a", [1, 2], True)] * 2 + [(i, "a", [1, 2], False) for i in range(8)] + [(None, "a", [5, 5], True), (None, "b", [1, 1], False)]
    rows += [(i, "b", [1, 1], False) for i in range(30, 18, -1)] + [(50, None, [9, 9], True), (51, "b", None, True), (52, "b", [1, None], True), (53, "c", [], True), (54, "c", [0, 0], True)]
    got = answer(spark.createDataFrame(rows, KIND))
    assert got == brute(rows) and any(x[0] == 53 for x in got)  # a score of 0 has the window 0 to 0


def test_large_numbers(spark):
    big = 2**52 + 1
    rows = [(0, "a", [big, 3], True), (1, "a", [5, 1], False), (2, "a", [4, 0], False), (3, "b", [3, 1], False), (4, "b", [3, 2], False), (5, "b", [2, 0], False), (6, "b", [big, big], False)]
    assert answer(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_other_limits_and_nothing(spark):
    rows = [(i, "ab"[i % 2], [i, 3], i % 10 == 0) for i in range(60)]
    how = {"positives": 2, "negatives": 3, "low": 1, "high": 2, "of": 3}
    assert answer(spark.createDataFrame(rows, KIND), **how) == brute(rows, 2, 3, 1, 2, 3)
    assert answer(spark.createDataFrame([], KIND)) == []
    assert answer(spark.createDataFrame([(1, "a", [1], False)], KIND)) == []


def test_short_rows_are_not_compared(spark, monkeypatch):
    """Rows that are too short for every window are in shelves that no group meets."""
    monkeypatch.setattr(negatives, "SHELF", 1)
    kept = []
    keep = negatives.stored
    monkeypatch.setattr(negatives, "stored", lambda d, name, **o: (kept.append((name, keep(d, name, **o))), kept[-1][1])[1])
    rng = random.Random(9)
    rows = [(i, "ab"[i % 2], [100 + rng.randint(0, 20), rng.randint(-50, 50)], i % 10 == 0) for i in range(100)]
    rows += [(1000 + i, "ab"[i % 2], [rng.randint(-9, 9), 1], False) for i in range(2000)]
    assert answer(spark.createDataFrame(rows, KIND)) == brute(rows)
    met = [d.agg({"shelf": "max"}).first()[0] for name, d in kept if name == "todo"]
    shelves = [d.agg({"shelf": "max"}).first()[0] for name, d in kept if name == "tops"]
    assert max(x for x in met if x is not None) < max(shelves) / 4


def test_query_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype("float32").tolist(), int(rng.integers(0, 10))) for i in range(400)]
    rows += [(500, None, 1), (600, [float("nan"), 1.0, 1.0, 1.0], 1), (700, [float("inf"), 1.0, 1.0, 1.0], 1), (800, [1.0, None, 1.0, 1.0], 2), (900, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS rid", "'y' AS g").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    sound = lambda v: v is not None and None not in v and np.isfinite(v).all()
    plain = [(i, None if y is None else str((y + 1) % 10 if i is not None and i % 7 == 0 else y), [int(np.floor(256 * x)) for x in v] if sound(v) else None, i is not None and i % 100 == 0) for i, v, y in rows]
    assert sorted(map(tuple, op12_negatives(spark, f"file://{tmp_path}").collect()), key=str) == brute(plain)
