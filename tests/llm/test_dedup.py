import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, pq, simhash, suffixes


def classes(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(40)] + [(600, 500 + k) for k in range(50)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs + [(None, 1), (7, 7)], "a long, b long"), "a", "b").collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == classes(ids, [p for p in pairs if p[0] != p[1]])
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_covering_code():
    patterns, levels, begin = simhash.coset_patterns()
    weights = np.bitwise_count(patterns[begin[:-1]])
    assert len(patterns) == 44552 and weights.max() == 3 and (np.diff(begin) > 0).all()  # covering radius 3, every syndrome
    rng = np.random.default_rng(1)
    f = rng.integers(-(2**63), 2**63 - 1, 400)
    g = f.copy()
    for k in range(len(g)):
        for bit in rng.choice(64, 2, replace=False):
            g[k] ^= np.int64(np.uint64(1) << np.uint64(bit))
    row, anchor, home = simhash.anchors(f)
    assert home.sum() == len(f)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    row, anchor, _ = simhash.anchors(g)
    reached = set(zip(row.tolist(), anchor.tolist()))
    assert all((k, homes[k]) in reached for k in range(len(f)))


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Alpha", "beta", "É", "gamma", "delta", "x\x0by", "nb\xa0sp"]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    docs = []
    for k in range(90):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((k * 7 % 101, " ".join(t)))
    docs += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "one two"), (204, "one two"), (205, "a b " * 30_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(d).collect()]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(got) == sorted((i, prints[i], want[i]) for i, _ in docs)
    kept = simhash.without_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_simhash_without_ids(spark):
    """What only a row without id lies between is linked; an id with two texts is two nodes; no row is lost."""
    base = [f"w{k}" for k in range(300)]
    near = {}
    for k in range(300):  # texts one word apart, by their fingerprints
        t = " ".join([*base[:k], "other", *base[k + 1 :]])
        near.setdefault(simhash.fingerprint(t), t)
    fps = list(near)
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    a, b, c = next((x, y, z) for x in fps for y in fps for z in fps if x != y and y != z and far(x, y) <= 2 and far(y, z) <= 2 and far(x, z) > 2)
    rows = [(7, near[a]), (None, near[b]), (9, near[c]), (3, "one text of an id"), (3, "quite another text of that id"), (None, "no id at all here"), (None, "no id at all here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash")).withColumn("least", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(7, 7), (None, 7), (9, 7), (3, 3), (3, 3), (None, None), (None, None)], key=str)
    kept = simhash.without_near_duplicates(d)
    assert kept.columns == d.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), k, rng.randrange(9) or None) for k in range(500)]
    d = spark.createDataFrame(rows, "a int, b int, v int").withColumn("run_part", F.lit(1))
    got = {r.b: (r.n, r.s) for r in common.running(d, ["a", "b"], {"n": F.lit(1), "s": "v"}).collect()}
    n = s = 0
    for _, b, v in sorted(rows, key=lambda x: x[:2]):
        assert got[b] == (n, s)
        n, s = n + 1, s + (v or 0)
    assert common.running(d.limit(0), ["a", "b"], {"n": F.lit(1)}).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(0, 40))
        s = rng.integers(1, int(rng.integers(2, 5)), n)
        for depth in (1, 3, 4, 10, 50):
            r = suffixes.suffix_ranks(s, depth)
            parts = [tuple(s[i : i + depth]) for i in range(n)]
            assert all(r[i] < r[j] for i in range(n) for j in range(n) if parts[i] < parts[j])


def brute_removal(docs):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(4)
    words = ["the", "of", "inge", "tion", "a", "é", "xy"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(25) for _ in range(4)]
    docs = []
    for k in range(80):
        t = text(rng.randrange(30))
        if rng.random() < 0.6:
            t += " " + rng.choice(passages) + " " + text(rng.randrange(20))
        if rng.random() < 0.2 and docs:
            t = rng.choice(docs)[1]
        docs.append((k * 3 % 67, t))
    docs += [(1000, "a" * 49), (1001, "a" * 49), (1002, "b" * 50), (1003, "b" * 50), (1004, "c" * 300), (1005, "c" * 120), (1006, None), (1007, ""), (None, passages[0]), (1008, "q" * 25 + passages[0])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pack", F.lit(1))
    assert sorted([tuple(r) for r in suffixes.deduplicated(d, hot=hot).collect()], key=str) == brute_removal(docs)
    assert suffixes.deduplicated(d.limit(0)).count() == 0


def test_repeats_inside_documents(spark):
    """Texts that say one thing over and over: a context is sent once, its other places follow."""
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rule, ring, other = "-" * 700, line(61) * 12, line(90)
    docs = [(1, rule), (2, line(60) + rule + line(20) + rule[:300]), (3, ring + other), (4, line(30) + ring + ring[:200]), (5, ring[7:400] + line(9) + rule[:55]), (6, (other + "|") * 9), (7, other * 3), (8, rule * 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted([tuple(r) for r in suffixes.deduplicated(d).collect()], key=str) == brute_removal(docs)
    assert sorted([tuple(r) for r in suffixes.deduplicated(d.repartition(8), hot=1).collect()], key=str) == brute_removal(docs)


def test_contexts_of_one_byte_stay_small():
    import tracemalloc

    import pandas as pd

    n = 1 << 21
    raw = b"-" * (2 * n)
    pack = {"pack": "p", "bytes": suffixes._zip(np.frombuffer(raw, np.uint8)), "ends": np.array([n, 2 * n], "<i8").tobytes(), "ids": np.array([5, 6], "<i8").tobytes(), "known": np.array([1, 1], bool).tobytes()}
    h = np.unique(suffixes.Texts(pack).anchors()[0])
    shared = pd.DataFrame([{"hashes": suffixes._zip(suffixes._columns(h)), "hot": suffixes._zip(np.zeros(len(h), np.uint8))}])
    tracemalloc.start()
    out = suffixes._contexts(8)(("p",), pd.DataFrame([pack]), shared)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert sum(m for m in out["many"] if m > 0) <= n + 4 and sum(len(x) for x in out["data"]) < 1 << 23


def test_pq_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    vectors = [(k, (base[k % 60] + rng.normal(size=24) * rng.choice([0, 0.05, 0.3])).astype("float32").tolist(), int(k % 60) % 3) for k in range(400)]
    vectors += [(500, vectors[3][1], 1), (501, vectors[3][1], None), (502, None, 1), (503, [0.0] * 24, 1), (504, [float("nan")] + [1.0] * 23, 1), (505, [1.0, None], 1), (506, [], 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (508, [2.0, 4.0], 1)]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(d).collect())
    sound = [(k, i, np.array(v, float), l) for k, (i, v, l) in enumerate(vectors) if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = [(a, b) for a in sound for b in sound if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    n = {k: 0 for k in range(len(vectors))}
    for a, b in linked:
        n[a[0]] += 1
        n[b[0]] += 1
    comp = classes(sorted({v[0] for v in vectors}), [(a[1], b[1]) for a, b in linked])
    assert got == sorted((i, n[k], comp[i], comp[i] == i) for k, (i, _, _) in enumerate(vectors))
    assert pq.near_duplicates(d.limit(0)).count() == 0


def test_vectors_without_or_with_shared_ids(spark):
    """Links go through rows without ids; an id with two vectors is two; a group without ids has no component_id."""
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    far = [0.0, 0.0, 1.0]
    rows = [(7, turn(0.0), 1), (None, turn(0.15), 1), (3, turn(0.3), 1), (9, turn(1.5), 1), (9, far, 1), (None, turn(-2.0), 1), (None, turn(-2.05), 1), (4, turn(0.3), 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(d).collect()), key=str)
    assert got == sorted([(7, 1, 3, False), (None, 2, 3, False), (3, 1, 3, True), (9, 0, 9, True), (9, 0, 9, True), (None, 1, None, False), (None, 1, None, False), (4, 0, 4, True)], key=str)


def test_anchors_by_slices(monkeypatch):
    """Every string has one anchor, wherever the slices are cut, and the anchor depends on the string alone."""
    rng = random.Random(6)
    raw = bytes(rng.choice(b"ab c") for _ in range(3000))
    ends = np.array([10, 700, 1400, 3000], "<i8")
    raw = raw[:700] + raw[10:710] + raw[1400:]
    row = {"bytes": suffixes._zip(np.frombuffer(raw, np.uint8)), "ends": ends.tobytes(), "ids": np.arange(4).astype("<i8").tobytes(), "known": np.array([1, 1, 1, 0], bool).tobytes()}
    seen = []
    for size in (1 << 19, 97):
        monkeypatch.setattr(suffixes, "SLICE", size)
        found = {}
        for h, place, own, first, last in zip(*suffixes.Texts(row).anchors()):
            for start in range(first, last + 1):
                assert start not in found and start <= place <= start + 25
                found[start] = (int(h), int(place), int(own))
        seen.append(found)
    assert seen[0] == seen[1] and sorted(seen[0]) == list(range(10, 651)) + list(range(700, 1351))
    by = {}
    for start, (h, place, _) in seen[0].items():
        by.setdefault(raw[start : start + 50], set()).add((h, place - start))
    assert all(len(x) == 1 for x in by.values())


def test_anchors_of_texts_longer_than_a_slice(monkeypatch):
    """A place within a slice stands behind the hash in the same 64 bits; texts of several slices have the anchors that they have by short ones."""
    assert suffixes.SLICE + suffixes.WIDTH - 1 <= 1 << 64 - suffixes.HASH_BITS
    raw = np.random.default_rng(5).integers(97, 99, 200_000).astype(np.uint8)
    raw[70_000:140_000] = 97
    row = {"bytes": suffixes._zip(raw), "ends": np.array([66_000, 66_010, 200_000], "<i8").tobytes(), "ids": np.arange(3).astype("<i8").tobytes(), "known": np.ones(3, bool).tobytes()}
    seen = []
    for size in (suffixes.SLICE, 997):
        monkeypatch.setattr(suffixes, "SLICE", size)
        h, place, own, first, last = suffixes.Texts(row).anchors()
        many = last - first + 1
        seen.append(np.stack([np.repeat(h.astype(np.int64), many), np.repeat(place, many), np.repeat(own, many), np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)])]))
    assert (seen[0] == seen[1]).all() and seen[0].shape[1] == 66_000 - 49 + 133_990 - 49
