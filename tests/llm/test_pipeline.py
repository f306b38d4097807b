import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import packing, toxicity

from . import plain_pii
from .test_dedup import classes
from .test_similar import alike, brute_set


def plain_mix(rows):
    """How often each doc_id is taken, from (doc_id, text, source) with distinct ids: weights 5, 2, 1, 150 %, at most twice."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = {}
    for k, t, s in rows:
        by.setdefault(s, []).append((int(md5(f"{k}:mix-1:{md5(t)}:0")[:15], 16), k, len(t.split())))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for *_, n in by[s]) for s in order}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    while free := [s for s in order if s not in target]:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in full} if full else share
        left -= sum(2 * size[s] for s in full)
    out = Counter()
    for s in order:
        whole, rest = divmod(int(target[s] + 1e-9), size[s])
        for _, k, n in sorted(by[s]):
            out[k] += whole + (rest > 0 and min(n, rest) * 2 >= n)
            rest -= n
    return +out


def corpus(tmp_path, spark):
    rng = random.Random(9)
    words = ["the", "thion", "erly", "and", "ouble", "nder", "anst", "wher"]
    docs, labels = [], []
    for k in range(400):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if k % 5 == 0:
            t.insert(3, "idiot")
        if k % 7 == 0:
            t += ["4785380592391139"]
        text = " ".join(t) if k % 11 or not docs else docs[-1][1]
        docs.append((k, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((k, 1, int("idiot" in text)))
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_stages_take_effect(spark, tmp_path):
    folder, docs = corpus(tmp_path, spark)
    d = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["toxicity", "simhash", "pii", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at = f"file://{tmp_path}/{name}"
        d.write.parquet(at)
        d = spark.read.parquet(at)
        seen[name] = {r.doc_id: r for r in d.collect()}
    toxic = {k for k, t, *_ in docs if "idiot" in t}
    held = {k for k, *_ in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    left = set(seen["toxicity"])
    assert not left & (toxic - held) and len(left & toxic) <= 2 and {k for k, *_ in docs} - toxic <= left
    # From here on every stage against a plain version of it, over what the stage before it kept.
    sets = {k: brute_set(r.text) for k, r in seen["toxicity"].items()}
    near = classes(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert set(seen["simhash"]) == set(near.values())
    plain = {k: plain_pii.pseudonymised(r.text)[0] for k, r in seen["simhash"].items()}
    assert {k: r.text for k, r in seen["pii"].items()} == plain and all(r.n_chars == len(r.text) for r in seen["pii"].values()) and not any("4785380592391139" in t for t in plain.values())
    mixed = spark.read.parquet(f"file://{tmp_path}/mixing")
    assert Counter(r.doc_id for r in mixed.collect()) == plain_mix([(k, r.text, r.source) for k, r in seen["pii"].items()])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = sorted(tuple(r) for r in packing.pieces(mixed).collect())
    assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want
    assert set(seen["mixing"]) <= set(seen["pii"]) and toxicity.FOLDS == 5 and got.where(F.col("offset") + F.col("length") > 4096).count() == 0
