import random

import pytest

import corpus_pipeline
from siltstone.llm import similar

from .test_dedup import classes


def brute_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8


def edited(rng, words, base, n):
    t = list(base)
    for _ in range(n):
        t[rng.randrange(len(t))] = rng.choice(words)
    return " ".join(t)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("hot", [False, True])
def test_stage_against_brute_force(spark, hot):
    """Pairs of a similarity of 0.8 or more meet, also where many copies of one text meet and most pairs are below it."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(1 if hot else 30)]
    docs = [(k * 7 % 307, edited(rng, words, rng.choice(base), rng.randrange(6))) for k in range(250)]
    docs += [(400, None), (401, ""), (402, " \t"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "a b c d e " * 20_000)]
    sets = {i: brute_set(t) for i, t in docs}
    want = classes(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA)
    got = corpus_pipeline.simhash(spark, d, "")
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert corpus_pipeline.simhash(spark, d.limit(0), "").count() == 0
    assert len(set(want.values())) < len({t for _, t in docs})


def test_rows_without_or_with_shared_ids(spark):
    """A group without ids keeps a row, a null id comes last and still joins a group, rows that share an id stay if their texts differ."""
    base = [f"w{k}" for k in range(100)]
    text = lambda n, at: " ".join(base[:at] + ["new"] * n + base[at + n :])
    a, b, c = text(0, 0), text(1, 50), text(2, 50)
    rows = [(None, "alone in this table of few rows"), (None, b), (7, a), (9, c), (5, "one text under the id five here"), (5, "quite another text under that same id"), (None, "twice without any id at all"), (None, "twice without any id at all"), (2, " ".join(base[::-1])), (2, a)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash(spark, d, "").collect()), key=str)
    assert got == sorted([rows[0], (2, a), rows[4], rows[5], rows[6], rows[8]], key=str)
