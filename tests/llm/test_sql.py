"""Corpus queries with SQL against another engine, over the smallest tables; and cases that every operator defines."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import registry
from siltstone.llm.mixing import words

from ..test_queries import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    assert rows(registry.queries()[name](spark, FOLDER).toPandas()) == rows(db.execute(registry.oracle_sql()[name]).df())


def written(spark, tmp_path, documents, labels=(), name="in"):
    """A folder of tables with columns that stages might use for themselves."""
    at = f"file://{tmp_path}/{name}"
    kept = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string, pii_replaced string, mx_key string, fp string"
    d = spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c", "d") for i, t, s in documents], kept)
    d.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, d


LONG = " ".join(f"w{k * 7919 % 10007}" for k in range(60_000))
CASES = [(1, None, "a"), (2, "", "a"), (None, "only one of its kind without a name", None), (None, "another one that nobody named at all", "b"), (3, "two texts share this one number here", "b"), (3, "and this is the other one of them", "b"), (4, LONG, "c"), (5, LONG + " end", "c"), (6, "said twice by one and the same row", "a"), (6, "said twice by one and the same row", "a"), (7, "said twice by one and the same row", "a")]


def test_stages_keep_what_is_clean(spark, tmp_path):
    """Null ids and texts, an id with two texts, very long texts, ties, repeated rows and clashing columns, stage by stage."""
    import corpus_pipeline as p

    at, d = written(spark, tmp_path, CASES)
    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    every = sorted((i if i is not None else -1, t or "") for i, t, _ in CASES)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, d, at).columns == d.columns, name
    assert texts(p.toxicity(spark, d, at)) == every  # nobody labelled anything toxic
    left = texts(p.simhash(spark, d, at))
    assert left == sorted([(1, ""), *[x for x in every if x[0] in (-1, 3)], (4, LONG), (6, CASES[8][1])])
    masked = p.pii(spark, d, at)
    assert texts(masked) == every and masked.where("toxicity_score <> 'a' OR pii_replaced <> 'b' OR mx_key <> 'c' OR fp <> 'd'").count() == 0
    mixed = p.mixing(spark, d, at)
    n = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(words(F.col("text"))).alias("n")).collect()}
    size = {s: sum(len((t or "").split()) for _, t, x in CASES if x == s) for s in (None, "a", "b", "c")}
    assert all(n.get(s, 0) <= 2 * size[s] for s in size)
    rows_ = p.packing(spark, d, at).collect()
    assert len({(r.sequence_id, r.offset) for r in rows_}) == len(rows_) and sum(1 for r in rows_ if r.piece == 0) == len(CASES)


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    at, d = written(spark, tmp_path, [])
    for _, stage in p.STAGES:
        assert stage(spark, d, at).count() == 0
    assert p.run(spark, at).count() == 0
