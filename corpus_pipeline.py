"""The corpus pipeline: toxic documents and near-copies go, personal data get pseudonyms,
sources are mixed to their weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the
columns of documents. A stage's output is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import delete, fresh, made, stored, table
from siltstone.llm.mixing import mixed_documents
from siltstone.llm.packing import packed_documents
from siltstone.llm.pii import pseudonymised
from siltstone.llm.similar import without_similar
from siltstone.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, calls toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, Jaccard similarity >= 0.8) the document with the smallest doc_id stays."""
    return without_similar(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts get pseudonyms; n_chars follows the new text."""
    count = fresh(docs, "pii_replaced")
    d = pseudonymised(docs, count=count)
    counted = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.withColumn("n_chars", counted).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packed_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds each
#: stage after the classifier against a plain version of it, and the classifier against labels of a held-out fold.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage kept for itself goes once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), len(made)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, made[before:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
