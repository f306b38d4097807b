"""Shared helpers of the corpus operators: table access, shared scratch tables, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running  # noqa: F401
from ..sources.scratch import delete, made, new_path, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for a table that is one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Names a row by its content, so that it can be found again.
KEY = "_row_key"


def with_key(docs: DataFrame) -> DataFrame:
    """docs with KEY: from doc_id, text and a hash of all columns but maps."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    return docs.withColumn(KEY, F.concat_ws(":", F.md5("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(hashed)))


def least_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs that each component of found (KEY, doc_id, fp, component) keeps.

    It is the one with the least doc_id (null comes last), then the least fp, then the least
    KEY. So a component without ids keeps a row too, and rows that share a doc_id stay if their
    components differ. Rows that are equal throughout are one.
    """
    keep = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", KEY))[KEY].alias(KEY)).select(KEY).distinct()
    return docs.join(keep, KEY, "left_semi").dropDuplicates([KEY])


def components(edges: DataFrame, a: str, b: str, per_part: int | None = None) -> DataFrame:
    """Connected components of an undirected edge list of long ids: (node, component).

    Alternating large and small stars: every round joins each edge to the least neighbour of
    one end, so the edge count never grows and a round is two shuffles. The least
    neighbours are stored before they are joined, so that both sides of the join are plain
    shuffles and AQE can split a hub. component is the least node of the component; nodes
    without an edge (or with null ends, or only a loop) are not in the result.

    per_part: edges of a partition, about. A few edges in very many partitions are else as many
    files of each of a round's shuffles.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(lo.alias("u"), hi.alias("v")).where("u < v").distinct().checkpoint()
    seen, few = None, lambda d: d
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        if per_part:
            few = lambda d, n=1 + state[0] // per_part: d.coalesce(n)
            e = few(e)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = few(least).checkpoint()
        large = few(both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()).checkpoint()
        least = few(large.groupBy("v").agg(F.min("u").alias("m"))).checkpoint()
        star = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("x"))
        e = few(star.select("x.u", "x.v").where("u < v").distinct()).checkpoint()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
