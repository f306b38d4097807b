"""Writing results: JSON lines, partitions by status, one-row documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(status: Column) -> Column:
    """validated, rejected, or uncertain for the rest (unvalidated and null among them)."""
    return F.when(status.isin("validated", "rejected"), status).otherwise("uncertain")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; by default a run that already has data is refused."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_usage(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_partitioned(findings: DataFrame, path: str) -> None:
    """A folder for each of validated, rejected and uncertain."""
    findings.withColumn("bucket", bucket(F.col("validation_status"))).write.partitionBy("bucket").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON text, nested rows included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def cached_first(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """responses with is_cached, and the cached text where the key is known."""
    return responses.join(cache.select("cache_key", F.col("response").alias("cached_response")).dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("is_cached", F.col("cached_response").isNotNull())


def put_cache(entries: DataFrame, path: str, clear: bool = False) -> None:
    entries.write.mode("overwrite" if clear else "append").parquet(path)


def write_responses(responses: DataFrame, path: str, folders: int = 64) -> None:
    """Raw model responses (request_id and what else there is), dealt by a hash of the request over a fixed number of folders (part)."""
    part = F.pmod(F.xxhash64(F.col("request_id").cast("string")), F.lit(folders)).cast("int")
    responses.withColumn("part", part).repartition("part").write.mode("append").partitionBy("part").option("ignoreNullFields", "false").json(path)


def response_of(responses: DataFrame, request_id: str, folders: int = 64) -> DataFrame:
    """The rows of one request; only its folder is read."""
    part = F.pmod(F.xxhash64(F.lit(request_id)), F.lit(folders)).cast("int")
    return responses.where((F.col("part") == part) & (F.col("request_id").cast("string") == request_id))
