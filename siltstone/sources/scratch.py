"""The folder that driver and executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, oldest first.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset a folder of this machine will do only for a local master; a cluster
    must name a shared one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    A lost executor costs nothing but the tasks it ran, and later reads prune columns.
    options: of the writer.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for joins that deal both sides out by key, unless the other side is to be broadcast.

    Spark takes a table's size on disk for its size in memory. Texts, names and line numbers
    that repeat are a tenth of it or less there (Parquet's dictionaries, zstd), and columns made from
    a key have no size at all, so such a table would go through the driver whole.
    """
    return df.hint("merge")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in made:
            made.remove(path)


def write_files(spark: SparkSession, root: str, files: dict[str, str]) -> str:
    """A few small text files below root (driver side; fixtures and reports); gives root."""
    for name, text in files.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
    return root
