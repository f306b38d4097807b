"""Running totals over all rows of a table, in any order, without a window that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """df with, per entry of sums, the total of a value over all rows before this one in `order`.

    Rows are range-sorted and stored; totals of the ranges (one row each) are summed, then the
    rows of a range, so no task sees more than a range. order must tell rows apart. Values are
    taken as they are (null counts as 0).
    """
    value = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    part = "run_part"
    while part in df.columns:
        part += "_"
    d = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    zero = {k: F.coalesce(v, F.lit(0)) for k, v in value.items()}
    totals = d.groupBy(part).agg(*[F.sum(v).alias(f"{k}_t") for k, v in zero.items()])
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    begin = totals.select(F.col(part), *[F.coalesce(F.sum(f"{k}_t").over(w), F.lit(0)).alias(f"{k}_b") for k in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(F.broadcast(begin), part)
    return out.select(*df.columns, *[(F.col(f"{k}_b") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in zero.items()])
