"""Sketches that are kept as binaries and merged later: distinct counts (HLL) and quantiles (KLL).

A day's sketch is made once, from that day's rows; any span of days is then a merge of small
binaries, whatever the number of rows behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct count, and items that a quantile sketch keeps per level.
LOG_BUCKETS, ITEMS = 12, 200
#: Bounds that hold with a chance over 0.999: three standard errors of an HLL, and a rank error of a KLL.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_BUCKETS / 2), 0.035


def sketched(rows: DataFrame, by: list[str], distinct: Column, value: Column) -> DataFrame:
    """Per `by`: members (HLL of `distinct`) and amounts (KLL of `value` in double precision), both binary; nulls are left out."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(distinct, LOG_BUCKETS).alias("members"), F.kll_sketch_agg_double(value.cast("double"), ITEMS).alias("amounts"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of `sketched` or of `merged`, put together per `by`."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("amounts", ITEMS).alias("amounts"))


def estimated(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """sketches with their distinct count (n_members), and a column per quantile, instead of the binaries."""
    found = [F.kll_sketch_get_quantile_double("amounts", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return sketches.select(*[c for c in sketches.columns if c not in ("members", "amounts")], F.hll_sketch_estimate("members").alias("n_members"), *found)
