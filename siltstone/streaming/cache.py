"""A cache of requests over a stream: a key that was seen before is a hit, across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def hits(requests: DataFrame, key: str, order: str, time: str = "ts", ttl: str = "30 days", late: str = "1 day", name: str = "is_cached") -> DataFrame:
    """The columns key, order and time of a stream of requests, with `name`: true if an earlier request had the same key.

    A batch's requests of a key are taken by time and order. State is a time per key: that of
    its last request. A key whose last request is older than `ttl` is forgotten (as soon as
    the watermark, `late` behind the newest request, has passed that time, its state goes), so
    its next request isn't a hit. Null keys are one key; a request without a time is left out.
    """
    keep = pd.Timedelta(ttl)
    own = requests.where(F.col(time).isNotNull()).select(F.col(key), F.col(order), F.col(time).cast("timestamp").alias(time)).withWatermark(time, late)
    out = StructType([*own.schema.fields, StructField(name, BooleanType())])

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, order])  # one key's requests in one batch
        seen = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        told = []
        for at in rows[time]:
            told.append(seen is not None and at - seen <= keep)
            seen = at if seen is None else max(seen, at)
        state.update((int(seen.value // 1000),))
        state.setTimeoutTimestamp(max(int((seen + keep).value // 10**6), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(**{name: told})

    return own.groupBy(key).applyInPandasWithState(step, out, StructType([StructField("seen_us", LongType())]), "append", GroupStateTimeout.EventTimeTimeout)
