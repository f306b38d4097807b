"""Windows of a stream: sessions close behind the watermark, late rows are left out, a restart goes on."""

import datetime as dt

from siltstone.streaming.usage import event_stream, run_once, sessions

SCHEMA = "user_id long, ts timestamp, value double"
DAY = dt.datetime(2024, 1, 1)


def put(spark, at, rows):
    at_minute = lambda m: DAY + dt.timedelta(minutes=m)
    spark.createDataFrame([(u, at_minute(m), float(v)) for u, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(at)


def test_sessions_of_a_stream(spark, tmp_path):
    at, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run():
        run_once(sessions(event_stream(spark, at, SCHEMA), gap="10 minutes", late="20 minutes"), out, state)

    put(spark, at, [(1, 0, 1), (1, 5, 2), (2, 3, 4), (1, 30, 8)])
    run()
    put(spark, at, [(2, 100, 1)])  # the watermark moves to minute 80
    run()
    put(spark, at, [(1, 7, 100), (1, 79, 3), (1, 95, 5)])  # minute 7 is late: its session was given; 79 is within its end
    run()
    put(spark, at, [(3, 300, 1)])
    run()
    run()
    got = sorted((r.user_id, int((r.begin - DAY).total_seconds() // 60), int((r.last - DAY).total_seconds() // 60), r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got[:3] == [(1, 0, 5, 2, 3.0), (1, 30, 30, 1, 8.0), (1, 79, 79, 1, 3.0)] and (2, 100, 100, 1, 1.0) in got and (2, 3, 3, 1, 4.0) in got and (1, 95, 95, 1, 5.0) in got
    assert sum(r[4] for r in got) == 1 + 2 + 8 + 4 + 1 + 3 + 5  # the late hundred isn't in any


def test_sessions_at_rest(spark, tmp_path):
    at = f"file://{tmp_path}/in"
    put(spark, at, [(1, 0, 1), (1, 9, 2), (1, 25, 4), (None, 1, 8), (None, 2, 8)])
    got = sorted(((r.user_id, r.n, r.total) for r in sessions(spark.read.parquet(at), gap="10 minutes").collect()), key=str)
    assert got == [(1, 1, 4.0), (1, 2, 3.0), (None, 2, 16.0)]
    assert sessions(spark.read.parquet(at).limit(0)).count() == 0


def test_cache_over_restarts(spark, tmp_path):
    """A key seen before a restart is a hit after it; one that wasn't asked for longer than the ttl is not."""
    from siltstone.streaming.cache import hits

    at, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    kind = "k string, n long, ts timestamp"

    def run(rows):
        spark.createDataFrame([(k, n, DAY + dt.timedelta(hours=h)) for k, n, h in rows], kind).coalesce(1).write.mode("append").parquet(at)
        run_once(hits(event_stream(spark, at, kind), "k", "n", ttl="10 hours", late="1 hour"), out, state)

    run([("a", 1, 0), ("a", 2, 0), ("b", 3, 1), (None, 4, 1)])
    run([("a", 5, 2), ("c", 6, 2), (None, 7, 2)])
    run([("z", 8, 40)])
    run([("a", 9, 41), ("b", 10, 41), ("b", 11, 42)])
    got = {r.n: r.is_cached for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False, 9: False, 10: False, 11: True}
