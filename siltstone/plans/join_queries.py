"""Queries of the joins that are no equi-joins, of recursive callers, and of mergeable sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, sketches, symbols
from ..sources.scratch import apart, stored
from ..sources.tables import spread, table
from .registry import query


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS previous_id FROM events WHERE ts IS NOT NULL GROUP BY ALL)
SELECT e.event_id, e.user_id, p.previous_id, epoch_us(e.ts) - epoch_us(p.ts) AS gap_us FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""")
def previous_event(spark: SparkSession, d: str) -> DataFrame:
    """2.12 as-of join: the user's latest earlier event of every event."""
    e = spread(table(spark, d, "events").select("event_id", "user_id", "ts"))
    x = joins.as_of(e, e, ["user_id"], "ts", "ts", ties=["event_id"], strict=True)
    return x.select("event_id", "user_id", F.col("last.event_id").alias("previous_id"), F.expr("timestampdiff(MICROSECOND, last.ts, ts)").alias("gap_us"))


_SENT = "sent AS (SELECT o_custkey AS c, l_shipdate AS ts, max((l_orderkey, l_linenumber)) AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"""WITH {_SENT}
SELECT o_orderkey, struct_extract_at(s.line, 1) AS sent_order, struct_extract_at(s.line, 2) AS sent_line FROM orders ASOF LEFT JOIN sent s ON o_custkey = s.c AND o_orderdate >= s.ts""")
def shipped_before_order(spark: SparkSession, d: str) -> DataFrame:
    """2.12 as-of join of two tables: for every order the line last shipped to its customer up to the order's date."""
    o = apart(spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c")), "l_orderkey")
    x = joins.as_of(o.withColumn("c", F.col("o_custkey")), lines, ["c"], "o_orderdate", "l_shipdate", ties=["l_orderkey", "l_linenumber"])
    return x.select("o_orderkey", F.col("last.l_orderkey").alias("sent_order"), F.col("last.l_linenumber").alias("sent_line"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderdate AS ts, max(o_orderkey) AS k FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL)
SELECT e.event_id, o.k AS o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.c AND e.ts >= o.ts""")
def order_at_event(spark: SparkSession, d: str) -> DataFrame:
    """2.12 as-of join: the latest order, at the time of every event, of the customer who is its user."""
    e, o = spread(table(spark, d, "events").select("event_id", "user_id", "ts")), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    x = joins.as_of(e, o.withColumn("user_id", F.col("o_custkey")), ["user_id"], "ts", "o_orderdate", ties=["o_orderkey"])
    return x.select("event_id", "last.o_orderkey")


@query("""WITH w AS (SELECT epoch_us(ts) // 1000000 AS a FROM events WHERE event_type = 'purchase')
SELECT event_id, count(*) AS n_windows FROM events JOIN w ON epoch_us(ts) // 1000000 BETWEEN a AND a + 900 GROUP BY event_id""")
def events_in_windows(spark: SparkSession, d: str) -> DataFrame:
    """2.12, J2 intervals by bins, one key for all rows: how many quarters of an hour after a purchase hold each event."""
    e = spread(table(spark, d, "events").select("event_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) DIV 1000000").alias("s")))
    w = e.where("event_type = 'purchase'").select("s")
    x = joins.holding(e.select("event_id", "s"), w, [], F.col("s"), (F.col("s"), F.col("s") + 900))
    return x.groupBy("l.event_id").agg(F.count("*").alias("n_windows"))


_OPEN = "o AS (SELECT o_orderkey AS k, o_custkey AS c, datediff('day', DATE '1970-01-01', o_orderdate) AS a, max(datediff('day', DATE '1970-01-01', l_shipdate)) AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"WITH {_OPEN} SELECT x.k AS first_order, y.k AS second_order, least(x.z, y.z) - greatest(x.a, y.a) AS days FROM o x JOIN o y ON x.c = y.c AND x.k < y.k AND x.a <= y.z AND y.a <= x.z AND x.a <= x.z AND y.a <= y.z")
def open_together(spark: SparkSession, d: str) -> DataFrame:
    """2.12 interval-overlap join: orders of a customer that were open at once, and for how many days."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("z"))
    o = apart(table(spark, d, "orders")).join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), day("o_orderdate").alias("a"), "z")
    o = stored(o, "open")
    span = (F.col("a"), F.col("z"))
    x = joins.overlaps(o, o, ["c"], span, span).where("l.k < r.k")
    return x.select(F.col("l.k").alias("first_order"), F.col("r.k").alias("second_order"), (F.least("l.z", "r.z") - F.greatest("l.a", "r.a")).alias("days"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem)
SELECT x.k AS first_order, y.k AS second_order, count(*) AS shared FROM b x JOIN b y ON x.p = y.p AND x.k < y.k GROUP BY ALL HAVING count(*) >= 2""")
def similar_baskets(spark: SparkSession, d: str) -> DataFrame:
    """2.12, J15 set-overlap join: orders that share two parts or more."""
    b = stored(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")), "baskets")
    x = joins.sharing(b, b.withColumnRenamed("l_orderkey", "other"), "l_orderkey", "other", "parts", "parts", 2)
    return x.where("l_orderkey < other").select(F.col("l_orderkey").alias("first_order"), F.col("other").alias("second_order"), F.col("shared").cast("long").alias("shared"))


_TREE = "e AS (SELECT DISTINCT 'C' || (l_partkey % 7) AS caller_class, 'n' || (l_partkey % 600) AS caller_method, 'n' || (CASE WHEN l_partkey % 600 = 0 AND l_linenumber = 1 THEN 599 ELSE (l_partkey % 600) // 2 END) AS callee_method FROM lineitem)"


@query(f"""WITH RECURSIVE {_TREE}, r(method, here, caller_class, caller_method, depth) AS (
SELECT callee_method, caller_method, caller_class, caller_method, 0 FROM e UNION
SELECT r.method, e.caller_method, e.caller_class, e.caller_method, r.depth + 1 FROM r JOIN e ON e.callee_method = r.here WHERE r.depth < 40)
SELECT method, CAST(min(depth) AS INTEGER) AS depth, caller_class, caller_method FROM r GROUP BY method, caller_class, caller_method""")
def callers_any_depth(spark: SparkSession, d: str) -> DataFrame:
    """Callers of every method at any depth, over a graph with cycles; each at its least depth."""
    k = F.col("l_partkey") % 600
    callee = F.when((k == 0) & (F.col("l_linenumber") == 1), F.lit(599)).otherwise(F.floor(k / 2)).cast("string")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("C"), (F.col("l_partkey") % 7).cast("string")).alias("caller_class"), F.concat(F.lit("n"), k.cast("string")).alias("caller_method"), F.concat(F.lit("n"), callee).alias("callee_method"))
    return symbols.all_callers(e, e.select(F.col("callee_method").alias("method")))


_KLL = {"low": 0.25, "middle": 0.5, "high": 0.75}


@query("""SELECT event_type, count(DISTINCT user_id) AS users, true AS users_near, true AS low_near, true AS middle_near, true AS high_near FROM events GROUP BY event_type""")
def merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """2.12 sketches: users (HLL) and values (KLL) per type, merged of one sketch per day; and whether they keep their error bounds against exact figures."""
    e = table(spark, d, "events").select("event_type", "user_id", "value", F.to_date("ts").alias("day"))
    days = stored(sketches.sketched(e, ["event_type", "day"], F.col("user_id"), F.col("value")), "sketches")
    found = sketches.estimated(sketches.merged(days, ["event_type"]), _KLL).withColumnRenamed("event_type", "kind")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("value").alias("n"))
    # The exact rank of each estimated quantile: rows up to it.
    below = e.join(F.broadcast(found), F.col("event_type") == F.col("kind")).groupBy("event_type").agg(*[F.struct(F.count_if(F.col("value") < F.col(q)).alias("less"), F.count_if(F.col("value") <= F.col(q)).alias("upto")).alias(q) for q in _KLL])  # a row per type
    x = exact.join(below, "event_type").join(found.select("kind", "n_members"), F.col("event_type") == F.col("kind"))
    near = lambda q: (F.col(f"{q}.less") / F.col("n") - sketches.RANK_ERROR <= _KLL[q]) & (F.col(f"{q}.upto") / F.col("n") + sketches.RANK_ERROR >= _KLL[q])
    return x.select("event_type", "users", (F.abs(F.col("n_members") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.DISTINCT_ERROR)).alias("users_near"), *[near(q).alias(f"{q}_near") for q in _KLL])
