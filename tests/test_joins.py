"""Joins that are no equi-joins, against brute force; hot keys are spread, and few rows are compared."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import joins, sketches, symbols
from siltstone.plans import join_queries


def brute_as_of(left, right, strict):
    """left: (key, time, id), right: the same. The latest row of right by time, then id."""
    out = []
    for k, t, i in left:
        fit = [(rt, ri) for rk, rt, ri in right if None not in (k, t, rt) and rk == k and (rt < t if strict else rt <= t)]
        out.append((k, t, i, max(fit)[1] if fit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    """A hot key over all ranges, ties on both sides, nulls, repeated rows, keys of one side only."""
    rng = random.Random(3)
    row = lambda i: (rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(200)]), i)
    left, right = [row(i) for i in range(900)], [row(i) for i in range(300)]
    left += left[:5] + [("left only", 3, 1), ("hot", -1, 2)]
    right += [("right only", 3, 1)]
    kind = "k string, t int, i int"
    got = joins.as_of(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["k"], "t", "t", ties=["i"], strict=strict)
    assert got.columns == ["k", "t", "i", "last"]
    assert sorted(map(tuple, got.select("k", "t", "i", "last.i").collect()), key=str) == brute_as_of(left, right, strict)


def test_as_of_spreads_a_hot_key(spark, request):
    """The last row before a range comes from another range; nothing is dealt by key alone."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a small table is one range
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    left = spark.range(20_000).select(F.lit("x").alias("k"), (F.col("id") + 10).alias("t"))
    right = spark.createDataFrame([("x", 5, "early"), ("x", 15_000, "late")], "k string, t long, v string")
    got = joins.as_of(left, right, ["k"], "t", "t")
    assert {r.v: r.n for r in got.groupBy("last.v").agg(F.count("*").alias("n")).collect()} == {"early": 14_990, "late": 5_010}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert joins.as_of(left.limit(0), right, ["k"], "t", "t").count() == 0 and joins.as_of(left, right.limit(0), ["k"], "t", "t").where("last IS NULL").count() == 20_000


def test_as_of_sorts_no_stored_rows_for_the_ends_of_ranges(spark):
    """A maximum over structs would sort whatever a task reads."""
    left, right = spark.range(50).select("id", F.lit("k").alias("k")), spark.range(50).select("id", F.lit("k").alias("k"))
    got = joins.as_of(left, right, ["k"], "id", "id", ties=["id"])
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("last.id = id").count() == 50


def test_orders_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Their size on disk is a small part of that in memory."""
    spark.range(40).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(80).selectExpr("id % 40 AS l_orderkey", "1 AS l_linenumber", "TIMESTAMP_NTZ '2020-01-02 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    met = []
    for name in ("as_of", "overlaps"):
        monkeypatch.setattr(joins, name, lambda left, right, *rest, f=getattr(joins, name), **more: met.append(right) or f(left, right, *rest, **more))
    monkeypatch.setattr(join_queries, "stored", lambda df, name: df)
    assert join_queries.shipped_before_order(spark, str(tmp_path)).where("sent_order IS NULL").count() == 40
    assert join_queries.open_together(spark, str(tmp_path)).count() == sum(len(range(k, 40, 3)) * (len(range(k, 40, 3)) - 1) // 2 for k in range(3))
    assert len(met) == 2 and not any("Broadcast" in d._jdf.queryExecution().executedPlan().toString() for d in met)


@pytest.mark.parametrize("top", [0, 2, 5])
def test_overlaps(spark, top):
    rng = random.Random(top)

    def rows(n):
        out = []
        for i in range(n):
            a = rng.randint(-300, 3000)
            out.append((rng.choice(["f", "f", "g", None]), rng.choice([a, a, a, None]) if i % 20 == 0 else a, a + rng.choice([0, 0, 1, 5, 15, 16, 17, 300, 5000, -1]), i))
        return out

    left, right = rows(200), rows(150)
    kind = "k string, a int, z int, i int"
    span = (F.col("a"), F.col("z"))
    want = sorted((x[3], y[3]) for x in left for y in right if None not in (x[0], x[1], y[1]) and x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    got = joins.overlaps(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["k"], span, span, top)
    assert sorted(map(tuple, got.select("l.i", "r.i").collect())) == want
    points = spark.createDataFrame(left, kind)
    held = joins.holding(points, spark.createDataFrame(right, kind), ["k"], F.col("a"), span, top)
    assert sorted(map(tuple, held.select("l.i", "r.i").collect())) == sorted((x[3], y[3]) for x in left for y in right if None not in (x[0], x[1], y[1]) and x[0] == y[0] and y[1] <= x[1] <= y[2])


def test_one_hot_file(spark):
    """200,000 hits and 20,000 spans of one file: lines and spans meet in bins, not all with all."""
    hits = spark.range(200_000).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"))
    spans = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("class_ord"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") * 10 + 1).alias("start_line"), (F.col("id") * 10 + 8).alias("end_line"))
    got = symbols.at_line(hits, spans, order=("class_ord",))
    assert got.where("symbol IS NULL").count() == 40_000
    assert got.where(F.col("symbol") != F.concat(F.lit("s"), F.floor((F.col("line_no") - 1) / 10).cast("string"))).count() == 0
    points = joins._bins(hits, ["file"], F.col("line_no"), F.col("line_no"), 5, "l", True, True)
    met = points.join(joins._bins(spans, ["file"], F.col("start_line"), F.col("end_line"), 5, "r", False, True), ["k0", "level", "bin"])
    assert met.count() < 20 * 200_000  # of 4 * 10^9


def test_sharing(spark):
    rng = random.Random(2)
    sets = lambda n: [(i, [rng.choice([None, *"abcdefghijklmnopqrst"[: rng.choice([4, 20])]]) for _ in range(rng.randint(0, 8))]) for i in range(n)] + [(n, None), (n, list("abcd"))]
    left, right = sets(120), sets(90)
    a, b = spark.createDataFrame(left, "x int, s array<string>"), spark.createDataFrame(right, "y int, s array<string>")
    for least in (1, 3):
        clean = lambda s: set(s or []) - {None}
        want = sorted((x, y, len(clean(s) & clean(t))) for x, s in left for y, t in right if len(clean(s) & clean(t)) >= least)
        assert sorted(map(tuple, joins.sharing(a, b, "x", "y", "s", "s", least).collect())) == want


@pytest.mark.parametrize("n", [100, 400])
def test_tests_of_many_modules(spark, n, monkeypatch):
    """Folders with shared parts like src don't meet all others: rows of the join grow with the modules."""
    kept = []
    keep = joins.stored
    monkeypatch.setattr(joins, "stored", lambda d, name: kept.append((name, keep(d, name))) or kept[-1][1])
    rows = [(f"C{k}", f"src/main/java/m{k}/C{k}.java", 0) for k in range(n)] + [(f"T{k}", f"src/test/java/m{k}/T{k}Test.java", 0) for k in range(n)]
    classes = spark.createDataFrame(rows, "name string, file string, class_ord int")
    got = symbols.related_tests(classes, classes.where("name LIKE 'C%'"))
    assert {(r.target, r.test_file) for r in got.collect()} == {(f"C{k}", f"src/test/java/m{k}/T{k}Test.java") for k in range(n)}
    sets = dict(kept)
    members = {r.member: r.sets for r in sets["members"].collect()}
    assert members["src"] == 2 * n and members["m7"] == 2
    # Of four parts with three in common two are joined: the module (two folders), and main or test, which only one side has.
    met = sum(1 for name, k in members.items() if k == 2)
    assert met == n


def test_all_callers(spark):
    rng = random.Random(4)
    edges = [(f"C{rng.randint(0, 2)}", f"m{rng.randint(0, 30)}", f"m{rng.randint(0, 30)}") for _ in range(45)] + [("C0", f"x{k + 1}", f"x{k}") for k in range(12)] + [("C", "x0", "x12"), (None, "n", "m1"), ("C", None, "m1"), ("C", "y", None)]
    e = spark.createDataFrame([(*x, "f") for x in edges], "caller_class string, caller_method string, callee_method string, file string")
    names = sorted({x[2] for x in edges if x[2]})
    want = set()
    for name in names:
        depth, met, at, walked = 0, {}, {name}, {name}
        while at:
            step = {(c, m) for c, m, callee in edges if callee in at} - set(met)
            met |= {x: depth for x in step}
            at = {m for _, m in step if m} - walked
            walked |= at
            depth += 1
        want |= {(name, d, *x) for x, d in met.items()}
    got = symbols.all_callers(e, spark.createDataFrame([(x,) for x in [*names, "nobody", None]], "method string"))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert symbols.all_callers(e.limit(0), e.select(F.col("callee_method").alias("method"))).count() == 0


def test_sketches_are_merged(spark):
    """A merge of a hundred days is as good as one sketch, and nulls don't count."""
    d = spark.range(40_000).select((F.col("id") % 100).alias("day"), (F.col("id") % 9_000).alias("who"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"))
    days = sketches.sketched(d, ["day"], F.col("who"), F.col("v"))
    assert dict(days.dtypes)["members"] == dict(days.dtypes)["amounts"] == "binary" and days.count() == 100
    r = sketches.estimated(sketches.merged(days.withColumn("all", F.lit(1)), ["all"]), {"middle": 0.5}).first()
    assert abs(r.n_members - 9_000) <= 9_000 * sketches.DISTINCT_ERROR and abs(r.middle - 20_000) <= 40_000 * sketches.RANK_ERROR
