"""Joins that are no equi-joins: as of a time, by overlapping intervals, by shared members of sets.

None of them pairs all rows of a key. Each is an equi-join or a sort on something finer than
the key, so a key that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart, stored

#: A bin is FINER times as wide as one a level below.
BITS = 4


def _struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _sortable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, name: str = "last", ties: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left with a struct `name`: the row of right with the same `by` and the latest time up to left's (before it, if strict).

    Both sides are put together and range-sorted by key, time and side; in a range the last
    row of right is carried on by a window, and into a range by a prefix over the last rows
    of the ranges before it (one each). So a key's rows may be spread over any number of ranges.
    Rows are stored with their places, so a range's last row is the greatest of a number and
    no task sorts what it reads of the stored rows to find it.

    Of rows of right with equal key and time that with the greatest `ties` counts (all its
    columns, if None). Null keys and times match nothing; repeated rows of left stay; a row
    without a match gets a null struct.
    """
    sides = (1, 0) if strict else (0, 1)  # of right and left: which comes first at equal times
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(by)])
    known = right.where(F.col(f"`{right_time}`").isNotNull())
    for c in by:
        known = known.where(F.col(f"`{c}`").isNotNull())
    rank = F.struct(*([F.col(f"`{c}`") for c in ties] if ties else _sortable(right)))
    r = known.select(key.alias("key"), F.col(f"`{right_time}`").alias("t"), F.lit(sides[0]).alias("side"), rank.alias("rank"), F.lit(0).cast("long").alias("h"), F.lit(None).cast(left.select(_struct(left).alias("x")).schema["x"].dataType).alias("l"), _struct(right).alias("r"))
    none = lambda c: F.lit(None).cast(r.schema[c].dataType).alias(c)
    mine = left.select(key.alias("key"), F.col(f"`{left_time}`").alias("t"), F.lit(sides[1]).alias("side"), none("rank"), F.xxhash64(*_sortable(left)).alias("h"), _struct(left).alias("l"), none("r"))
    order = ["t", "side", "rank", "h"]
    ranged = r.unionByName(mine).repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = stored(ranged.select("key", "side", "l", "r", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "as-of")
    is_right = F.col("side") == sides[0]
    last_at = rows.groupBy("part").agg(F.max(F.when(is_right, F.col("at"))).alias("at"))  # a row per range
    ends = last_at.join(rows.where(is_right).select("at", F.struct("key", "r").alias("end")).join(F.broadcast(last_at.select("at")), "at"), "at", "left").select("part", "end")
    carried = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # a row per range
    inside = Window.partitionBy("part", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("here", F.last("r", ignorenulls=True).over(inside)).where(F.col("side") == sides[1]).join(F.broadcast(carried), "part", "left")
    last = F.coalesce("here", F.when(F.col("carry.key") == F.col("key"), F.col("carry.r")))
    return found.select("l.*", last.alias(name))


def _bins(df: DataFrame, by: list[str], start: Column, end: Column, top: int, role: str, higher: bool, own: bool) -> DataFrame:
    """A row per bin: those of the interval's own level, and of those above it up to `top`."""
    n = F.hex(end - start)
    level = F.least(F.when(end == start, 0).otherwise(F.length(n)), F.lit(top))
    d = df.where(start <= end).select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(by)], start.alias(f"{role}_from"), end.alias(f"{role}_to"), level.alias("own"), _struct(df).alias(role))
    first = F.col("own") + (0 if own else 1)
    last = F.lit(top) if higher else F.col("own")
    d = d.where(first <= last).withColumn("level", F.explode(F.sequence(first, last)))
    shift = lambda c: F.expr(f"shiftright({c}, level * {BITS})")  # noqa: E731  floor of a division by the bins' width, of negative numbers too
    return d.withColumn("bin", F.explode(F.sequence(shift(f"{role}_from"), shift(f"{role}_to")))).drop("own")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], top: int = 5) -> DataFrame:
    """(l, r): structs of the rows of left and right with equal `by` whose spans of whole numbers (both ends included) overlap, each pair once.

    A span of length up to 16^n is on level n and lies in at most two bins of that width. One
    side is put into the bins of its own level, the other into those of its own and all higher
    levels (`top` is the last; longer spans take several bins there), so rows meet at the
    higher of both levels. A pair that meets in two bins counts in that of the later start.
    So the rows that are joined are as many as the spans times `top`, whatever their key, and
    rows of a key meet only where they are near.

    Null keys and ends, and spans that end before they begin, overlap nothing.
    """
    keys = [f"k{n}" for n in range(len(by))]
    (a, b), (c, d) = ((x.cast("long"), y.cast("long")) for x, y in (left_span, right_span))
    once = F.col("bin") == F.expr(f"shiftright(greatest(l_from, r_from), level * {BITS})")
    met = (F.col("l_from") <= F.col("r_to")) & (F.col("r_from") <= F.col("l_to")) & once
    on = [*keys, "level", "bin"]
    wide = _bins(left, by, a, b, top, "l", True, True).join(_bins(right, by, c, d, top, "r", False, True), on).where(met)
    narrow = _bins(left, by, a, b, top, "l", False, True).join(_bins(right, by, c, d, top, "r", True, False), on).where(met)
    return wide.select("l", "r").unionByName(narrow.select("l", "r"))


def holding(points: DataFrame, spans: DataFrame, by: list[str], point: Column, span: tuple[Column, Column], top: int = 5) -> DataFrame:
    """(l, r): points and the spans that hold them; `overlaps` for one side without length (a single join)."""
    at = point.cast("long")
    a, b = (x.cast("long") for x in span)
    left = _bins(points, by, at, at, top, "l", True, True)
    return left.join(_bins(spans, by, a, b, top, "r", False, True), [*[f"k{n}" for n in range(len(by))], "level", "bin"]).where("l_from BETWEEN r_from AND r_to").select("l", "r")


def sharing(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_set: str, right_set: str, least: int) -> DataFrame:
    """left_key, right_key, shared: pairs of sets (arrays) with at least `least` common members, each once.

    Members are ordered by how few sets hold them. Two sets with `least` common members have one
    in common among the first size - least + 1 of each, so only these are joined; the frequent
    members at the end of the order bring no pairs. A pair that meets at several members counts
    at the first, and is verified by its whole intersection. Nulls are no members; keys name
    rows (equal ones of a side are one set each, and are returned as often as they pair).
    """
    clean = lambda d, k, s: d.select(F.col(k).alias("key"), F.array_distinct(F.filter(s, lambda x: x.isNotNull())).alias("set")).where(F.size("set") >= least)
    a, b = (apart(stored(clean(*x).withColumn("n", F.monotonically_increasing_id()), "sets")) for x in ((left, left_key, left_set), (right, right_key, right_set)))
    members = lambda d: d.select("n", F.explode("set").alias("member"))
    rare = stored(members(a).select("member").unionByName(members(b).select("member")).groupBy("member").agg(F.count("*").alias("sets")), "members")

    def prefix(d: DataFrame, role: str) -> DataFrame:
        ordered = members(d).join(rare, "member").groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("sets", "member"))), lambda x: x["member"]).alias("all"))
        ordered = ordered.join(d.select("n", "key"), "n").select("n", F.col("key").alias(f"{role}_key"), F.col("all").alias(f"{role}_all"))
        first = F.slice(f"{role}_all", F.lit(1), F.size(f"{role}_all") - least + 1)
        return ordered.select(F.col("n").alias(f"{role}_n"), f"{role}_key", f"{role}_all", F.posexplode(first).alias(f"{role}_at", "member"))

    before = lambda role: F.slice(f"{role}_all", F.lit(1), F.col(f"{role}_at"))
    shared = F.size(F.array_intersect("l_all", "r_all"))
    met = prefix(a, "l").join(apart(prefix(b, "r")), "member").where(~F.arrays_overlap(before("l"), before("r")) & (shared >= least))
    return met.select(F.col("l_key").alias(left_key), F.col("r_key").alias(right_key), shared.alias("shared"))
