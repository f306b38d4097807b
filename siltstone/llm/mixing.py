"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key of its doc_id, text and number among its copies. The leading
bits of a uniform key are its range partition, so each source is range-sorted into buckets
without sampling; prefix sums are taken over bucket totals, then inside each bucket, and every
source is cut at its budget. The number of buckets grows with the table. A source that holds a
third of all rows is spread over all its buckets, and so are rows that share one doc_id. Equal
rows are counted before they are shuffled; a count becomes rows again in steps of COPIES.

Sources may be many (domains): their targets come from two range-sorted prefix sums, not from
a window over all of them.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
repeated rows are separate rows (each copy has its own key); an empty table gives an empty
result; other columns of the table, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, stored, table

RATIO = 1.5
WEIGHTS = (5, 2, 1)
EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
BUCKET_ROWS = 100_000  # rows of the table for each bucket
COPIES = 10_000  # equal rows that a task makes of one count
SOURCE = ["mx_null", "mx_source"]


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def bucket_bits(rows: int) -> int:
    """Bits of the key that number the buckets of each source."""
    return max(4, min(24, (max(1, rows) // BUCKET_ROWS).bit_length()))


def _named(docs: DataFrame) -> tuple[Column, ...]:
    """What tells rows apart and what they count: doc_id, source, hash of the text, size."""
    return F.col("doc_id"), F.col("source").isNull().alias("mx_null"), F.coalesce("source", F.lit("")).alias("mx_source"), F.md5(F.coalesce("text", F.lit(""))).alias("mx_text"), words(F.col("text")).alias("size")


def _copies(counted: DataFrame) -> DataFrame:
    """counted (mx_n equal rows in one) with mx_copy, 0 to mx_n - 1, a row each. Large counts are dealt to many tasks."""
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_n") - 1))
    few = counted.where(F.col("mx_n") <= COPIES).withColumn("mx_copy", one)
    steps = counted.where(F.col("mx_n") > COPIES).withColumn("mx_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_n") - 1, F.lit(COPIES).cast("long"))))
    many = steps.repartition("mx_text", "mx_from").withColumn("mx_copy", F.explode(F.sequence("mx_from", F.least(F.col("mx_from") + COPIES, "mx_n") - 1))).drop("mx_from")
    return few.unionByName(many)


def _keyed(counted: DataFrame, seed: str, bits: int) -> DataFrame:
    """A row per copy, with its key and bucket."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), F.col("mx_text"), F.col("mx_copy").cast("string"))
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    return _copies(counted).withColumn("mx_key", key).withColumn("mx_bucket", F.shiftright("mx_key", KEY_BITS - bits).cast("int"))


def targets(sizes: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes: (mx_null, mx_source, source_size), a row per source. Adds target.

    Shares by weight that stop at a cap, the excess reshared until none is above, are the
    water-filling solution: in the order of cap over weight a source is capped if its cap
    is at most its share of what the sources before it left.
    """
    s = running(sizes, SOURCE, {"nth": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    s = s.select(*SOURCE, "source_size", w.alias("w"), (F.col("source_size") * float(epochs)).alias("cap"))
    s = running(s.withColumn("fill", F.col("cap") / F.col("w")), ["fill", *SOURCE], {"used": "cap", "used_w": "w"})
    s = stored(s, "sources")
    all_ = s.agg(F.sum("w").alias("all_w"), (F.sum("source_size") * ratio).alias("budget"))
    s = s.crossJoin(F.broadcast(all_))  # one row
    full = F.col("cap") * (F.col("all_w") - F.col("used_w")) <= F.col("w") * (F.col("budget") - F.col("used"))
    s = s.withColumn("full", full)
    free = s.agg(F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).alias("free_w"), (F.first("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0))).alias("free"))
    s = s.crossJoin(F.broadcast(free))  # one row
    return s.select(*SOURCE, "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("free") / F.col("free_w"))).alias("target"))


def _cut(keyed: DataFrame, ratio: float, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """keyed with source_size, target, epochs done whole, and words taken of the last one."""
    sums = stored(keyed.groupBy(*SOURCE, "mx_bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    plan = stored(targets(sums.groupBy(*SOURCE).agg(F.sum("bucket_size").alias("source_size")), ratio, weights, epochs), "targets")
    before = F.sum("bucket_size").over(Window.partitionBy(*SOURCE).orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*SOURCE, "mx_bucket", F.coalesce(before, F.lit(0)).alias("mx_offset")).join(plan, SOURCE)
    inside = Window.partitionBy(*SOURCE, "mx_bucket").orderBy("mx_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = keyed.join(offsets, [*SOURCE, "mx_bucket"]).withColumn("mx_before", F.col("mx_offset") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    return d.withColumn("mx_whole", whole).withColumn("mx_last", F.greatest(F.lit(0), F.least("size", rest - F.col("mx_before"))))


def mix(docs: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words, repeats counted).

    The document at the cut is taken in part, so each source gets exactly its budget in
    words: the whole part of its target.
    """
    counted = docs.select(*_named(docs)).groupBy("doc_id", *SOURCE, "mx_text", "size").agg(F.count("*").alias("mx_n"))
    counted = stored(counted, "mix")
    rows = counted.agg(F.sum("mx_n")).first()[0] or 0
    d = _cut(_keyed(counted, seed, bucket_bits(rows)), ratio, weights, epochs)
    return d.select("doc_id", F.when(~F.col("mx_null"), F.col("mx_source")).alias("source"), "size", "source_size", "target", (F.col("mx_whole") * F.col("size") + F.col("mx_last")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: each row once for every epoch that takes it, columns as before.

    Rows stay whole: the row at the cut is kept if at least half of its words are within
    the budget. Rows without words go along in every whole epoch.
    """
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    by = ["doc_id", *SOURCE, "mx_text", "size", "mx_hash"]
    named = docs.select(*_named(docs), hashed.alias("mx_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mx_row"))
    counted = stored(named.groupBy(*by).agg(F.count("*").alias("mx_n")), "mix")
    total = counted.agg(F.sum("mx_n")).first()[0] or 0
    d = _cut(_keyed(counted, seed, bucket_bits(total)), ratio, weights, epochs)
    extra = ((F.col("mx_last") > 0) & (F.col("mx_last") * 2 >= F.col("size"))).cast("bigint")
    # Equal rows are one here: how often all of them are taken together.
    times = d.groupBy(*by).agg(F.sum(F.col("mx_whole") + extra).alias("mx_n")).where("mx_n > 0")
    key = F.xxhash64(*by).alias("mx_id")
    times = stored(times.select(key, F.col("mx_n")), "times")
    one = named.select(key, "mx_row")
    again = stored(counted.where("mx_n > 1").select(key), "repeated")
    # A row without copies passes as it is; of copies one stands for all.
    single = one.join(again, "mx_id", "left_anti")
    first = one.join(again, "mx_id", "left_semi").groupBy("mx_id").agg(F.first("mx_row").alias("mx_row"))
    found = single.unionByName(first).join(times, "mx_id").withColumn("mx_text", F.col("mx_id"))
    return _copies(found).select("mx_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, sn, s, size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1:' || t || ':' || c), 1, 15) AS BIGINT) AS k
  FROM (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s, md5(coalesce(text, '')) AS t,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS c FROM documents)),
per AS (SELECT sn, s, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY sn, s),
weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY sn, s) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
         source_size * CAST(2 AS DOUBLE) AS cap FROM per),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY cap / w, sn, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM weighed),
marked AS (SELECT *, cap * left_w <= w * (budget - used) AS full_ FROM filled),
freed AS (
  SELECT *, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS free_w,
         budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS free FROM marked),
plan AS (
  SELECT sn, s, source_size, CASE WHEN full_ THEN cap ELSE w * (free / free_w) END AS target FROM freed),
run AS (
  SELECT d.*, p.source_size, p.target, CAST(floor(p.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.sn, d.s ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN plan p ON d.sn = p.sn AND d.s = p.s),
part AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM run)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM part
"""
