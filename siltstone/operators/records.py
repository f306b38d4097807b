"""Checks of JSON-lines records, line by line, and of ids over all lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import SEVERITIES, STATUSES
from ..functions.text import strip
from .order import running

# Fields that a record must have.
CANDIDATE_FIELDS = ("candidate_id", "category", "file", "line", "matched_rule", "snippet")
FINDING_FIELDS = ("finding_id", "experiment_id", "tool", "harness_version", "model", "prompt_version", "vulnerability_type", "severity", "confidence", "file", "description", "evidence", "attack_scenario", "recommendation", "validation_status", "notes")


def record_problems(lines: DataFrame) -> DataFrame:
    """line_no, kind (candidate, finding or generic) and problems of the non-blank lines (line_no, line)."""
    d = lines.where(strip(F.col("line")) != "").withColumn("v", F.try_parse_json("line")).withColumn("type", F.schema_of_variant("v"))
    get = lambda c, t="string": F.try_variant_get("v", f"$.{c}", t)
    keys = F.when(F.col("type").startswith("OBJECT"), F.json_object_keys("line"))
    has = lambda c: F.array_contains("keys", c)
    d = d.withColumn("keys", keys)
    kind = F.when(has("candidate_id"), "candidate").when(has("finding_id"), "finding").otherwise("generic")
    typed = lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")), F.lit("VOID"))
    whole = lambda c: has(c) & (typed(c) != "VOID") & ((typed(c) != "BIGINT") | (F.coalesce(get(c, "long"), F.lit(0)) < 1))
    file = F.when(typed("file") == "STRING", get("file"))
    absolute = file.startswith("/") | file.startswith("\\") | (F.substring(file, 2, 1) == ":")
    ident = F.when(kind == "candidate", get("candidate_id")).when(kind == "finding", get("finding_id")).otherwise(get("id"))
    d = d.withColumn("kind", kind).withColumn("ident", ident)
    # Lines without an id are dealt by their number: they repeat nothing.
    mine = Window.partitionBy("ident", F.when(F.col("ident").isNull(), F.col("line_no"))).orderBy("line_no")
    d = d.withColumn("again", F.col("ident").isNotNull() & (F.row_number().over(mine) > 1))
    finding, candidate = F.col("kind") == "finding", F.col("kind") == "candidate"
    share = get("confidence", "double")
    checks: list[tuple[Column, str]] = [(F.col("v").isNull(), "invalid JSON syntax"), (F.col("v").isNotNull() & F.col("keys").isNull(), "record is not a JSON object")]
    checks += [(candidate & ~has(c), f"missing required candidate field '{c}'") for c in CANDIDATE_FIELDS]
    checks += [(finding & ~has(c), f"missing required finding field '{c}'") for c in FINDING_FIELDS]
    checks += [(F.col("again"), "duplicate id"), ((finding | candidate) & absolute, "file path must be relative, not absolute"), (candidate & whole("line"), "line must be positive integer or null")]
    checks += [
        (finding & ~F.coalesce(get("severity").isin(SEVERITIES), F.lit(False)), "invalid severity"),
        (finding & ~F.coalesce(get("validation_status").isin(STATUSES), F.lit(False)), "invalid validation_status"),
        (finding & ~F.coalesce(typed("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)") & share.between(0, 1), F.lit(False)), "confidence must be a number between 0 and 1"),
        *[(finding & whole(c), f"{c} must be positive integer or null") for c in ("start_line", "end_line")],
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in checks]), lambda x: x.isNotNull())
    return d.select("line_no", F.when(F.col("keys").isNotNull(), F.col("kind")).alias("kind"), found.alias("problems"))


def file_is_array(text: Column) -> Column:
    """True for a file that is one JSON array, which JSON lines may not be; blank is fine."""
    return strip(text).startswith("[")


def repeated_ids(rows: DataFrame, ident: str, order: str) -> DataFrame:
    """Rows whose id an earlier row has, with their place among its rows (nth, from 2).

    Places are differences of prefix counts over ranges sorted by id and order, so the rows of
    an id may be spread over many tasks. Null ids are one id; order tells rows apart.
    """
    d = running(rows, [ident, order], {"rep_before": F.lit(1)})
    first = d.groupBy(F.col(ident).alias("rep_id")).agg(F.min("rep_before").alias("rep_first"))
    nth = (F.col("rep_before") - F.col("rep_first") + 1).cast("int")
    return d.join(first, F.col(ident).eqNullSafe(F.col("rep_id"))).withColumn("nth", nth).where("nth > 1").drop("rep_id", "rep_first", "rep_before")
