"""Column functions that bring messy finding fields into their fixed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values of the finding format.
SEVERITIES = ["critical", "high", "medium", "low", "informational"]
STATUSES = ["unvalidated", "validated", "rejected", "uncertain"]
DECISIONS = ["validated", "rejected", "uncertain"]
STATUS_RANK = {"validated": 3, "unvalidated": 2, "uncertain": 1, "rejected": 0}
SEVERITY_OF = {
    "critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "informational",
    "crit": "critical", "error": "high", "warning": "medium", "warn": "medium", "note": "low", "info": "informational", "none": "informational",
}


def choose(c: Column, table: dict[str, object], default: object) -> Column:
    """The table's value for c, else the default. A text is looked up in a map, so c is worked out once and not per entry."""
    if all(isinstance(k, str) for k in table):
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for entry in table.items() for x in entry]), c), F.lit(default))
    found = F.lit(default)
    for k, v in reversed(table.items()):
        found = F.when(c == k, F.lit(v)).otherwise(found)
    return found


def cwe(raw: Column) -> Column:
    """CWE-<number> of the first number in a text, else null."""
    n = F.regexp_extract(F.coalesce(raw.cast("string"), F.lit("")), r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def confidence(raw: Column) -> Column:
    """A number held to 0..1; what is no number is 0, NaN is 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(strip(raw.cast("string")).try_cast("double"), F.lit(0.0))))


def severity(raw: Column) -> Column:
    return choose(F.lower(strip(raw)), SEVERITY_OF, "medium")


def status(raw: Column) -> Column:
    key = F.lower(strip(raw))
    return F.when(key.isin(STATUSES), key).otherwise("unvalidated")


def line(raw: Column) -> Column:
    """A whole number from 1 on, else null."""
    return F.regexp_extract(raw.cast("string"), r"^\s*\+?0*([1-9][0-9]*)\s*\z", 1).try_cast("int")


def line_number(raw: Column) -> Column:
    """The same of a number column: fractions are cut."""
    n = F.when(~F.isnan(raw), raw.try_cast("int"))
    return F.when(n >= 1, n)


def finding_id(experiment: Column, file: Column, start_line: Column, cwe_id: Column, kind: Column, prefix: str = "WG-") -> Column:
    text = F.concat_ws("|", experiment, file, F.coalesce(start_line.cast("string"), F.lit("null")), F.when(F.coalesce(cwe_id, F.lit("")) == "", "null").otherwise(cwe_id), F.lower(strip(kind)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 8))


def dedup_key(kind: Column, cwe_id: Column, file: Column, function: Column, start_line: Column, sink: Column, evidence: Column) -> Column:
    """Key of findings that are one: kind, CWE, file, function, tens of lines, sink, evidence."""
    low = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    tens = F.coalesce(F.floor(start_line / 10) * 10, F.lit(0)).cast("int").cast("string")
    snippet = F.when(F.coalesce(evidence, F.lit("")) == "", "").otherwise(F.substring(F.md5(strip(evidence)), 1, 8))
    parts = [low(kind), F.upper(strip(F.coalesce(cwe_id, F.lit("")))), low(file), low(function), tens, low(sink), snippet]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def sarif_severity(level: Column) -> Column:
    low = F.lower(F.coalesce(level, F.lit("warning")))
    return F.when(low.isin("error", "critical"), "high").when(low.isin("warning", "warn"), "medium").otherwise("low")


def sarif_cwe(tags: Column, rule_id: Column) -> Column:
    """The first tag that names a CWE, else the rule's id."""
    return F.coalesce(F.try_element_at(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).contains("cwe")), F.lit(1)), rule_id)


def problems(checks: dict[str, Column]) -> Column:
    """array<string> of the checks that fail (null counts as failed), in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in checks.items()]), lambda x: x.isNotNull())


REQUIRED = ["finding_id", "experiment_id", "tool", "harness_version", "model", "prompt_version", "vulnerability_type", "file", "description", "evidence", "attack_scenario", "recommendation", "notes"]


def finding_problems() -> Column:
    """What is wrong with a finding row."""
    share = lambda c: F.col(c).between(0, 1) & ~F.isnan(c)
    positive = lambda c: F.col(c).isNull() | (F.col(c) >= 1)
    return problems(
        {f"{c} is missing": F.col(c).isNotNull() for c in REQUIRED}
        | {"severity": F.col("severity").isin(SEVERITIES), "validation_status": F.col("validation_status").isin(STATUSES), "confidence": share("confidence"), "validator_confidence": F.col("validator_confidence").isNull() | share("validator_confidence")}
        | {"start_line": positive("start_line"), "end_line": positive("end_line"), "end_line before start_line": F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("end_line") >= F.col("start_line")), "data_flow": F.col("data_flow").isNotNull() & F.forall("data_flow", lambda x: x.isNotNull())}
    )


def validation_problems() -> Column:
    """What is wrong with a validator's result row."""
    return problems({"status": F.col("status").isin(DECISIONS), "confidence": F.col("confidence").between(0, 1) & ~F.isnan("confidence"), "reason": F.col("reason").isNotNull(), "missing_evidence": F.col("missing_evidence").isNotNull() & F.forall("missing_evidence", lambda x: x.isNotNull()), "recommended_manual_check": F.col("recommended_manual_check").isNotNull()})


def starts_with_any(c: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
