"""Findings: into form, verified against sources, one per cluster, judged, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import findings as f
from ..functions.text import blank_to, clean_path, strip
from ..schemas import FINDING_COLUMNS
from ..sources.scratch import apart
from .order import running


def normalised(raw: DataFrame, experiment: str, root: str = "", tool: str = "custom-harness", harness_version: str = "v1", model: str = "unknown", prompt_version: str = "unknown") -> DataFrame:
    """raw (string columns, some of those of a finding; data_flow an array) as finding rows."""
    have = set(raw.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    text = lambda c: F.coalesce(get(c), F.lit(""))
    start, end = f.line(get("start_line")), f.line(get("end_line"))
    swap = end < start
    first, last = F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
    kind, file, cwe = strip(text("vulnerability_type")), clean_path(text("file"), root), f.cwe(get("cwe"))
    made = {
        "finding_id": blank_to(get("finding_id"), f.finding_id(F.lit(experiment), file, first, cwe, kind)),
        "experiment_id": blank_to(get("experiment_id"), experiment), "tool": blank_to(get("tool"), tool), "harness_version": blank_to(get("harness_version"), harness_version),
        "model": blank_to(get("model"), model), "prompt_version": blank_to(get("prompt_version"), prompt_version), "vulnerability_type": kind, "cwe": cwe,
        "severity": f.severity(F.coalesce(get("severity"), F.lit(""))), "confidence": f.confidence(get("confidence")), "file": file, "start_line": first, "end_line": last,
        "data_flow": F.coalesce(get("data_flow").cast("array<string>") if "data_flow" in have else F.array().cast("array<string>"), F.array().cast("array<string>")),
        "validation_status": f.status(F.coalesce(get("validation_status"), F.lit("unvalidated"))),
        "validator_confidence": F.when(get("validator_confidence").isNotNull(), f.confidence(get("validator_confidence"))),
    }
    nullable = ("function", "source", "sink", "security_control", "validator", "duplicate_of")
    return raw.select(*[made.get(c, get(c) if c in nullable else text(c)).alias(c) for c in FINDING_COLUMNS])


ACCESS_CONTROL = ["CWE-284", "CWE-639", "CWE-862"]


def claimed(raw: DataFrame) -> DataFrame:
    """raw without the rows that say is_vulnerable: false; no word about it counts as a claim."""
    return raw.where(F.coalesce("is_vulnerable", F.lit(True))) if "is_vulnerable" in raw.columns else raw


def verified(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Raw findings whose texts are there and whose evidence stands in their file; lines are set to where it stands.

    files: file, content. Source and data flow may be absent for access control. Findings of a
    file stay in the order they came in.
    """
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    access = F.upper(F.coalesce(F.col("cwe"), F.lit(""))).isin(ACCESS_CONTROL)
    flow = F.exists(F.coalesce("data_flow", F.array().cast("array<string>")), lambda x: strip(x) != "")
    sound = filled("description") & filled("evidence") & filled("attack_scenario") & filled("recommendation") & filled("sink") & (access | (filled("source") & flow))
    safe = ~F.col("file").startswith("/") & ~F.array_contains(F.split("file", "/"), "..")
    evidence = strip(F.col("evidence"))
    at = F.position(evidence, F.col("content"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    first = breaks(F.substring(F.col("content"), F.lit(1), at - 1)) + 1
    nth = "nth"
    while nth in raw.columns:
        nth += "_"
    kept = raw.where(sound & safe).withColumn("file", clean_path(F.col("file"))).withColumn(nth, F.monotonically_increasing_id()).join(files.select("file", "content"), "file").where(at > 0)
    placed = kept.withColumn("start_line", first.cast("string")).withColumn("end_line", (first + breaks(evidence)).cast("string")).drop("content")
    return placed.sortWithinPartitions("file", nth).select(*raw.columns)


def deduplicated(findings: DataFrame, order: str | Column = "finding_id") -> DataFrame:
    """findings with dedup_key, is_canonical and duplicate_of (the canonical finding of the key).

    Canonical is the best by status, confidence, length of evidence and steps of data flow;
    ties go to the first in `order`. The best of a key is a minimum over a few numbers and ids,
    combined before the shuffle, and joined back; so a key may have any number of findings.
    """
    key = f.dedup_key(*[F.col(c) for c in ("vulnerability_type", "cwe", "file", "function", "start_line", "sink", "evidence")])
    rank = f.choose(F.col("validation_status"), f.STATUS_RANK, 1)
    steps = F.size(F.coalesce("data_flow", F.array().cast("array<string>")))
    by = F.col(order) if isinstance(order, str) else order
    best = F.struct((-rank).alias("a"), F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("b"), (-F.length(F.coalesce("evidence", F.lit("")))).alias("c"), (-steps).alias("d"), by.alias("e"), F.col("finding_id").alias("id"))
    d = apart(findings).withColumn("dedup_key", key).withColumn("dedup_best", best)
    first = d.groupBy("dedup_key").agg(F.min("dedup_best").alias("dedup_first"))
    d = d.join(first, "dedup_key")
    here = F.col("dedup_best") == F.col("dedup_first")
    # Only findings that tie in all of this, id included, are numbered; both branches read the same shuffles.
    top = d.where(here).withColumn("dedup_nth", F.row_number().over(Window.partitionBy("dedup_key").orderBy("dedup_best")))
    both = top.unionByName(d.where(~here).withColumn("dedup_nth", F.lit(0)))
    canonical = F.col("dedup_nth") == 1
    return both.withColumn("is_canonical", canonical).withColumn("duplicate_of", F.when(canonical, F.col("duplicate_of")).otherwise(F.col("dedup_first.id"))).select(*findings.columns, "dedup_key", "is_canonical")


def validator_result(response: Column) -> Column:
    """struct of a validator's answer: its JSON, else what its words say."""
    parsed = F.from_json(response, "status string, confidence string, reason string, missing_evidence array<string>, recommended_manual_check string")
    none = F.array().cast("array<string>")
    shape = lambda s, c, r, m, k: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), c.alias("confidence"), r.alias("reason"), m.alias("missing_evidence"), k.alias("recommended_manual_check"))
    low = F.lower(response)
    said = F.lower(parsed["status"])
    told = shape(F.when(said.isin(f.DECISIONS), said).otherwise("uncertain"), F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.5)), F.coalesce(parsed["reason"], F.lit("Validation parsed successfully")), F.coalesce(parsed["missing_evidence"], none), F.coalesce(parsed["recommended_manual_check"], F.lit("")))
    # What is said of answers that aren't JSON.
    words = lambda s, c, r, m, k: shape(F.lit(s), F.lit(c), F.lit(r), m, F.lit(k))
    return (
        F.when(parsed["status"].isNotNull(), told)
        .when(low.contains("validated") & ~low.contains("rejected"), words("validated", 0.8, "Validator text indicates validation", none, ""))
        .when(low.contains("rejected"), words("rejected", 0.8, "Validator text indicates rejection", none, ""))
        .otherwise(words("uncertain", 0.5, "Validator response unparseable or uncertain", F.array(F.lit("Clear validation rationale")), "Manual security review required"))
    )


def judged(findings: DataFrame, results: DataFrame, validator: str = "independent-judge") -> DataFrame:
    """findings with the results (finding_id and a validator's fields) laid over them; a reason is noted."""
    r = results.select("finding_id", F.col("status").alias("r_status"), F.col("confidence").alias("r_confidence"), F.col("reason").alias("r_reason"))
    note = F.when(F.coalesce("r_reason", F.lit("")) != "", F.concat(F.lit(f"[Validator ({validator})]: "), F.col("r_reason")))
    hit = F.col("r_status").isNotNull()
    d = findings.join(r, "finding_id", "left")
    d = d.withColumn("notes", F.when(note.isNull(), F.col("notes")).when(F.coalesce("notes", F.lit("")) == "", note).otherwise(strip(F.concat_ws("\n", "notes", note))))
    d = d.withColumn("validation_status", F.coalesce("r_status", "validation_status")).withColumn("validator", F.when(hit, F.lit(validator)).otherwise(F.col("validator"))).withColumn("validator_confidence", F.when(hit, F.col("r_confidence")).otherwise(F.col("validator_confidence")))
    return d.select(*findings.columns)


COMMENT_LIKE = ("* SPDX-", "//", "/*", "import ")


def standing_truth(truth: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Reviewed cases whose evidence is code and stands in one of their files (if files are given)."""
    evidence = strip(F.coalesce("validation_evidence", F.lit("")))
    t = truth.where((F.col("review_status") == "reviewed") & (evidence != "") & ~f.starts_with_any(evidence, COMMENT_LIKE))
    if files is None:
        return t
    places = t.select("ground_truth_id", F.explode("relevant_files").alias("file"), evidence.alias("evidence"))
    found = places.join(files.select("file", "content"), "file").where(F.col("content").contains(F.col("evidence"))).select("ground_truth_id")
    return t.join(found, "ground_truth_id", "left_semi")


def labelled(findings: DataFrame, truth: DataFrame, coverage_complete: bool = False) -> DataFrame:
    """findings with outcome: tp, fp or uncertain.

    truth: standing cases. A finding matches a case in its file by CWE, or if its kind is
    part of the case's.
    """
    cases = truth.select(F.explode("relevant_files").alias("t_file"), F.col("cwe").alias("t_cwe"), F.lower("vulnerability_type").alias("t_type"))
    kind = F.lower(F.coalesce("vulnerability_type", F.lit("")))
    # Two joins on finer keys than the file: its weakness, and its kind of finding (of which a file has few different ones).
    by_cwe = cases.where("t_cwe <> ''").select("t_file", "t_cwe").distinct().withColumn("same_cwe", F.lit(True))
    kinds = findings.select(F.col("file").alias("t_file"), kind.alias("t_kind")).distinct()
    by_kind = kinds.join(cases.select("t_file", "t_type").distinct(), "t_file").where(F.col("t_type").contains(F.col("t_kind"))).select("t_file", "t_kind").distinct().withColumn("same_kind", F.lit(True))
    d = findings.join(by_cwe, (F.col("file") == F.col("t_file")) & (F.col("cwe") == F.col("t_cwe")), "left").drop("t_file", "t_cwe")
    d = d.join(by_kind, (F.col("file") == F.col("t_file")) & (kind == F.col("t_kind")), "left").drop("t_file", "t_kind")
    match = F.coalesce("same_cwe", "same_kind", F.lit(False))
    status = F.col("validation_status")
    outcome = F.when(status == "rejected", "fp").when(match & (status == "validated"), "tp").when((status == "uncertain") | match, "uncertain").otherwise("fp" if coverage_complete else "uncertain")
    return d.withColumn("outcome", outcome).select(*findings.columns, "outcome")


def evaluation(outcomes: DataFrame, coverage_complete: bool = False) -> DataFrame:
    """One row: counts of each outcome, and precision where coverage is complete. Ids by outcome are `outcome_ids`."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    d = outcomes.agg(n("tp").alias("true_positives"), n("fp").alias("false_positives"), n("uncertain").alias("uncertain"))
    judged = F.col("true_positives") + F.col("false_positives")
    precision = F.when(F.lit(coverage_complete) & (judged > 0), F.round(F.col("true_positives") / judged, 4))
    return d.withColumn("estimated_precision", precision).withColumn("precision_type", F.when(F.col("estimated_precision").isNotNull(), "local_ground_truth").otherwise("unavailable"))


def outcome_ids(outcomes: DataFrame) -> DataFrame:
    """(outcome, finding_id): the findings of each outcome, as a table that may be as long as the findings."""
    return outcomes.select("outcome", "finding_id")


def ratio(n: Column, d: Column, digits: int, scale: float = 1.0) -> Column:
    return F.when(d > 0, F.round(n / d * F.lit(scale), digits)).otherwise(F.lit(0.0))


def usage_rollup(usage: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, cache hits, retries and latency of usage rows, by columns or in all; no total is input and output."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    usage = usage.withColumn("total_tokens", F.when(F.coalesce("total_tokens", F.lit(0)) == 0, both).otherwise(F.col("total_tokens")))
    measured = F.coalesce("token_measurement", F.lit("character_estimate"))
    d = usage.groupBy(*by).agg(
        F.count("*").alias("llm_calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("total_tokens").alias("total_tokens"),
        F.count_if(F.coalesce("is_cached", F.lit(False))).alias("cached_calls"), total("retry_count").alias("retries"),
        F.coalesce(F.round(F.avg(F.coalesce("latency_seconds", F.lit(0.0))), 3), F.lit(0.0)).alias("average_latency_seconds"),
        F.array_join(F.array_sort(F.collect_set(measured)), ", ").alias("token_measurement"),
    )
    calls = F.col("llm_calls")
    d = d.withColumn("token_measurement", F.when(calls > 0, F.col("token_measurement")).otherwise("character_estimate"))
    return d.withColumn("retry_rate", ratio(F.col("retries"), calls, 4)).withColumn("cache_hit_rate", ratio(F.col("cached_calls"), calls, 4))


def metrics(findings: DataFrame, usage: DataFrame, outcomes: DataFrame, experiment: str, runtime_seconds: float, phases: dict[str, float] | None = None) -> DataFrame:
    """The one-row record of an experiment. findings: with is_canonical."""
    status = lambda s: F.count_if(F.col("is_canonical") & (F.col("validation_status") == s))
    counts = findings.agg(F.count("*").alias("raw_findings"), F.count_if(~F.col("is_canonical")).alias("duplicates"), F.count_if("is_canonical").alias("unique_findings"), status("validated").alias("validated_findings"), status("rejected").alias("rejected_findings"))
    d = counts.crossJoin(usage_rollup(usage)).crossJoin(outcomes.select("true_positives", "false_positives", "uncertain", "estimated_precision", "precision_type"))  # one row each
    minutes = F.lit(runtime_seconds / 60.0)
    durations = F.create_map(*[x for k, v in (phases or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if phases else F.create_map().cast("map<string,double>")
    return d.select(
        F.lit(experiment).alias("experiment_id"), F.lit(runtime_seconds).alias("runtime_seconds"), durations.alias("phase_durations"), *counts.columns,
        "llm_calls", "input_tokens", "output_tokens", "total_tokens", "token_measurement", "average_latency_seconds", "retry_rate", "cache_hit_rate",
        "true_positives", "false_positives", "uncertain", "estimated_precision", "precision_type",
        ratio(F.col("unique_findings"), minutes, 2).alias("findings_per_minute"),
        ratio(F.col("validated_findings"), F.col("total_tokens"), 2, 100_000).alias("validated_findings_per_100k_tokens"),
        ratio(F.col("true_positives"), F.col("total_tokens"), 2, 100_000).alias("true_positives_per_100k_tokens"),
        ratio(F.col("duplicates"), F.col("raw_findings"), 4).alias("duplicate_rate"), ratio(F.col("rejected_findings"), F.col("unique_findings"), 4).alias("rejection_rate"),
    )


def truth_candidates(files: DataFrame) -> DataFrame:
    """Cases that lesson, assignment and challenge sources suggest: SQL injection, else deserialization."""
    from ..functions.text import module_of, telling_line

    # The words that are looked for, and the texts of a case.
    has = lambda w: F.col("content").contains(w)
    low = F.lower("file")
    sql = has("SELECT") & has("+") & (has("executeQuery") | has("createNativeQuery"))
    stream = has("ObjectInputStream") & has("readObject")
    place = files.where(F.col("file").endswith(".java") & (low.contains("lesson") | low.contains("assignment") | low.contains("challenge")) & (sql | stream))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.java", "")
    d = place.select("file", name.alias("lesson"), module_of(F.col("file")).alias("module"), F.when(sql, "SQL Injection").otherwise("Insecure Deserialization").alias("vulnerability_type"), F.when(sql, "CWE-89").otherwise("CWE-502").alias("cwe"), F.array("file").alias("relevant_files"),
        F.when(sql, "String concatenation into raw SQL query executed against database").otherwise("Untrusted byte stream deserialized without class allowlisting").alias("expected_vulnerable_behavior"),
        F.when(sql, telling_line(F.col("content"), ["SELECT", "executeQuery", "createNativeQuery"])).otherwise(telling_line(F.col("content"), ["ObjectInputStream", "readObject"])).alias("validation_evidence"), F.lit(0.95).alias("confidence"), F.lit("heuristic").alias("review_status"))
    d = running(d, [F.split("file", "/"), F.col("file")], {"nth": F.lit(1)})
    return d.withColumn("ground_truth_id", F.format_string("GT-WG-%03d", F.col("nth") + 1)).drop("nth")
