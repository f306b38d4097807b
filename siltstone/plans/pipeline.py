"""The whole scan as one Spark plan: sources to candidates, findings, outcomes and metrics.

The model is a pure projection here (a fixed answer per category), so a run is
deterministic and needs no network; real answers come in as rows of responses instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, tokens_estimated
from ..operators import context, findings, recon, rules, symbols
from ..schemas import GROUND_TRUTH
from ..sources.files import ExclusionRule, lesson_modules, lines, read_files

# The prompt and the skills of each category, else baseline without skills.
RESOURCES = {
    "database": ("sqli", ["sqli"]), "html_template": ("xss", ["xss"]), "command_execution": ("command-injection", ["command-injection"]), "file_handling": ("path-traversal", ["path-traversal"]),
    "xml_parsing": ("xxe", ["xxe"]), "deserialization": ("deserialization", ["deserialization"]), "http_client": ("ssrf", ["ssrf"]), "authorization": ("access-control", ["access-control"]),
    "authentication": ("baseline", ["authentication"]), "session": ("baseline", ["authentication"]), "business_logic": ("baseline", ["business-logic"]),
}
DEFAULT_PROMPT, DEFAULT_VERSION = "Audit this code for security vulnerabilities.", "baseline-audit-v1.0"
SUFFIXES = tuple(sorted({s for r in rules.SOURCE_RULES for s in r.suffixes}))


@dataclass
class Scan:
    files: DataFrame
    classes: DataFrame
    methods: DataFrame
    edges: DataFrame
    candidates: DataFrame
    contexts: DataFrame
    raw: DataFrame
    findings: DataFrame
    usage: DataFrame
    outcomes: DataFrame
    seconds: dict[str, float]


def discover(spark: SparkSession, files: DataFrame, ms: DataFrame | None = None, classes: DataFrame | None = None, catalog: list[rules.Rule] = rules.SOURCE_RULES) -> DataFrame:
    """Candidates of files (file, content), numbered, weak ones rejected; symbols if an index is given."""
    hits = rules.scan(rules.likely_lines(files, catalog), catalog, likely=True)
    names = F.lit(None).cast("array<string>")
    if ms is not None and classes is not None:
        marked = ms.select("file", "class_ord", "method_ord", F.struct("name", F.transform("annotations", lambda a: a["name"]).alias("marks")).alias("name"), "start_line", "end_line")
        hits = symbols.in_blocks(hits, "line_no", method=(marked, ("class_ord", "method_ord")), type=(classes, ("class_ord",)))
        hits = hits.withColumn("symbol", F.coalesce("method.name", "type"))
        names = F.col("method.marks")
    else:
        hits = hits.withColumn("symbol", F.lit(None).cast("string"))
    d = rules.numbered(rules.rejected(hits, names))
    return d.select("candidate_id", "category", "file", F.col("line_no").alias("line"), "symbol", "matched_rule", "snippet", F.array(F.concat("file", F.lit(":"), F.col("line_no").cast("string"))).alias("context_refs"), "priority", "is_rejected", "rejection_reason")


def prompt_version(category: Column) -> Column:
    name = F.lit("baseline")
    for k, (v, _) in RESOURCES.items():
        name = F.when(category == k, v).otherwise(name)
    return F.concat(name, F.lit("-v1.0"))


def analysis_prompts(spark: SparkSession, prompts: DataFrame, specific: bool = True) -> DataFrame:
    """(category, template, version) for each known category and null (any other). prompts: name, skill, text.

    A category's template is its prompt, else the baseline prompt, else a fixed line; behind it
    stand its skills, those that there are. Not specific: the baseline for all.
    """
    wanted = [(c, p, k) for c, (p, k) in RESOURCES.items()] + [(None, "baseline", [])] if specific else [(None, "baseline", [])]
    w = spark.createDataFrame([(k, c, p, s) for k, (c, p, s) in enumerate(wanted)], "k int, category string, prompt string, skills array<string>")
    named = prompts.where("NOT skill").groupBy("name").agg(F.max("text").alias("text"))
    skill = prompts.where("skill").groupBy("name").agg(F.max("text").alias("more"))
    base = named.where("name = 'baseline'").select(F.col("text").alias("base"))
    d = w.join(named, w["prompt"] == named["name"], "left").drop("name").join(base, how="left")  # one row or none
    each = w.select("k", F.posexplode("skills").alias("nth", "name")).join(skill, "name").select("k", F.struct("nth", F.concat(F.lit("\n=== SECURITY SKILL: "), "name", F.lit(" ===\n"), "more").alias("text")).alias("s"))
    added = each.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]).alias("added"))
    template = F.array_join(F.concat(F.array(F.coalesce("text", "base", F.lit(DEFAULT_PROMPT))), F.coalesce("added", F.array().cast("array<string>"))), "\n")
    version = F.concat("prompt", F.lit("-v1.0")) if specific else F.lit(DEFAULT_VERSION)
    return d.join(added, "k", "left").select("category", template.alias("template"), version.alias("version"))


def with_prompts(contexts: DataFrame, templates: DataFrame) -> DataFrame:
    """contexts with prompt_version and full_prompt: template, candidate, place, code context."""
    t = templates.withColumn("t_category", F.coalesce("category", F.lit("")))
    known = [r["t_category"] for r in t.select("t_category").collect()]  # the categories of RESOURCES
    key = F.when(F.col("category").isin(known), F.col("category")).otherwise("")
    d = contexts.withColumn("t_category", key).join(F.broadcast(t.drop("category")), "t_category", "left")
    place = F.concat("file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("None")))
    full = F.concat("template", F.lit("\n\nCandidate ID: "), "candidate_id", F.lit("\nTarget File: "), place, F.lit("\n\n=== CODE CONTEXT ===\n"), "prompt", F.lit("\n"))
    return d.select(*contexts.columns, F.col("version").alias("prompt_version"), full.alias("full_prompt"))


def validation_prompts(found: DataFrame, context: Column, template: str) -> DataFrame:
    """found with full_prompt: what a validator is asked, the finding as JSON and its code context in it."""
    finding = F.to_json(F.struct(*[F.col(c) for c in found.columns]), {"ignoreNullFields": "false", "pretty": "true"})
    return found.withColumn("full_prompt", F.concat(F.lit(template + "\n\n=== FINDING TO VALIDATE ===\n"), finding, F.lit("\n\n=== CODE CONTEXT ===\n"), F.coalesce(context, F.lit("")), F.lit("\n")))


def stub_answers(candidates: DataFrame) -> DataFrame:
    """The fixed answer of the model stub: an injection finding for database candidates, nothing else."""
    return candidates.where((F.col("category") == "database") & ~F.col("is_rejected")).select(
        F.lit("SQL Injection").alias("vulnerability_type"), F.lit("CWE-89").alias("cwe"), F.lit("high").alias("severity"), F.lit("0.92").alias("confidence"), F.lit("request input").alias("source"),
        F.lit("Statement.executeQuery").alias("sink"), F.array(F.lit("input arrives"), F.lit("it is put into the statement")).alias("data_flow"), F.lit("Input becomes part of a statement's text.").alias("description"),
        "file", F.col("line").cast("string").alias("start_line"), F.lit(None).cast("string").alias("end_line"), F.col("snippet").alias("evidence"), F.lit("A quote in the input ends the literal.").alias("attack_scenario"),
        F.lit("None").alias("security_control"), F.lit("Bind the input as a parameter").alias("recommendation"), prompt_version(F.col("category")).alias("prompt_version"),
    )


def usage_rows(contexts: DataFrame, model: str = "stub") -> DataFrame:
    """A usage row for each candidate that is asked about; a prompt asked before is a cache hit."""
    version = prompt_version(F.col("category"))
    d = contexts.where(~F.col("is_rejected")).withColumn("cache_key", cache_key(F.sha2("prompt", 256), version, F.lit(model), F.lit("investigation"), F.sha2("prompt", 256)))
    d = context.with_hits(d, "cache_key", "candidate_id", "cached")
    asked = tokens_estimated(F.col("prompt")).cast("long")
    return d.select(F.col("candidate_id").alias("request_id"), F.lit(model).alias("model"), F.lit("investigation").alias("phase"), F.lit("investigator").alias("agent"), asked.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), (asked + 1).alias("total_tokens"), F.lit(0.0).alias("latency_seconds"), F.lit(0).cast("long").alias("retry_count"), F.lit("character_estimate").alias("token_measurement"), F.col("cached").alias("is_cached"))


def run(
    spark: SparkSession, root: str, policy: list[ExclusionRule] | None = None, experiment: str = "experiment", validate: bool = True, indexed: bool = True,
    truth: DataFrame | None = None, coverage_complete: bool = False, answers: Callable[[DataFrame], DataFrame] = stub_answers,
) -> Scan:
    """Scan a source tree. Each relation that others use is checkpointed once, and its phase timed.

    answers: from candidates to raw findings, the model stub by default. truth: reviewed cases;
    without any, a finding that isn't rejected is uncertain.
    """
    seconds, began = {}, time.monotonic()

    def done(phase: str) -> None:
        nonlocal began
        seconds[phase], began = round(time.monotonic() - began, 3), time.monotonic()

    files = read_files(spark, root, SUFFIXES, policy, any_case=True).checkpoint()
    java = files.where(F.col("file").endswith(".java"))
    hits = rules.pattern_hits(lines(java))
    about = context.architecture(lesson_modules(java), recon.components(java), recon.endpoints(java), hits).checkpoint()
    done("reconnaissance")
    classes = symbols.index(java).checkpoint()
    ms = symbols.methods(classes).checkpoint()
    edge = symbols.edges(ms)
    done("indexing")
    candidates = discover(spark, files, ms if indexed else None, classes if indexed else None).checkpoint()
    done("candidate_discovery")
    contexts = context.assembled(candidates, files, classes, ms, edge, about).checkpoint()
    raw = findings.verified(findings.claimed(answers(candidates)), files)
    found = findings.normalised(raw, experiment, tool="ai-assisted-sast", harness_version="v1.0", model="stub")
    done("investigation")
    if validate:
        said = found.select("finding_id", F.lit("validated").alias("status"), F.lit(0.95).alias("confidence"), F.lit("The statement is put together from input.").alias("reason")).dropDuplicates(["finding_id"])
        found = findings.judged(found, said)
    done("validation")
    found = findings.deduplicated(found).checkpoint()
    done("deduplication")
    cases = truth if truth is not None else spark.createDataFrame([], GROUND_TRUTH)
    outcomes = findings.labelled(found.where("is_canonical"), findings.standing_truth(cases, files), coverage_complete).select("finding_id", "outcome").checkpoint()
    done("ground_truth_eval")
    return Scan(files, classes, ms, edge, candidates, contexts, raw, found, usage_rows(contexts), outcomes, seconds)
