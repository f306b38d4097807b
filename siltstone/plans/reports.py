"""Small documents from aggregates: manifest, architecture report, experiment table, settings."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recon
from ..sources.files import ExclusionRule, inventory, poms, tree_roots

SOURCE_EXTENSIONS = [".java", ".js", ".mjs", ".html", ".htm", ".xml", ".xhtml", ".properties", ".yml", ".yaml", ".sql", ".css", ".ts", ".kt"]
TOP = 5


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Flat `key: value` settings; a missing file, or lines of another shape, give none."""
    try:
        lines = [r[0] for r in spark.read.text(path).collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    found = (re.match(r"\s*([\w-]+):\s*(.*?)\s*(?:#.*)?$", x) for x in lines)
    return {m[1]: m[2].strip("\"'") for m in found if m and m[2]}


def manifest(files: DataFrame, policy: list[ExclusionRule]) -> DataFrame:
    """One row about a source tree (file, content): files and lines by extension, roots, modules, frameworks, rules."""
    sources = inventory(files).where(F.col("extension").isin(SOURCE_EXTENSIONS))
    counts = sources.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "files")))).alias("file_counts"), F.coalesce(F.sum("files"), F.lit(0)).alias("source_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("extension") == ".java", F.col("files"))), F.lit(0)).alias("java_files"))
    roots = lambda marker, name: tree_roots(files, marker).agg(F.array_sort(F.collect_set("root")).alias(name))
    maven = poms(files).agg(F.array_sort(F.collect_set("artifact")).alias("modules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("modules")))).alias("maven_modules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("frameworks")))).alias("frameworks"), F.array_sort(F.collect_set("file")).alias("pom_files"))
    d = counts.crossJoin(roots("src/main/", "source_roots")).crossJoin(roots("src/test/", "test_roots")).crossJoin(maven)  # one row each
    rules = F.from_json(F.lit(json.dumps([{"pattern": r.pattern, "category": r.category, "reason": r.reason} for r in policy])), "array<struct<pattern:string,category:string,reason:string>>")
    return d.withColumn("exclusions", rules).withColumn("primary_language", F.when(F.col("java_files") > 0, "Java"))


def architecture_report(modules: DataFrame, components: DataFrame, endpoints: DataFrame, hits: DataFrame) -> str:
    """Markdown from collected aggregates: counts by kind, method, category and the first files of each pattern."""
    part = lambda title, rows: [f"## {title}", "", *[f"- {r['value']}: {r['n']}" for r in rows.orderBy(F.desc("n"), "value").collect()], ""]
    names = modules.select("name").distinct().orderBy("name").collect()
    lines = ["# Architecture", "", f"## Lessons ({len(names)})", "", *[f"- {r['name']}" for r in names], ""]
    lines += part("Components", recon.counts(components, "kind")) + part("Endpoints", recon.counts(endpoints, "method")) + part("Patterns", recon.counts(hits, "category"))
    for r in recon.top_files(hits, TOP).orderBy("category", "pattern").collect():
        more = f" and {r['more']} more" if r["more"] else ""
        lines.append(f"- {r['category']} / {r['pattern']} ({r['hits']}): {', '.join(r['first_files'])}{more}")
    return "\n".join(lines) + "\n"


def experiment_table(metrics: DataFrame) -> DataFrame:
    """A printable row per experiment, in order; no precision is n/a."""
    precision = F.when(F.col("estimated_precision").isNotNull(), F.format_string("%.3f", "estimated_precision")).otherwise("n/a")
    return metrics.orderBy("experiment_id").select("experiment_id", "unique_findings", "validated_findings", "true_positives", "false_positives", precision.alias("precision"), F.format_string("%.1f", F.col("runtime_seconds").cast("double")).alias("seconds"))
