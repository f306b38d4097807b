"""python -m siltstone COMMAND ...: the library from a shell.

scan ROOT OUT        scan a source tree with the model stub, write all relations
candidates ROOT OUT  candidates only
index ROOT OUT       types, methods and call edges
manifest ROOT OUT    one row about the tree
convert IN OUT       SARIF or JSON reports (a file each) to finding rows
dedup IN OUT         finding rows to canonical ones and their duplicates
check IN             what is wrong with a JSON-lines file
summary FOLDER       a table of the experiments below a folder
"""

from __future__ import annotations

import argparse
import json
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import findings, recon, records, rules, symbols
from .plans import pipeline, reports
from .sources import files as src
from .sources import sinks
from .sources.scratch import shared_dir, write_files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["scan", "candidates", "index", "manifest", "convert", "dedup", "check", "summary"])
    p.add_argument("paths", nargs="+")
    p.add_argument("--policy", help="exclusion rules, a JSON file")
    p.add_argument("--experiment", default="experiment")
    p.add_argument("--no-validation", action="store_true")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--truth", help="reviewed cases, JSON lines")
    p.add_argument("--truth-complete", action="store_true", help="the cases cover the tree, so precision can be told")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    shared_dir(spark)
    policy = src.read_policy(spark, a.policy) if a.policy else []
    at, out = a.paths[0], a.paths[-1]
    if a.command == "scan":
        began, started = time.monotonic(), datetime.now(UTC).isoformat(timespec="milliseconds")
        truth = src.read_ground_truth(spark, a.truth) if a.truth else None
        s = pipeline.run(spark, at, policy, a.experiment, not a.no_validation, not a.no_index, truth, a.truth_complete)
        sinks.write_json(s.candidates, f"{out}/candidates")
        sinks.write_json(s.raw, f"{out}/raw_findings")
        sinks.write_json(s.findings.where("is_canonical"), f"{out}/findings")
        sinks.write_partitioned(s.findings.where("is_canonical"), f"{out}/by_status")
        sinks.append_usage(s.usage, f"{out}/usage")
        sinks.write_json(findings.outcome_ids(s.outcomes), f"{out}/outcomes")
        result = findings.evaluation(s.outcomes, a.truth_complete)
        sinks.write_json(findings.metrics(s.findings, s.usage, result, a.experiment, round(time.monotonic() - began, 3), s.seconds), f"{out}/metrics.json")
        java = s.files.where(F.col("file").endswith(".java"))
        found = src.lesson_modules(java), recon.components(java), recon.endpoints(java), rules.pattern_hits(src.lines(java))
        sinks.write_json(recon.document(*found), f"{out}/reconnaissance")
        write_files(spark, out, {"architecture_map.md": reports.architecture_report(*found)})
        sinks.write_json(spark.sql("SELECT :e AS experiment_id, :r AS source_root, parse_json(:p) AS phases, :s AS started_at, date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\") AS finished_at", args={"e": a.experiment, "r": at, "p": json.dumps(s.seconds), "s": started}), f"{out}/run")
    elif a.command in ("candidates", "index", "manifest"):
        f = src.read_files(spark, at, () if a.command == "manifest" else pipeline.SUFFIXES, policy, any_case=True)
        if a.command == "manifest":
            sinks.write_json(reports.manifest(f, policy), out)
        elif a.command == "candidates":
            sinks.write_json(pipeline.discover(spark, f), out)
        else:
            classes = symbols.index(f.where(F.col("file").endswith(".java"))).checkpoint()
            sinks.write_json(classes, f"{out}/classes")
            sinks.write_json(symbols.edges(symbols.methods(classes)), f"{out}/edges")
            sinks.write_json(symbols.summary(classes), f"{out}/summary")
    elif a.command == "convert":
        texts = spark.read.text(at, wholetext=True).withColumnRenamed("value", "report")
        sarif = F.get_json_object("report", "$.runs").isNotNull()
        raw = src.sarif_results(texts.where(sarif)).unionByName(findings.claimed(src.json_results(texts.where(~sarif))).drop("is_vulnerable"), allowMissingColumns=True)
        sinks.write_json(findings.normalised(raw, a.experiment), out)
    elif a.command == "dedup":
        good, bad = src.read_findings(spark, at)
        done = findings.deduplicated(good)
        sinks.write_json(done.where("is_canonical"), f"{out}/canonical")
        sinks.write_json(done.where("NOT is_canonical"), f"{out}/duplicates")
        print(f"malformed lines: {bad.count()}")
    elif a.command == "check":
        text = spark.read.text(at, wholetext=True).withColumn("file", F.input_file_name())
        wrong = records.record_problems(src.lines(text, "file", "value")).where(F.size("problems") > 0)
        n = wrong.count() + text.where(records.file_is_array(F.col("value"))).count()
        wrong.orderBy("line_no").show(20, truncate=False)
        return int(n > 0)
    else:
        reports.experiment_table(src.read_metrics(spark, at)).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
