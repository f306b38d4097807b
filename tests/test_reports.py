import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siltstone import __main__ as cli
from siltstone.operators import recon, rules
from siltstone.plans import pipeline, reports
from siltstone.sources import files as src
from siltstone.sources import scratch, sinks

from .test_operators import JAVA, POLICY, tree


def test_manifest_and_report(spark, tmp_path):
    f = src.read_files(spark, tree(tmp_path), rules=POLICY)
    m = reports.manifest(f, POLICY).first()
    assert m.java_files == 2 and m.file_counts[".properties"] == 1 and m.source_roots == ["src/main"] and m.test_roots == ["src/test"]
    assert m.modules == ["own"] and m.maven_modules == ["a"] and m.frameworks == ["Spring Boot"] and m.exclusions[0].category == "build" and m.primary_language == "Java"
    java = spark.createDataFrame([("a/lessons/sqli/Orders.java", JAVA)], "file string, content string")
    text = reports.architecture_report(src.lesson_modules(java), recon.components(java), recon.endpoints(java), rules.pattern_hits(src.lines(java)))
    assert "## Lessons (1)" in text and "- controller: 1" in text and "- GET: 1" in text and "database / SQL string concat (1): a/lessons/sqli/Orders.java" in text


def test_settings(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# x\nmodel: 'm'\nconcurrency: 4 # four\nlist:\n  - a\n")
    assert reports.read_settings(spark, f"file://{tmp_path}/c.yaml") == {"model": "m", "concurrency": "4"}
    assert reports.read_settings(spark, f"file://{tmp_path}/none.yaml") == {}


def test_commands(spark, tmp_path):
    root, out = tree(tmp_path / "t"), f"file://{tmp_path}/out"
    case = {"ground_truth_id": "G1", "vulnerability_type": "SQL Injection", "cwe": "CWE-89", "relevant_files": ["src/main/java/org/sample/lessons/sqli/Orders.java"], "validation_evidence": "SELECT * FROM t", "review_status": "reviewed"}
    (tmp_path / "truth.jsonl").write_text(json.dumps(case) + "\n" + json.dumps(case | {"ground_truth_id": "G2", "relevant_files": ["x"]}) + "\n")
    assert cli.main(["scan", root, f"{out}/exp1", "--experiment", "exp1", "--truth", f"file://{tmp_path}/truth.jsonl"], spark) == 0
    outcomes = {r.finding_id: r.outcome for r in spark.read.json(f"{out}/exp1/outcomes").collect()}
    sum_up = spark.read.json(f"{out}/exp1/metrics.json").first()
    assert "tp" in outcomes.values() and sum_up.true_positives == sum(o == "tp" for o in outcomes.values()) and "indexing" in sum_up.phase_durations.asDict()
    assert "# Architecture" in spark.read.text(f"{out}/exp1/architecture_map.md", wholetext=True).first()[0] and spark.read.json(f"{out}/exp1/run").first().experiment_id == "exp1"
    found = spark.read.json(f"{out}/exp1/findings").collect()
    assert {r.cwe for r in found} == {"CWE-89"} and {r.duplicate_of for r in found} == {None}
    assert cli.main(["dedup", f"{out}/exp1/findings", f"{out}/again"], spark) == 0
    assert spark.read.json(f"{out}/again/canonical").count() == len(found)
    table = reports.experiment_table(src.read_metrics(spark, out).withColumn("estimated_precision", F.lit(None).cast("double"))).first()
    assert table.experiment_id == "exp1" and table.precision == "n/a" and table.unique_findings == len(found)
    reports_in = tmp_path / "r"
    reports_in.mkdir()
    (reports_in / "a.json").write_text(json.dumps([{"cwe": "79", "file": "x"}]))
    (reports_in / "b.json").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "q", "message": {"text": "m"}}]}]}))
    assert cli.main(["convert", f"file://{reports_in}", f"{out}/conv"], spark) == 0
    assert sorted(r.tool for r in spark.read.json(f"{out}/conv").collect()) == ["json-tool", "t"]
    (tmp_path / "bad.jsonl").write_text('{"candidate_id": 1}\n')
    assert cli.main(["check", f"file://{tmp_path}/bad.jsonl"], spark) == 1
    assert cli.main(["manifest", root, f"{out}/m"], spark) == 0 and cli.main(["candidates", root, f"{out}/c"], spark) == 0 and cli.main(["index", root, f"{out}/i"], spark) == 0


def test_a_run_with_data_is_refused(spark, tmp_path):
    d, at = spark.range(1), f"file://{tmp_path}/once"
    sinks.write_json(d, at)
    with pytest.raises(AnalysisException):
        sinks.write_json(d, at)


def test_shared_folder_on_a_cluster(monkeypatch):
    """Off a local master a folder of this machine isn't taken for a shared one."""

    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Session())


def test_validation_prompt(spark):
    found = spark.createDataFrame([("F1", "CWE-89", None)], "finding_id string, cwe string, validator string")
    text = pipeline.validation_prompts(found, F.lit("CODE"), "JUDGE").first().full_prompt
    head, body = text.split("\n\n=== FINDING TO VALIDATE ===\n")
    finding, code = body.split("\n\n=== CODE CONTEXT ===\n")
    assert head == "JUDGE" and code == "CODE\n" and json.loads(finding) == {"finding_id": "F1", "cwe": "CWE-89", "validator": None}
