import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators import context, findings, recon, records, rules, symbols
from siltstone.plans import pipeline
from siltstone.schemas import CLASS, FINDING
from siltstone.sources import files as src
from siltstone.sources import sinks

JAVA = '''package org.sample.lessons.sqli;

import java.sql.Statement;
import static java.util.List.*;

/** Class comment { */
@RestController
@RequestMapping("/base")
public class Orders extends Base implements A, B {
    private String quote = "}{";

    @GetMapping("/find")
    public String find(String name) {
        return run("SELECT * FROM t WHERE n = '" + name + "'");
    }

    @PreAuthorize("x")
    String run(String sql) {
        // comment( should not count
        log.info("password " + sql);
        helper(sql);
        return new Thing(sql).toString();
    }

    static class Inner { void helper(String x) { run(x); } }
}
'''
TEST = "package org.sample.lessons.sqli;\nclass OrdersTest {\n    void check() {\n        find(1);\n    }\n}\n"
CONFIG = "spring.password=abcdef\nname=x\n"


def tree(tmp_path):
    at = tmp_path / "src/main/java/org/sample/lessons/sqli"
    at.mkdir(parents=True)
    (at / "Orders.java").write_text(JAVA)
    test = tmp_path / "src/test/java/org/sample/lessons/sqli"
    test.mkdir(parents=True)
    (test / "OrdersTest.java").write_text(TEST)
    (tmp_path / "src/main/resources").mkdir()
    (tmp_path / "src/main/resources/application.properties").write_text(CONFIG)
    (tmp_path / "target").mkdir()
    (tmp_path / "target/Built.java").write_text(JAVA)
    (tmp_path / "pom.xml").write_text("<project><parent><artifactId>p</artifactId></parent><artifactId>own</artifactId><modules><module>a</module></modules><name>spring-boot</name></project>")
    return str(tmp_path)


POLICY = [src.ExclusionRule("**/target/**", "directory_segment", "target", "build", "built")]


def test_files_and_inventory(spark, tmp_path):
    f = src.read_files(spark, tree(tmp_path), rules=POLICY)
    assert {r.file.split("/")[-1] for r in f.collect()} == {"Orders.java", "OrdersTest.java", "application.properties", "pom.xml"}
    got = {r.extension: (r.files, r.lines) for r in src.inventory(f).collect()}
    assert got[".java"] == (2, JAVA.count("\n") + TEST.count("\n"))
    assert [r.root for r in src.tree_roots(f, "src/main/").collect()] == ["src/main"]
    pom = src.poms(f).first()
    assert (pom.artifact, pom.modules, pom.frameworks) == ("own", ["a"], ["Spring Boot"])
    assert [r.name for r in src.lesson_modules(f).collect()] == ["sqli"]


def test_policy_takes_first_rule(spark):
    r = [src.ExclusionRule("a", "suffix", ".min.js", "asset", ""), src.ExclusionRule("b", "directory_segment", "lib", "dep", ""), src.ExclusionRule("c", "path_prefix", "docs/", "doc", "")]
    rows = [("lib/x.min.js",), ("./lib/x.js",), ("docs",), ("docs/a",), ("docsx/a",), ("a\\lib\\b",)]
    got = [x[0] for x in spark.createDataFrame(rows, "p string").select(src.matching_rule(F.col("p"), r)["category"]).collect()]
    assert got == ["asset", "dep", "doc", "doc", None, "dep"]


def test_symbols(spark):
    f = spark.createDataFrame([("a/Orders.java", JAVA)], "file string, content string")
    classes = symbols.index(f)
    rows = classes.orderBy("class_ord").collect()
    orders = rows[0]
    assert (orders.name, orders.qualified_name, orders.kind, orders.extends, orders.implements) == ("Orders", "org.sample.lessons.sqli.Orders", "class", "Base", ["A", "B"])
    assert [a.name for a in orders.annotations] == ["RestController", "RequestMapping"]
    assert [i.statement for i in orders.imports] == ["java.sql.Statement", "java.util.List.*"] and orders.imports[1].is_wildcard
    methods = {m.name: m for m in orders.methods}
    assert methods["find"].endpoint.path == "/base/find" and methods["find"].endpoint.http_method == "GET"
    assert set(methods["run"].calls) == {"run", "info", "helper", "Thing", "toString"}
    ms = symbols.methods(classes)
    line = JAVA.split("\n").index("        helper(sql);") + 1
    hits = spark.createDataFrame([("a/Orders.java", line), ("a/Orders.java", 1), ("b", 3)], "file string, line_no int")
    got = {(r.file, r.line_no): r.symbol for r in symbols.at_line(hits, ms).collect()}
    assert got == {("a/Orders.java", line): "run", ("a/Orders.java", 1): None, ("b", 3): None}
    up = symbols.callers(symbols.edges(ms), spark.createDataFrame([("helper",)], "method string")).collect()
    assert ("Orders", "run", 0) in {(r.caller_class, r.caller_method, r.depth) for r in up} and ("Orders", "find", 1) in {(r.caller_class, r.caller_method, r.depth) for r in up}
    assert symbols.summary(classes).first().endpoints == 1


def test_recon(spark):
    f = spark.createDataFrame([("a/Orders.java", JAVA)], "file string, content string")
    c = recon.components(f).first()
    assert (c.kind, c.class_name, c.package) == ("controller", "Orders", "org.sample.lessons.sqli")
    ends = {(r.annotation, r.method, r.path, r.java_method) for r in recon.endpoints(f).collect()}
    assert ("GetMapping", "GET", "/base/find", "find") in ends and ("RequestMapping", "ANY", "/base/base", "find") in ends


def test_rejection(spark):
    rows = [("a.java", 1, 'q = "SELECT a WHERE b = ?" + x;'), ("a.java", 2, 'response.write(encode(x))'), ("a.java", 3, 'out.println("hi")'), ("a.java", 4, "// out.println(x)"), ("a.java", 5, "out.println(x)")]
    hits = rules.rejected(rules.scan(spark.createDataFrame(rows, "file string, line_no int, line string"), rules.SOURCE_RULES))
    got = {r.line_no: r.rejection_reason for r in hits.collect()}
    assert got == {1: rules.REASONS["parameterised"], 2: rules.REASONS["sanitised"], 3: rules.REASONS["constant"], 5: None}


def test_budget_fold(spark):
    def run(*sizes):
        d = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(sizes)], "g int, k int, c string")
        return context.running_sections(d, "g", "k", F.lit("s"), F.col("c"), 1000).first()

    assert tuple(run(600, 300))[2:] == (2, 900, False)
    assert tuple(run(600, 500))[2:] == (2, 980, False)  # cut to what is left, with the mark
    assert tuple(run(900, 500, 50))[2:] == (2, 950, True)  # skipped; a later short one fits


def test_budget_fold_streams(spark):
    """No array of a key's rows is built; order, null keys and keys over several batches count as before."""
    d = spark.createDataFrame([(2**60 + 1, k, "x" * (7 * k % 50)) for k in range(30_000)] + [(2**60 + 1, -1, "y" * 900), (None, 2, "x" * 2000), (None, 1, "x" * 900), (3, 1, "")], "g long, k int, c string")
    out = context.running_sections(d, "g", "k", F.lit("s"), F.col("c"), 1000)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    chars, kept, over = 900, 1, False
    for n in (7 * k % 50 for k in range(30_000)):
        if n <= 1000 - chars:
            chars, kept = chars + n, kept + 1
        else:
            over = True
    assert {tuple(r) for r in out.collect()} == {(2**60 + 1, 30_001, kept, chars, over), (None, 2, 1, 900, True), (3, 1, 1, 0, False)}


def test_evaluation(spark):
    cols = "finding_id string, file string, cwe string, vulnerability_type string, validation_status string"
    x = spark.createDataFrame([("1", "a", "CWE-1", "X", "validated"), ("2", "a", "CWE-9", "inject", "validated"), ("3", "a", "CWE-1", "X", "unvalidated"), ("4", "b", "CWE-1", "X", "validated"), ("5", "a", "CWE-1", "X", "rejected"), ("6", "a", None, "", "validated")], cols)
    truth = spark.createDataFrame([("g", "SQL Injection", "CWE-1", ["a"], "code", "reviewed"), ("h", "Y", "CWE-2", ["b"], "// comment", "reviewed"), ("i", "Y", "CWE-1", ["b"], "code", "heuristic")], "ground_truth_id string, vulnerability_type string, cwe string, relevant_files array<string>, validation_evidence string, review_status string")
    standing = findings.standing_truth(truth)
    assert [r.ground_truth_id for r in standing.collect()] == ["g"]
    got = {r.finding_id: r.outcome for r in findings.labelled(x, standing, True).collect()}
    assert got == {"1": "tp", "2": "tp", "3": "uncertain", "4": "fp", "5": "fp", "6": "tp"}
    e = findings.evaluation(findings.labelled(x, standing, True), True).first()
    assert (e.true_positives, e.estimated_precision) == (3, 0.6)
    assert findings.evaluation(findings.labelled(x, standing), False).first().estimated_precision is None


def test_verified_sets_lines(spark):
    files = spark.createDataFrame([("a.java", "one\ntwo\nthree\n")], "file string, content string")
    cols = "file string, evidence string, description string, attack_scenario string, recommendation string, sink string, source string, cwe string, data_flow array<string>, start_line string, end_line string"
    row = lambda **k: tuple({"file": "a.java", "evidence": "two\nthree", "description": "d", "attack_scenario": "a", "recommendation": "r", "sink": "s", "source": "q", "cwe": "CWE-89", "data_flow": ["x"], "start_line": "9", "end_line": "9"} .values()) if not k else tuple(({"file": "a.java", "evidence": "two\nthree", "description": "d", "attack_scenario": "a", "recommendation": "r", "sink": "s", "source": "q", "cwe": "CWE-89", "data_flow": ["x"], "start_line": "9", "end_line": "9"} | k).values())
    raw = spark.createDataFrame([row(), row(evidence="four"), row(file="../a.java"), row(source="", cwe="CWE-79"), row(source="", data_flow=[], cwe="CWE-862"), row(sink=" ")], cols)
    got = findings.verified(raw, files).collect()
    assert [(r.start_line, r.end_line, r.cwe) for r in got] == [("2", "3", "CWE-89"), ("2", "3", "CWE-862")]


def test_validator_result(spark):
    said = ['{"status": "Rejected", "confidence": 0.9, "reason": "r"}', "validated", "was rejected", "dunno", '{"status": "odd"}']
    got = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k").select(findings.validator_result(F.col("s"))).collect()]
    assert [(g.status, g.confidence) for g in got] == [("rejected", 0.9), ("validated", 0.8), ("rejected", 0.8), ("uncertain", 0.5), ("uncertain", 0.5)]


def test_sarif_and_json(spark):
    sarif = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "r", "name": "N", "properties": {"tags": ["a", "CWE-12"]}}]}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "./x/../a.java"}, "region": {"startLine": 3}}}]}, {"ruleId": "s"}]}]}
    got = findings.normalised(src.sarif_results(spark.createDataFrame([(json.dumps(sarif),)], "report string")), "e").orderBy("vulnerability_type").collect()
    assert [(g.vulnerability_type, g.cwe, g.severity, g.file, g.start_line, g.end_line, g.tool) for g in got] == [("N", "CWE-12", "high", "a.java", 3, 3, "t"), ("s", None, "medium", "", None, None, "t")]
    docs = ['[{"cwe": "1", "start_line": 9, "end_line": 4, "data_flow": ["a", "b"]}]', '{"findings": [{"cwe": "2", "data_flow": "one"}]}', '{"cwe": "3"}']
    rows = findings.normalised(src.json_results(spark.createDataFrame([(d,) for d in docs], "report string")), "e").orderBy("cwe").collect()
    assert [(r.cwe, r.start_line, r.end_line, r.data_flow, r.tool) for r in rows] == [("CWE-1", 4, 9, ["a", "b"], "json-tool"), ("CWE-2", None, None, ["one"], "json-tool"), ("CWE-3", None, None, [], "json-tool")]


def test_records(spark):
    good = {"candidate_id": "C", "category": "c", "file": "f", "line": 1, "matched_rule": "r", "snippet": "s"}
    lines = [json.dumps(good), json.dumps(good | {"line": 0}), "oops", "[1]", json.dumps({"id": "C9"}), json.dumps(good | {"candidate_id": "D", "file": "/x", "line": True})]
    got = {r.line_no: r.problems for r in records.record_problems(spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")).collect()}
    assert got[1] == [] and got[2] == ["duplicate id", "line must be positive integer or null"] and got[3] == ["invalid JSON syntax"] and got[4] == ["record is not a JSON object"] and got[5] == []
    assert got[6] == ["file path must be relative, not absolute", "line must be positive integer or null"]


def test_pipeline_end_to_end(spark, tmp_path):
    got = pipeline.run(spark, tree(tmp_path / "tree"), POLICY)
    c = {r.matched_rule: r for r in got.candidates.collect()}
    assert {"sqli_string_concat", "access_control_annotation", "config_hardcoded_secret", "logging_sensitive"} <= set(c)
    assert c["sqli_string_concat"].symbol == "find" and not c["sqli_string_concat"].is_rejected
    found = got.findings.collect()
    assert len(found) == 1 and found[0].validation_status == "validated" and found[0].is_canonical and found[0].cwe == "CWE-89"
    ctx = {r.candidate_id: r for r in got.contexts.collect()}[c["sqli_string_concat"].candidate_id]
    labels = [s.label for s in ctx.sections]
    assert labels[:2] == ["sink_function", "class_skeleton_Orders"] and any(x.startswith("callee_L0_") for x in labels) and "endpoint_info" in labels and any(x.startswith("test_") for x in labels)
    assert "caller_L0_OrdersTest.check" in labels and ctx.total_chars == sum(len(s.content) for s in ctx.sections)
    out = str(tmp_path / "out")
    sinks.write_partitioned(got.findings.select(*[x.split(" ")[0] for x in FINDING.split(", ")]), out)
    assert spark.read.json(out).select("bucket").distinct().collect()[0][0] == "validated"
    assert got.usage.count() == got.candidates.where("NOT is_rejected").count()


def fold(lengths, left, room=200, margin=50, mark=len(context.MARK)):
    """Plain fold: what is taken of each (None: skipped), and whether something was skipped."""
    out = []
    for n in lengths:
        if n <= left:
            out.append(n)
            left -= n
        elif left < room:
            out.append(None)
        else:
            out.append(left - margin)
            left -= left - margin + mark
    return out


def test_cut_to_what_a_budget_can_take(spark):
    """Rows that within_budget leaves out are never taken, however much was used before; what it keeps is bounded."""
    import random

    rng = random.Random(1)
    sizes = {
        "few": [rng.randint(1, 300) for _ in range(20)], "short": [rng.randint(1, 60) for _ in range(1500)], "mixed": [rng.choice([1, 3, 50, 150, 199, 200, 201, 500, 2000]) for _ in range(900)],
        "long": [rng.randint(400, 900) for _ in range(300)], "equal": [70] * 2000,
    }
    d = spark.createDataFrame([(k, i, n) for k, v in sizes.items() for i, n in enumerate(v)], "k string, i int, n int")
    kept = {}
    for r in context.within_budget(d, ["k"], ["i"], budget=1000).collect():
        kept.setdefault(r.k, []).append((r.i, r.n))
    for k, v in sizes.items():
        some = sorted(kept[k])
        for left in range(0, 1001, 7):
            want, got = fold(v, left), fold([n for _, n in some], left)
            assert [(i, t) for i, t in enumerate(want) if t is not None] == [(i, t) for (i, _), t in zip(some, got, strict=True) if t is not None]
            assert (None in want) == (None in got)
    assert len(kept["equal"]) < 20 and len(kept["long"]) < 6 and len(kept["few"]) <= 20


def test_contexts_of_a_hot_name(spark, monkeypatch):
    """n files whose method `get` holds a candidate and is called once: names of texts that meet candidates grow with the candidates, not with their square."""
    seen = {}
    keep = context.within_budget

    def counted(rows, key, order, *a):
        out = keep(rows, key, order, *a)
        seen[n] = (rows.count(), out.count())
        return out

    monkeypatch.setattr(context, "within_budget", counted)
    for n in (20, 40, 80):
        text = "package p;\nclass C{k} {\n  void get() {\n    run({k});\n  }\n  void use{k}() {\n    get();\n  }\n}\n"
        files = spark.createDataFrame([(f"p/C{k:03}.java", text.replace("{k}", str(k))) for k in range(n)], "file string, content string")
        classes = symbols.index(files)
        ms = symbols.methods(classes)
        cands = spark.createDataFrame([(f"c{k}", f"p/C{k:03}.java", 4, "x") for k in range(n)], "candidate_id string, file string, line int, category string")
        out = context.assembled(cands, files, classes, ms, symbols.edges(ms), budget=500).collect()
        assert len(out) == n and all(r.total_chars <= 500 for r in out)
        for r in out:
            labels = [s.label for s in r.sections]
            assert labels[0] == "sink_function" and r.sections[0].content == f"  void get() {{\n    run({int(r.candidate_id[1:])});\n  }}"
            assert r.budget_exceeded or n == 20
    assert seen[80][0] > 80 and seen[80][1] <= seen[40][1] + 3 and seen[40][1] < 40


def test_budget_of_a_key_over_many_ranges(spark, request):
    """Chunks of a hot key are functions that are put together; the answer is that of a plain fold."""
    import random

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng = random.Random(5)
    for sizes in ([rng.choice([0, 1, 2, 30, 190, 210, 400]) for _ in range(3000)], [3] * 900, [5000] * 50 + [1] * 400):
        d = spark.createDataFrame([("hot", k, "x" * n) for k, n in enumerate(sizes)] + [(f"k{k:02}", 1, "y" * 20 * k) for k in range(60)] + [(None, 1, None)], "g string, k int, c string")
        got = {r.g: tuple(r)[1:] for r in context.running_sections(d, "g", "k", F.lit("s"), F.col("c"), 1000).collect()}
        assert len(got) == 62
        taken = fold(sizes, 1000)
        used = sum(t if t == n else t + len(context.MARK) for t, n in zip(taken, sizes, strict=True) if t is not None)
        assert got["hot"] == (len(sizes), sum(t is not None for t in taken), used, None in taken)
        assert got["k07"] == (1, 1, 140, False) and got[None] == (1, 1, 0, False) and got["k59"] == (1, 1, 950 + len(context.MARK), False)


def test_cache_hits_and_repeated_ids(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4), ("a", 9)], "k string, o int")
    assert sorted((r.o, r.is_cached) for r in context.with_hits(d, "k", "o").collect()) == [(1, False), (2, False), (3, True), (4, False), (5, True), (9, True)]
    assert sorted((r.k or "-", r.o, r.nth) for r in records.repeated_ids(d, "k", "o").collect()) == [("-", 5, 2), ("a", 3, 2), ("a", 9, 3)]


def test_responses_by_hash(spark, tmp_path):
    """A fixed number of folders, however many requests; one request's rows come from its folder alone."""
    import os

    at = f"file://{tmp_path}/raw"
    sinks.write_responses(spark.range(500).select(F.col("id").alias("request_id"), F.lit("r").alias("response")), at, folders=8)
    assert len([x for x in os.listdir(tmp_path / "raw") if x.startswith("part=")]) == 8
    back = spark.read.schema("request_id long, response string, part int").json(at)
    one = sinks.response_of(back, "77", folders=8)
    assert [r.request_id for r in one.collect()] == [77] and back.count() == 500


def test_pom_of_a_dependency_first(spark):
    """The artifact is a child of the root; a comment's is none."""
    shape = "<project><dependencies><dependency><artifactId>dep</artifactId></dependency></dependencies><!--<artifactId>no</artifactId>--><artifactId>own</artifactId></project>"
    d = spark.createDataFrame([("pom.xml", shape), ("x/pom.xml", "<broken"), ("y/pom.xml", None), ("z/pom.xml", ""), ("other.xml", shape)], "file string, content string")
    assert sorted((r.file, r.artifact, r.modules, r.frameworks) for r in src.poms(d).collect()) == [("pom.xml", "own", [], []), ("x/pom.xml", None, [], []), ("y/pom.xml", None, [], []), ("z/pom.xml", None, [], [])]


def test_lines_meet_spans_without_a_broadcast(spark):
    """Stored tables are small on disk and large in memory; a join by key deals both sides out."""
    files = spark.createDataFrame([(f"a/F{k}.java", f"class F{k} {{\n    void go{k}() {{\n        new RestTemplate();\n    }}\n}}\n") for k in range(20)], "file string, content string")
    classes = symbols.index(files)
    hits = symbols.at_line(rules.scan(src.lines(files), rules.SOURCE_RULES), symbols.methods(classes))
    assert sorted((r.file, r.symbol) for r in hits.collect()) == sorted((f"a/F{k}.java", f"go{k}") for k in range(20))
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()


def test_index_holds_few_files_at_a_time(spark):
    many = pa.RecordBatch.from_pydict({"file": [f"F{k}.java" for k in range(1000)], "content": [f"class F{k} {{\n}}\n" for k in range(1000)]})
    made = [b.num_rows for b in symbols.types_in([many], pa.schema(list(symbols._arrow(StructType.fromDDL(CLASS)))))]
    assert sum(made) == 1000 and max(made) <= symbols.FILES_HELD


def test_needed_words_lose_no_match(spark):
    """A word that every match holds, in any case where the pattern says so; unknown where Java may mean something else."""
    assert rules.needed(r"new\s+ProcessBuilder\s*\(") == ({"ProcessBuilder"}, False)
    assert rules.needed(r"(?i)(?:password|KEY)\s*=") == ({"password", "key"}, True)
    assert rules.needed(r"x(?:abc)?y*")[0] == {"x"}
    assert all(rules.needed(p)[0] == set() for p in (r"[0-9]{16}", r"(?:abc|[0-9]+)", r"(?iu)task", r"\Qa.b\E", r"a\0101", r"(?:abc)*"))
    flat = [rules.Rule(n, c, p, suffixes=("",)) for c, group in rules.SECURITY_PATTERNS.items() for n, p in group] + [rules.Rule(r.id, r.category, r.pattern, suffixes=("",)) for r in rules.SOURCE_RULES + rules.TEXT_RULES]
    texts = ["sElEcT a + b", "PASSWORD = 'hunter22'", 'key="abcd"', "new XMLDecoder(x)", "1234567812345678", "a@b.co", "##%", "LICENCED UNDER x", "1.2.3.4", "Paths.get(a)", "new\tURL (a)", "<!doctype a SYSTEM>", "plain", "csrf()", "Jwts.parser()", "LOG.info(userInput)"]
    lines = spark.createDataFrame([("f.java", k, x) for k, x in enumerate(texts)], "file string, line_no int, line string")
    got = sorted((r.line_no, r.rule_ord) for r in rules.scan(lines, flat).collect())
    tried = lines.select("line_no", *[F.col("line").rlike(r.pattern).alias(str(n)) for n, r in enumerate(flat)]).collect()
    assert got == sorted((r.line_no, n) for r in tried for n in range(len(flat)) if r[str(n)]) and got


def test_document_finds_once(spark):
    """Records and totals come from what was found, not from a second search of the files."""
    files = spark.createDataFrame([("a/lessons/x/C.java", JAVA)], "file string, content string")
    d = recon.document(src.lesson_modules(files), recon.components(files), recon.endpoints(files), rules.pattern_hits(src.lines(files)))
    assert {r["section"] for r in d.collect()} >= {"component", "endpoint", "pattern", "total"}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


def test_contexts_without_a_broadcast_of_rows(spark, monkeypatch):
    """Texts, callers and sections that are small tables are dealt out too; what is broadcast is a row per range."""
    met = []

    def kept(df, name, keep=context.stored):
        df.collect()
        met.append(df)
        return keep(df, name)

    monkeypatch.setattr(context, "stored", kept)
    text = "package p;\n@Service\nclass C{k} {\n  void get{k}() {\n    run();\n  }\n  void use{k}() {\n    get{k}();\n  }\n}\n"
    files = spark.createDataFrame([(f"p/lessons/a/C{k:03}.java", text.replace("{k}", str(k))) for k in range(20)], "file string, content string")
    classes = symbols.index(files)
    ms = symbols.methods(classes)
    cands = spark.createDataFrame([(f"c{k}", f"p/lessons/a/C{k:03}.java", 5, "x") for k in range(20)], "candidate_id string, file string, line int, category string")
    about = context.architecture(src.lesson_modules(files), recon.components(files), recon.endpoints(files), rules.pattern_hits(src.lines(files)))
    out = context.assembled(cands, files, classes, ms, symbols.edges(ms), about)
    assert len(out.collect()) == 20
    joined = [x for d in [*met, out] for x in d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "BroadcastHashJoin" in x]
    assert joined and not [x for x in joined if "run_part" not in x]


def test_two_regions_at_a_file_s_begin(spark):
    """Candidates near the first line have regions that begin alike and end apart; each gets its own, once."""
    files = spark.createDataFrame([("a.html", "".join(f"line {k}\n" for k in range(1, 61)))], "file string, content string")
    classes = symbols.index(files)
    ms = symbols.methods(classes)
    cands = spark.createDataFrame([(f"c{k}", "a.html", k, "x") for k in (2, 5, 40)] + [("c0", "a.html", None, "x"), ("d", "gone.html", 3, "x")], "candidate_id string, file string, line int, category string")
    got = {r.candidate_id: [(s.label, s.start_line, s.end_line, len(s.content.splitlines())) for s in r.sections] for r in context.assembled(cands, files, classes.where("false"), ms, symbols.edges(ms)).collect()}
    assert got == {"c2": [("code_region", 1, 22, 22)], "c5": [("code_region", 1, 25, 25)], "c40": [("code_region", 30, 60, 31)], "c0": [], "d": []}


def test_contexts_are_a_row_per_candidate(spark):
    """What is referred to meets candidates as arrays: the plan of sections has no row per section to put together again."""
    text = "package p;\nclass C{k} {\n  void get{k}() {\n    x.run();\n  }\n  void use{k}() {\n    x.get{k}();\n  }\n}\n"
    files = spark.createDataFrame([(f"p/C{k}.java", text.replace("{k}", str(k))) for k in range(5)], "file string, content string")
    classes = symbols.index(files)
    ms = symbols.methods(classes)
    cands = spark.createDataFrame([(f"c{k}", f"p/C{k}.java", 4, "x") for k in range(5)], "candidate_id string, file string, line int, category string")
    found, _ = context.planned(cands, files, classes, ms, symbols.edges(ms))
    assert {r.candidate_id: [s.label for s in r.taken] for r in found.collect()} == {f"c{k}": ["sink_function", f"class_skeleton_C{k}", f"caller_L0_C{k}.get{k}", f"caller_L0_C{k}.use{k}", f"callee_L0_C{k}.get{k}"] for k in range(5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [candidate_id" in x or "Generate explode(taken" in x]


def test_likely_lines_lose_no_hit(spark):
    """Lines that hold a needed word, found at once for all patterns: every line end, null and empty texts; nothing else is left behind."""
    texts = ["", None, "plain\n\nnew XMLDecoder(x)\r\nkey = 1\rPASSWORD = \"hunter22\"\n", "a\n" * 3, "x\r\n\r\nJwts.parser()", "ſelect + b\nSELECT a + b", "log.info(userInput)\x0bnew File (a)"]
    files = spark.createDataFrame([(f"f{k}.java", x) for k, x in enumerate(texts)], "file string, content string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for found in (rules.SOURCE_RULES, rules._flat(None)):
        near = rules.likely_lines(files, found)
        assert rows(rules.scan(near, found, likely=True)) == rows(rules.scan(src.lines(files), found)) != []
        assert near.where("line IN ('plain', 'a', '')").isEmpty()
    assert rows(rules.pattern_hits_of(files)) == rows(rules.pattern_hits(src.lines(files)))
    odd = [rules.Rule("digits", "x", "[0-9]{2}", suffixes=("",))]
    assert rows(rules.likely_lines(files, odd)) == rows(src.lines(files))


def test_first_span_in_blocks(spark):
    """As at_line, over blocks: the first in order, spans over several blocks, lines outside and null."""
    spans = spark.createDataFrame([("f", 0, 0, "a", 5, 900), ("f", 0, 1, "b", 250, 260), ("f", 1, 0, "c", 1, 300), ("g", 0, 0, "d", 7, 6), ("g", 0, 1, "e", 512, 512)], "file string, class_ord int, method_ord int, name string, start_line int, end_line int")
    hits = spark.createDataFrame([("f", 3), ("f", 255), ("f", 256), ("f", 900), ("f", 901), ("f", None), ("g", 7), ("g", 512), ("h", 1)], "file string, line_no int")
    got = sorted(map(str, symbols.in_blocks(hits, "line_no", symbol=(spans, ("class_ord", "method_ord"))).collect()))
    assert got == sorted(map(str, symbols.at_line(hits, spans).collect())) and "symbol='c'" in "".join(got)


def test_files_are_read_once_for_contexts(spark, tmp_path, monkeypatch):
    """Codes, skeletons, regions and what tests show come from one pass over the files; configuration looks for its few by name."""
    text = "package p;\nclass C{k} {\n  void get{k}() {\n    x.run();\n  }\n}\n"
    spark.createDataFrame([(f"p/C{k}.java", text.replace("{k}", str(k))) for k in range(3)] + [("p/C0Test.java", "class C0Test {\n}\n")], "file string, content string").write.parquet(f"{tmp_path}/files.parquet")
    files, met = spark.read.parquet(f"{tmp_path}/files.parquet"), []

    def kept(df, name, keep=context.stored):
        met.append(df)
        return keep(df, name)

    monkeypatch.setattr(context, "stored", kept)
    classes = context.stored(symbols.index(files), "classes")
    ms = symbols.methods(classes)
    cands = spark.createDataFrame([(f"c{k}", f"p/C{k}.java", line, "x") for k, line in enumerate((4, 1, 4))], "candidate_id string, file string, line int, category string")
    met.clear()
    out = context.assembled(cands, files, classes, ms, symbols.edges(ms))
    got = {r.candidate_id: [(s.label, s.content) for s in r.sections] for r in out.collect()}
    assert got["c0"][0] == ("sink_function", "  void get0() {\n    x.run();\n  }") and got["c0"][-1] == ("test_p/C0Test.java", "class C0Test {\n}") and got["c1"][0][1] == text.replace("{k}", "1").rstrip("\n")
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in [*met, out]]
    assert sum(x.count("content#") > 0 for x in plans) <= 2
