import hashlib

from pyspark.sql import functions as F

from siltstone.functions import findings as f
from siltstone.functions import text as t


def values(spark, column, *inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("x")).alias("y")).collect()]


def test_cwe(spark):
    assert values(spark, f.cwe, "CWE-89", "cwe89", "89", " x ", "", None, "see CWE 79 and 80") == ["CWE-89", "CWE-89", "CWE-89", None, None, None, "CWE-79"]


def test_confidence(spark):
    assert values(spark, f.confidence, "0.5", "7", "-1", "junk", None, "NaN", " 0.25 ") == [0.5, 1.0, 0.0, 0.0, 0.0, 1.0, 0.25]


def test_severity_and_status(spark):
    assert values(spark, f.severity, "CRIT", " Error\t", "warn", "note", "info", "none", "odd", "") == ["critical", "high", "medium", "low", "informational", "informational", "medium", "medium"]
    assert values(spark, f.status, "Validated ", "no", "rejected") == ["validated", "unvalidated", "rejected"]


def test_line(spark):
    assert values(spark, f.line, "5", "0", "-3", "3.9", " 7 ", "x", None, "99999999999") == [5, None, None, None, 7, None, None, None]
    assert values(spark, f.line_number, 3.9, 0.5, float("nan"), kind="double") == [3, None, None]


def test_finding_id(spark):
    got = values(spark, lambda x: f.finding_id(F.lit("e"), x, F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(" SQL ")), "a.java")
    assert got == ["WG-" + hashlib.sha256(b"e|a.java|null|null|sql").hexdigest()[:8]]


def test_dedup_key_buckets_lines(spark):
    key = lambda line: f.dedup_key(F.lit("A"), F.lit("cwe-1"), F.lit("F"), F.lit(None).cast("string"), line, F.lit("s"), F.lit(" e "))
    a, b, c, d, e = values(spark, key, 1, 9, None, 19, 20, kind="int")
    assert a == b == c and d != e and a != d
    raw = f"a:CWE-1:f::0:s:{hashlib.md5(b'e').hexdigest()[:8]}"
    assert a == hashlib.sha256(raw.encode()).hexdigest()[:16]


def test_paths(spark):
    clean = lambda x: t.clean_path(x, "/root/src")
    assert values(spark, clean, "./a//b/../c.java", "/root/src/x/y.java", "", "../up", "a\\b", "/etc/x", "..") == ["a/c.java", "x/y.java", "", "../up", "a/b", "../../etc/x", ".."]
    assert values(spark, lambda x: t.endpoint_path(F.lit("/base/"), x), "/p/", "", "q") == ["/base/p", "/base", "/base/q"]
    assert values(spark, lambda x: t.endpoint_path(F.lit(""), x), "", "/") == ["/", "/"]
    assert values(spark, t.module_of, "src/lessons/sqli/A.java", "src/A.java", "lessons") == ["sqli", "core", "core"]


def test_lines(spark):
    assert values(spark, t.lines_of, "a\r\nb\n\nc\n", "", "x", "a\rb") == [["a", "b", "", "c"], [], ["x"], ["a", "b"]]
    assert values(spark, lambda x: t.line_range(t.lines_of(x), 2, 9, 2), "1\n2\n3\n4", "1") == ["2\n3\n// ... [truncated]", ""]
    assert values(spark, lambda x: t.head(t.lines_of(x), 2), "1\n2\n3", "1\n2") == ["1\n2\n// ... [file truncated]", "1\n2"]


def test_fenced_json(spark):
    assert values(spark, t.fenced_json, 'x ```json\n{"a": 1}\n``` y', '```\n[1]\n```', '{"b": 2}', "no", "```json\nbad\n```") == ['{"a": 1}', "[1]", '{"b": 2}', None, None]


def test_tokens(spark):
    assert values(spark, t.tokens_estimated, "", "abc", "a" * 9) == [1, 1, 2]


def test_fields_are_worked_out_once(spark):
    """A severity's or a line's text is stripped once and not per entry or use; a path without '..' needs no fold to be cleaned."""
    d = spark.createDataFrame([("/a/./b//c.java", " 7 ", " NOTE"), ("./.x/", "+007", "odd"), ("a/../b", "0", None), ("..a/./", "1.5", "crit"), ("//", "-1", "")], "file string, line string, severity string")
    plan = d.select(f.severity(F.col("severity")).alias("s"), f.line(F.col("line")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 2
    got = d.select(t.clean_path(F.col("file")), f.line(F.col("line")), f.severity(F.coalesce("severity", F.lit("")))).collect()
    assert list(map(tuple, got)) == [("/a/b/c.java", 7, "low"), (".x", 7, "medium"), ("b", None, "medium"), ("..a", None, "critical"), ("/", None, "medium")]
