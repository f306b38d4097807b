"""Queries over the test tables, each with the SQL that says the same.

Every query applies library operators to whole tables; the SQL is written on its own, from
the meaning, for another engine to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import findings as f
from ..functions import text as t
from ..operators import context, findings, recon, records, rules, symbols
from ..sources import files as src
from ..sources.scratch import stored
from ..sources.sinks import bucket
from ..sources.tables import spread, table
from .registry import QUERIES, SQL, query

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _doc_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt and their text."""
    return _docs(spark, d).select(F.format_string("%s/%s/%d.txt", "source", "lang", "doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("content"))


_FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file, coalesce(text, '') AS content FROM documents)"
_LINES = (
    _FILES
    + r""", cut AS (SELECT file, regexp_split_to_array(content, '\r\n|\n|\r') AS ls FROM files),
kept AS (SELECT file, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END AS ls FROM cut),
lines AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM kept)"""
)
_STRIP = r"regexp_replace({0}, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')"
_SPOKEN = f"{_STRIP.format('line')} <> '' AND NOT starts_with({_STRIP.format('line')}, '//') AND NOT starts_with({_STRIP.format('line')}, '*')"


def _rules_sql(catalog: list[rules.Rule]) -> str:
    rows = ",\n ".join("({}, '{}', '{}', '{}', '{}')".format(k, r.id, r.category, r.priority, r.pattern.replace("'", "''")) for k, r in enumerate(catalog))
    return f"catalog(rule_ord, matched_rule, category, priority, pattern) AS (VALUES {rows})"


_HITS = f"{_LINES}, {_rules_sql(rules.TEXT_RULES)}, hits AS (SELECT file, line_no, line, rule_ord, matched_rule, category, priority FROM lines, catalog WHERE {_SPOKEN} AND regexp_matches(line, pattern))"


@query(f"WITH {_LINES} SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(max(length(line)) AS INTEGER) AS longest FROM lines GROUP BY file")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of whole texts, per file."""
    return src.lines(_doc_files(spark, d)).groupBy("file").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.max(F.length("line")).alias("longest"))


@query(f"WITH {_FILES} SELECT '.txt' AS extension, count(*) AS files, CAST(sum(length(content) - length(replace(content, chr(10), ''))) AS BIGINT) AS lines FROM files")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files and line feeds per extension."""
    return src.inventory(_doc_files(spark, d))


_POLICY = [
    src.ExclusionRule("**/de/**", "directory_segment", "de", "language", "German pages"),
    src.ExclusionRule("*5", "suffix", "5", "number", "numbers that end in five"),
    src.ExclusionRule("http:/m/**", "path_prefix", "http://m.", "mobile", "mobile hosts"),
    src.ExclusionRule("**/en/**", "directory_segment", "en", "english", "English pages"),
]


@query("""
SELECT category, count(*) AS n FROM (SELECT CASE
  WHEN list_contains(string_split(ltrim(url, '/'), '/'), 'de') THEN 'language' WHEN ends_with(url, '5') THEN 'number'
  WHEN url = 'http://m.' OR starts_with(url, 'http://m./') THEN 'mobile' WHEN list_contains(string_split(ltrim(url, '/'), '/'), 'en') THEN 'english' ELSE 'kept' END AS category FROM pages) GROUP BY category""")
def exclusion_filter(spark: SparkSession, d: str) -> DataFrame:
    """the first rule that matches a path."""
    return table(spark, d, "pages").select(F.coalesce(src.matching_rule(F.col("url"), _POLICY)["category"], F.lit("kept")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.scan(src.lines(_doc_files(spark, d)), rules.TEXT_RULES)


@query(f"WITH {_HITS} SELECT matched_rule, category, priority, count(*) AS hits, count(DISTINCT file) AS files FROM hits GROUP BY ALL")
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every rule over every line."""
    return _hits(spark, d).groupBy("matched_rule", "category", "priority").agg(F.count("*").alias("hits"), F.count_distinct("file").alias("files"))


@query(f"WITH {_HITS} SELECT 'CAND-WG-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS candidate_id, file, line_no, matched_rule FROM (SELECT *, row_number() OVER (ORDER BY string_split(file, '/'), line_no, rule_ord) AS n FROM hits)")
def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers in path order."""
    return rules.numbered(_hits(spark, d)).select("candidate_id", "file", F.col("line_no").cast("bigint").alias("line_no"), "matched_rule")


@query(
    f"WITH {_HITS}, reasons AS (SELECT *, regexp_extract(line, '\\(([^)]+)\\)', 1) AS arg FROM hits) "
    + r"""SELECT matched_rule, coalesce(reason, 'none') AS reason, CASE WHEN reason IS NULL THEN priority ELSE 'low' END AS priority, count(*) AS n FROM (
SELECT *, CASE WHEN regexp_matches(line, '(?i)\b(htmlEscape|clean|encode|sanitize|safePath|normalize|validate|ESAPI)\b') THEN 'Sanitizer or encoding function detected on line'
 WHEN arg <> '' AND regexp_matches(arg, '^\s*["''][^"'']*["'']\s*$') THEN 'Argument appears to be a constant string literal' END AS reason FROM reasons) GROUP BY ALL"""
)
def early_rejection(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that rejects a match."""
    return rules.rejected(_hits(spark, d)).groupBy("matched_rule", F.coalesce("rejection_reason", F.lit("none")).alias("reason"), "priority").agg(F.count("*").alias("n"))


#: Patterns of pages, beside those of sources, which pages seldom have.
_PAGE_PATTERNS = {"markup": [("script", "<script"), ("link", 'href="[^"]*"'), ("inline style", "<style>"), ("comment", "<!--")], "text": [("entity", "&[a-z]+;"), ("noise", "[#*%&$][#*%&$][#*%&$]")]} | rules.SECURITY_PATTERNS
_PATTERNS = ",\n ".join("('{}', '{}', '{}')".format(c, n, p.replace("'", "''")) for c, group in _PAGE_PATTERNS.items() for n, p in group)


@query(rf"""
WITH cut AS (SELECT CAST(page_id AS VARCHAR) || '.html' AS file, regexp_split_to_array(coalesce(html, ''), '\r\n|\n|\r') AS ls FROM pages),
lines AS (SELECT file, unnest(ls) AS line FROM cut), catalog(category, pattern, regex) AS (VALUES {_PATTERNS}),
s AS (SELECT file, {_STRIP.format("line")} AS line FROM lines)
SELECT category, pattern, count(*) AS hits, CAST(count(DISTINCT file) AS INTEGER) AS n_files, CAST(greatest(0, count(DISTINCT file) - 5) AS INTEGER) AS more, array_to_string(list_sort(list(DISTINCT file))[1:5], ',') AS first_files
FROM s, catalog WHERE line <> '' AND NOT starts_with(line, '//') AND NOT starts_with(line, '*') AND regexp_matches(line, regex) GROUP BY category, pattern""")
def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    """Security patterns over page sources."""
    pages = spread(table(spark, d, "pages")).select(F.format_string("%d.html", "page_id").alias("file"), F.coalesce("html", F.lit("")).alias("content"))
    return recon.top_files(rules.pattern_hits(src.lines(pages), _PAGE_PATTERNS)).withColumn("first_files", F.array_join("first_files", ","))


@query("""
SELECT page_id, coalesce(nullif(rtrim(rtrim(regexp_extract(url, '^[a-z]+://[^/]+/?', 0), '/') || '/' || ltrim(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '/'), '/'), ''), '/') AS path,
  CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method FROM pages""")
def endpoint_paths(spark: SparkSession, d: str) -> DataFrame:
    """Joined paths and default methods."""
    p = table(spark, d, "pages")
    base, path = F.regexp_extract("url", "^[a-z]+://[^/]+/?", 0), F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1)
    verb = f.choose(F.col("page_id") % 3, {0: "GET", 1: "POST"}, "ANY")
    return p.select("page_id", t.endpoint_path(base, path).alias("path"), verb.alias("method"))


@query(r"""
SELECT event_id, CAST(greatest(0.0, least(1.0, value / 50)) AS DOUBLE) AS confidence, CASE event_type WHEN 'error' THEN 'high' ELSE 'medium' END AS severity,
  CAST(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INTEGER) AS line, 'CWE-' || nullif(regexp_extract(props, '([0-9]+)', 1), '') AS cwe,
  CASE WHEN event_id % 2 = 0 THEN 'validated' ELSE 'unvalidated' END AS status
FROM events WHERE coalesce(CAST(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INTEGER), 0) >= 1""")
def normalised_fields(spark: SparkSession, d: str) -> DataFrame:
    """P1, P4 to P7 over messy event fields."""
    e = table(spark, d, "events")
    number = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    state = F.when(F.col("event_id") % 2 == 0, " Validated\t").otherwise(F.col("event_type"))
    return e.select("event_id", f.confidence((F.col("value") / 50).cast("string")).alias("confidence"), f.severity(F.concat(F.lit(" "), F.upper("event_type"))).alias("severity"), f.line(number).alias("line"), f.cwe(F.col("props")).alias("cwe"), f.status(state).alias("status")).where("line IS NOT NULL")


@query("SELECT doc_id, 'WG-' || substr(sha256('exp|' || source || '|' || CASE WHEN n_chars % 7 = 0 THEN 'null' ELSE CAST(n_chars AS VARCHAR) END || '|' || CASE WHEN lang = 'en' THEN 'null' ELSE 'CWE-' || doc_id END || '|' || lower(lang)), 1, 8) AS finding_id FROM documents")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids."""
    x = table(spark, d, "documents")
    line = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars"))
    cwe = F.when(F.col("lang") != "en", F.concat(F.lit("CWE-"), F.col("doc_id").cast("string")))
    return x.select("doc_id", f.finding_id(F.lit("exp"), F.col("source"), line, cwe, F.concat(F.lit(" "), F.upper("lang"), F.lit("\t"))).alias("finding_id"))


@query("SELECT doc_id, sha256(coalesce(text, '') || ':v1:' || source || ':investigation:' || n_chars) AS cache_key, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS tokens, CAST(n_chars // 4 AS INTEGER) AS budget FROM documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys and token estimates of whole texts."""
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", t.cache_key(text, F.lit("v1"), F.col("source"), F.lit("investigation"), F.col("n_chars").cast("string")).alias("cache_key"), t.tokens_estimated(text).alias("tokens"), t.budget_tokens(F.col("n_chars")).alias("budget"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """A label per document: the highest, where it has several."""
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as findings: equal texts are equal evidence."""
    x, labels = _docs(spark, d), _labels(spark, d)
    state = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "uncertain").otherwise("unvalidated")
    return x.join(labels, "doc_id", "left").select(
        F.format_string("F%07d", "doc_id").alias("finding_id"), F.lit("Repeat").alias("vulnerability_type"), F.concat(F.lit("cwe-"), F.col("lang")).alias("cwe"), F.lit("a.txt").alias("file"), F.lit(None).cast("string").alias("function"),
        (F.col("n_chars") % 40).cast("int").alias("start_line"), F.lit("Sink").alias("sink"), F.col("text").alias("evidence"), F.array(F.lit("a")).alias("data_flow"), (F.col("doc_id") % 10 / 10).alias("confidence"),
        state.alias("validation_status"), F.lit(None).cast("string").alias("duplicate_of"), "source",
    )


_DEDUP = rf"""WITH fnd AS (
SELECT 'F' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') AS finding_id, coalesce(text, '') AS evidence, (d.doc_id % 10) / 10 AS confidence, lang, source,
  CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 3 WHEN quality = 0 THEN 1 ELSE 2 END AS rank,
  CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'validated' WHEN quality = 0 THEN 'uncertain' ELSE 'unvalidated' END AS status,
  substr(sha256('repeat:' || upper('cwe-' || lang) || ':a.txt::' || CAST(((n_chars % 40) // 10) * 10 AS VARCHAR) || ':sink:' || CASE WHEN coalesce(text, '') = '' THEN '' ELSE substr(md5({_STRIP.format("text")}), 1, 8) END), 1, 16) AS dedup_key
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
best AS (SELECT *, row_number() OVER w AS place, first_value(finding_id) OVER w AS first_id FROM fnd WINDOW w AS (PARTITION BY dedup_key ORDER BY rank DESC, confidence DESC, length(evidence) DESC, finding_id))"""


@query(_DEDUP + " SELECT dedup_key, finding_id AS canonical_id, n FROM best JOIN (SELECT dedup_key, count(*) AS n FROM fnd GROUP BY dedup_key) USING (dedup_key) WHERE place = 1")
def dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and their canonical finding."""
    x = findings.deduplicated(_findings(spark, d))
    return x.groupBy("dedup_key").agg(F.max(F.when(F.col("is_canonical"), F.col("finding_id"))).alias("canonical_id"), F.count("*").alias("n"))


@query(_DEDUP + " SELECT finding_id, first_id AS duplicate_of FROM best WHERE place > 1")
def dedup_links(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates and what they duplicate."""
    return findings.deduplicated(_findings(spark, d)).where("NOT is_canonical").select("finding_id", "duplicate_of")


@query(_DEDUP + " SELECT source, count(*) AS raw, count(*) FILTER (place > 1) AS duplicates, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (place > 1) / CAST(count(*) AS DOUBLE), 4) ELSE 0.0 END AS duplicate_rate FROM best GROUP BY source")
def dedup_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of duplicates per source."""
    x = findings.deduplicated(_findings(spark, d)).groupBy("source").agg(F.count("*").alias("raw"), F.count_if(~F.col("is_canonical")).alias("duplicates"))
    return x.withColumn("duplicate_rate", findings.ratio(F.col("duplicates"), F.col("raw"), 4))


@query(_DEDUP + " SELECT CASE WHEN status IN ('validated', 'rejected') THEN status ELSE 'uncertain' END AS bucket, count(*) AS n FROM fnd GROUP BY 1")
def status_partition(spark: SparkSession, d: str) -> DataFrame:
    """The three-way partition by status."""
    return _findings(spark, d).groupBy(bucket(F.col("validation_status")).alias("bucket")).agg(F.count("*").alias("n"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """A case per labelled document, reviewed if it is of quality: its last line is the evidence, in its own file and the next."""
    x = _docs(spark, d).join(_labels(spark, d), "doc_id")
    lines = F.filter(t.lines_of(F.coalesce("text", F.lit(""))), lambda l: t.strip(l) != "")
    return x.select(F.format_string("GT-%d", "doc_id").alias("ground_truth_id"), F.concat(F.lit("noise in "), F.col("lang")).alias("vulnerability_type"), F.concat(F.lit("CWE-"), F.col("lang")).alias("cwe"), F.array(F.format_string("%d.txt", "doc_id"), F.format_string("%d.txt", F.col("doc_id") + 1)).alias("relevant_files"), F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")).alias("validation_evidence"), F.when(F.col("quality") == 1, "reviewed").otherwise("heuristic").alias("review_status"))


_TR = rf"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
tr AS (SELECT d.doc_id, {_STRIP.format("coalesce(ls[len(ls)], '')")} AS evidence FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: {_STRIP.format("x")} <> '') AS ls FROM documents) d JOIN lab USING (doc_id) WHERE quality = 1),
code AS (SELECT * FROM tr WHERE evidence <> '' AND NOT starts_with(evidence, '* SPDX-') AND NOT starts_with(evidence, '//') AND NOT starts_with(evidence, '/*') AND NOT starts_with(evidence, 'import '))"""


@query(rf"WITH {_TR} SELECT DISTINCT 'GT-' || code.doc_id AS ground_truth_id FROM code JOIN documents d ON d.doc_id IN (code.doc_id, code.doc_id + 1) WHERE contains(d.text, evidence)")
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed cases whose evidence stands in one of their files."""
    files = _docs(spark, d).select(F.format_string("%d.txt", "doc_id").alias("file"), F.col("text").alias("content"))
    return findings.standing_truth(_truth(spark, d), files).select("ground_truth_id")


def _outcomes(spark: SparkSession, d: str, complete: bool) -> DataFrame:
    x = _docs(spark, d).join(_labels(spark, d), "doc_id").select(F.format_string("F%07d", "doc_id").alias("finding_id"), F.format_string("%d.txt", "doc_id").alias("file"), F.concat(F.lit("CWE-"), F.col("lang")).alias("cwe"), F.lit("Noise").alias("vulnerability_type"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "validated").otherwise("uncertain").alias("validation_status"))
    return findings.labelled(x, findings.standing_truth(_truth(spark, d)), complete)


_OUT = rf"""WITH {_TR}, ok AS (SELECT DISTINCT doc_id + k AS doc_id FROM code, (VALUES (0), (1)) v(k)),
o AS (SELECT 'F' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') AS finding_id, CASE WHEN toxic = 1 THEN 'fp' WHEN ok.doc_id IS NOT NULL AND quality = 1 THEN 'tp' WHEN quality <> 1 OR ok.doc_id IS NOT NULL THEN 'uncertain' ELSE 'fp' END AS outcome
 FROM documents d JOIN lab USING (doc_id) LEFT JOIN ok USING (doc_id))"""


@query(_OUT + " SELECT finding_id, outcome FROM o")
def truth_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each finding against reviewed cases."""
    return _outcomes(spark, d, True).select("finding_id", "outcome")


@query(_OUT + " SELECT count(*) FILTER (outcome = 'tp') AS true_positives, count(*) FILTER (outcome = 'fp') AS false_positives, count(*) FILTER (outcome = 'uncertain') AS uncertain, round(count(*) FILTER (outcome = 'tp') / CAST(count(*) FILTER (outcome <> 'uncertain') AS DOUBLE), 4) AS estimated_precision, 'local_ground_truth' AS precision_type FROM o")
def precision_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of outcomes and precision."""
    return findings.evaluation(_outcomes(spark, d, True), True).select("true_positives", "false_positives", "uncertain", "estimated_precision", "precision_type")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    e = context.with_hits(table(spark, d, "events"), "props", "event_id", "hit")
    return e.select(F.col("event_type").alias("phase"), F.length("props").cast("long").alias("input_tokens"), (F.col("user_id") % 5).alias("output_tokens"), (F.length("props") + F.col("user_id") % 5).cast("long").alias("total_tokens"), F.col("hit").alias("is_cached"), (F.col("event_id") % 3).alias("retry_count"), (F.col("event_id") % 8 / 8).alias("latency_seconds"), F.when(F.col("user_id") % 2 == 0, "provider").alias("token_measurement"))


_USE = "WITH u AS (SELECT event_type AS phase, length(props) AS i, user_id % 5 AS o, row_number() OVER (PARTITION BY props ORDER BY event_id) > 1 AS hit, event_id % 3 AS retries, (event_id % 8) / 8 AS latency, CASE WHEN user_id % 2 = 0 THEN 'provider' ELSE 'character_estimate' END AS m FROM events)"


@query(_USE + """ SELECT phase, count(*) AS llm_calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) FILTER (hit) AS cached_calls, CAST(sum(retries) AS BIGINT) AS retries,
 round(avg(latency), 3) AS average_latency_seconds, array_to_string(list_sort(list(DISTINCT m)), ', ') AS token_measurement, round(sum(retries) / CAST(count(*) AS DOUBLE), 4) AS retry_rate, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 4) AS cache_hit_rate FROM u GROUP BY phase""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A5: usage per phase."""
    return findings.usage_rollup(_usage(spark, d), "phase")


@query(_USE + " SELECT phase, hit AS is_cached, count(*) AS n FROM u GROUP BY phase, hit")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """An earlier row with the same key is a hit."""
    return _usage(spark, d).groupBy("phase", "is_cached").agg(F.count("*").alias("n"))


@query(f"""WITH {_HITS}, spans(class_ord, name, a, z) AS (VALUES (0, 'head', 1, 3), (1, 'middle', 3, 8), (1, 'inner', 5, 6), (2, 'tail', 8, 40)),
r AS (SELECT file, line_no, matched_rule, min((class_ord, name)) AS s FROM hits LEFT JOIN spans ON line_no BETWEEN a AND z GROUP BY file, line_no, matched_rule)
SELECT file, line_no, matched_rule, struct_extract_at(s, 2) AS symbol FROM r""")
def symbol_at_line(spark: SparkSession, d: str) -> DataFrame:
    """The first span in order that holds a line, or none."""
    rows = [(0, "head", 1, 3), (1, "middle", 3, 8), (1, "inner", 5, 6), (2, "tail", 8, 40)]
    spans = _doc_files(spark, d).select("file").crossJoin(F.broadcast(spark.createDataFrame(rows, "class_ord int, name string, start_line int, end_line int")))  # four spans in every file
    hits = _hits(spark, d).select("file", F.col("line_no").cast("bigint").alias("line_no"), "matched_rule")
    return symbols.at_line(hits, spans, order=("class_ord",))


_EDGE = "WITH e AS (SELECT DISTINCT 'C' || (l_suppkey % 7) AS caller_class, 'm' || (l_suppkey % 60) AS caller_method, 'm' || (l_partkey % 97) AS callee_method, 'f' || (l_suppkey % 7) AS file FROM lineitem)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return table(spark, d, "lineitem").select(name("C", "l_suppkey", 7).alias("caller_class"), name("m", "l_suppkey", 60).alias("caller_method"), name("m", "l_partkey", 97).alias("callee_method"), name("f", "l_suppkey", 7).alias("file"))


@query(_EDGE + """, one AS (SELECT DISTINCT callee_method AS method, caller_class, caller_method, file FROM e),
two AS (SELECT DISTINCT one.method, e.caller_class, e.caller_method, e.file FROM one JOIN e ON e.callee_method = one.caller_method)
SELECT method, 0 AS depth, caller_class, caller_method, file FROM one UNION ALL
SELECT method, 1 AS depth, caller_class, caller_method, file FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.method = two.method AND one.caller_class = two.caller_class AND one.caller_method = two.caller_method)""")
def callers_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Callers of every method, up to two calls away."""
    e = _edges(spark, d)
    return symbols.callers(e, e.select(F.col("callee_method").alias("method")))


@query(_EDGE + " SELECT caller_class, caller_method, count(*) AS n_calls, array_to_string(list_sort(list(callee_method)), ',') AS calls FROM e GROUP BY caller_class, caller_method")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sorted calls of every method."""
    return _edges(spark, d).groupBy("caller_class", "caller_method").agg(F.array_sort(F.collect_set("callee_method")).alias("c")).select("caller_class", "caller_method", F.size("c").cast("bigint").alias("n_calls"), F.array_join("c", ",").alias("calls"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(coalesce(text, '')) AS n FROM conversations),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS chars, 0 AS kept, false AS exceeded FROM (SELECT DISTINCT conv_id FROM s)
 UNION ALL SELECT w.conv_id, s.k, CAST(CASE WHEN n <= 1500 - chars THEN chars + n WHEN 1500 - chars < 200 THEN chars ELSE 1500 - 50 + 30 END AS INTEGER),
  CASE WHEN n > 1500 - chars AND 1500 - chars < 200 THEN kept ELSE kept + 1 END, exceeded OR (n > 1500 - chars AND 1500 - chars < 200) FROM walk w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1)
SELECT conv_id, CAST(k AS INTEGER) AS n_sections, kept AS n_kept, chars AS total_chars, exceeded AS budget_exceeded FROM walk w WHERE k = (SELECT max(k) FROM s WHERE s.conv_id = w.conv_id)""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The greedy budget fold over turns."""
    c = table(spark, d, "conversations")
    return context.running_sections(c, "conv_id", "turn", F.col("role"), F.coalesce("text", F.lit("")), 1500)


@query("""WITH own AS (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey), any_ AS (SELECT s_suppkey % 10 AS g, min(s_suppkey) AS s FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(own.s, any_.s) AS s_suppkey, own.s IS NOT NULL AS same FROM customer LEFT JOIN own ON s_nationkey = c_nationkey LEFT JOIN any_ ON g = c_custkey % 10 WHERE coalesce(own.s, any_.s) IS NOT NULL""")
def prefer_same_group(spark: SparkSession, d: str) -> DataFrame:
    """A match of the own group first, else any; groups are cut to their first row before they are joined."""
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier")
    own = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    other = s.groupBy((F.col("s_suppkey") % 10).alias("g")).agg(F.min("s_suppkey").alias("s_suppkey"))
    j = c.join(own, c["c_nationkey"] == own["s_nationkey"]).select("c_custkey", "s_suppkey", F.lit(True).alias("same")).unionByName(c.join(other, c["c_custkey"] % 10 == other["g"]).select("c_custkey", "s_suppkey", F.lit(False).alias("same")))
    return symbols.first_preferring(j, "c_custkey", F.col("same"), "s_suppkey").select("c_custkey", "s_suppkey", "same")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value > 20 THEN 'confidence' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'kind' END, CASE WHEN user_id % 4 = 0 THEN 'line' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""")
def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """one array of failed checks per row."""
    e = table(spark, d, "events")
    bad = f.problems({"confidence": (F.col("value") / 20).between(float("-inf"), 1), "kind": F.col("event_type").isin("click", "view"), "line": F.when(F.col("user_id") % 4 != 0, F.lit(True))})
    return e.select("event_id", F.array_join(bad, "; ").alias("problems"))


@query("SELECT doc_id, nth FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS INTEGER) AS nth FROM documents) WHERE nth > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id an earlier row has."""
    return records.repeated_ids(_docs(spark, d).select("doc_id", F.md5("text").alias("ident")), "ident", "doc_id").select("doc_id", "nth")


def _sarif(spark: SparkSession, d: str) -> DataFrame:
    """A SARIF report per order: a result per line item."""
    l = table(spark, d, "lineitem")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("./src//"), F.col("l_returnflag"), F.lit("/A.java")).alias("uri")).alias("artifactLocation"), F.struct(F.col("l_partkey").alias("startLine")).alias("region")).alias("physicalLocation"))
    res = F.struct(F.concat(F.lit("R"), (F.col("l_linenumber") % 3).cast("string")).alias("ruleId"), F.when(F.col("l_quantity") > 25, "error").when(F.col("l_quantity") > 10, "warning").otherwise("note").alias("level"), F.struct(F.col("l_linestatus").alias("text")).alias("message"), F.array(place).alias("locations"))
    r = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(res)).alias("results"))
    rule = lambda k, name, tags: F.struct(F.lit(k).alias("id"), F.lit(name).alias("name"), F.struct(F.array(*[F.lit(x) for x in tags]).cast("array<string>").alias("tags")).alias("properties"))
    driver = F.struct(F.struct(F.lit("scan").alias("name"), F.array(rule("R0", "Zero", ["x", "external/cwe/cwe-079"]), rule("R1", "One", [])).alias("rules")).alias("driver"))
    return r.select(F.to_json(F.struct(F.array(F.struct(driver.alias("tool"), "results")).alias("runs"))).alias("report"))


@query("""SELECT CASE l_linenumber % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' ELSE 'R2' END AS vulnerability_type, CASE l_linenumber % 3 WHEN 0 THEN 'CWE-079' WHEN 1 THEN 'CWE-1' ELSE 'CWE-2' END AS cwe,
 CASE WHEN l_quantity > 25 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS severity, 'src/' || l_returnflag || '/A.java' AS file, nullif(CAST(l_partkey AS INTEGER), 0) AS start_line, CAST(0.85 AS DOUBLE) AS confidence, 'scan' AS tool, count(*) AS n FROM lineitem GROUP BY ALL""")
def sarif_import(spark: SparkSession, d: str) -> DataFrame:
    """SARIF reports to normalised findings."""
    x = findings.normalised(src.sarif_results(_sarif(spark, d)), "exp-converted")
    return x.groupBy("vulnerability_type", "cwe", "severity", "file", "start_line", "confidence", "tool").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'json-tool' ELSE 'T' END AS tool, 'CWE-' || (o_custkey % 900) AS cwe, CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'informational' ELSE 'medium' END AS severity,
 CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS confidence, CASE WHEN o_custkey > 0 THEN CAST(least(o_custkey, 500) AS INTEGER) END AS start_line, CASE WHEN o_custkey > 0 THEN CAST(greatest(o_custkey, 500) AS INTEGER) ELSE 500 END AS end_line, 1 AS steps FROM orders""")
def json_import(spark: SparkSession, d: str) -> DataFrame:
    """Three shapes of JSON, inverted ranges and scalars put right."""
    o = table(spark, d, "orders")
    item = F.format_string('{"finding_id": "%d", %s "cwe": "cwe%d", "severity": "%s", "confidence": "%s", "start_line": %d, "end_line": 500, "data_flow": "step"}', "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise('"tool": "T",'), F.col("o_custkey") % 900, f.choose(F.col("o_orderkey") % 3, {0: "CRIT", 1: "info"}, "odd"), F.when(F.col("o_orderkey") % 5 == 0, "7.5").otherwise("junk"), F.col("o_custkey"))
    shape = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("["), item, F.lit("]"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"findings": ['), item, F.lit("]}"))).otherwise(item)
    x = findings.normalised(src.json_results(o.select(shape.alias("report"))), "exp-converted")
    return x.select(F.col("finding_id").cast("bigint").alias("o_orderkey"), "tool", "cwe", "severity", "confidence", "start_line", "end_line", F.size("data_flow").alias("steps"))


@query("SELECT 'event_type' AS of, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM events")
def recon_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: counts by each column and in all, in one pass."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("date").cast("string").alias("day"))
    return recon.totals(e, "event_type", "day")


@query("SELECT page_id, coalesce(CASE WHEN list_position(parts, 'en') > 0 THEN parts[list_position(parts, 'en') + 1] END, 'core') AS module FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages)")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    """The path part after a marker."""
    return table(spark, d, "pages").select("page_id", t.module_of(F.col("url"), "en").alias("module"))


_ANY_LINE = "list_filter(CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END, lambda x: contains(x, 'token') OR contains(x, 'AKIA'))"


@query(rf"""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM documents), h AS (SELECT doc_id, text, {_ANY_LINE} AS hit FROM c)
SELECT doc_id, {_STRIP.format("coalesce(hit[1], substr(text, 1, 100))")} AS snippet FROM h""")
def telling_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first line with a keyword, else the beginning."""
    return _docs(spark, d).select("doc_id", t.telling_line(F.coalesce("text", F.lit("")), ["token", "AKIA"], comments=("\x00",)).alias("snippet"))


@query(r"""WITH c AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM documents), k AS (SELECT doc_id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END AS ls FROM c)
SELECT doc_id, md5(array_to_string(ls[2:least(4, len(ls))], chr(10)) || CASE WHEN least(6, len(ls)) - 1 > 3 THEN chr(10) || '// ... [truncated]' ELSE '' END) AS part, md5(array_to_string(ls[1:least(4, len(ls))], chr(10)) || CASE WHEN len(ls) > 4 THEN chr(10) || '// ... [file truncated]' ELSE '' END) AS head FROM k""")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Bounded ranges of lines with a mark."""
    lines = t.lines_of(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", F.md5(t.line_range(lines, 2, 6, 3)).alias("part"), F.md5(t.head(lines, 4)).alias("head"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'rejected' WHEN 2 THEN 'validated' ELSE 'uncertain' END AS status, CASE event_id % 4 WHEN 0 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.8 END AS confidence FROM events")
def validator_answers(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON, or words, of a validator's answers."""
    e = table(spark, d, "events")
    said = f.choose(F.col("event_id") % 4, {0: '```json\n{"status": "VALIDATED", "confidence": 0.75}\n```', 1: "clearly rejected, not validated", 2: "this is Validated"}, "no idea")
    r = findings.validator_result(F.coalesce(t.fenced_json(said), said))
    return e.select("event_id", r["status"].alias("status"), r["confidence"].alias("confidence"))


@query("""WITH r AS (SELECT event_id, event_id % 5 AS k, row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id) > 1 AS again FROM events)
SELECT event_id AS line_no, CASE WHEN k = 0 THEN NULL ELSE 'candidate' END AS kind, CASE WHEN k = 0 THEN 'invalid JSON syntax' ELSE array_to_string(list_filter([CASE WHEN k = 1 THEN 'missing required candidate field ''snippet''' END, CASE WHEN again2 THEN 'duplicate id' END, CASE WHEN k = 2 THEN 'file path must be relative, not absolute' END, CASE WHEN k = 3 THEN 'line must be positive integer or null' END], lambda x: x IS NOT NULL), '; ') END AS problems
FROM (SELECT r.*, CASE WHEN k = 0 THEN false ELSE row_number() OVER (PARTITION BY k = 0, u ORDER BY event_id) > 1 END AS again2 FROM (SELECT r.*, e.user_id % 500 AS u FROM r JOIN events e USING (event_id)) r)""")
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each line of a JSON-lines file."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    text = F.format_string('{"candidate_id": "C%d", "category": "x", "file": "%s", "line": %s, "matched_rule": "r"%s}', F.col("user_id") % 500, F.when(k == 2, "/a").otherwise("a"), F.when(k == 3, "0").otherwise("3"), F.when(k == 1, "").otherwise(', "snippet": "s"'))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(k == 0, "{oops").otherwise(text).alias("line"))
    return records.record_problems(lines).select("line_no", "kind", F.array_join("problems", "; ").alias("problems"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows, as the streaming job has them, over the table at rest."""
    from ..streaming.usage import windowed

    return windowed(table(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e)
SELECT user_id, min(ts) AS begin, max(ts) AS last, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, nth""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """2.12 session windows: runs of a user's events, as the streaming job has them, over the table at rest."""
    from ..streaming.usage import sessions

    return sessions(table(spark, d, "events"), gap="6 hours")


@query("""SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(4) r(k) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """2.12 sliding windows: an hour every quarter of an hour."""
    from ..streaming.usage import sliding

    return sliding(table(spark, d, "events"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Extension: events appended by a stream (exactly once, from a checkpoint), then counted."""
    from ..sources.scratch import new_path
    from ..streaming.usage import event_stream, run_once

    at = new_path(spark, "stream")
    schema = table(spark, d, "events").schema
    run_once(event_stream(spark, f"{d}/events.parquet*", schema), f"{at}/out", f"{at}/state")
    return spark.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(_USE + " SELECT phase, hit AS is_cached, count(*) AS n FROM u GROUP BY phase, hit")
def streamed_cache(spark: SparkSession, d: str) -> DataFrame:
    """2.12, S20, K13, W6: cache hits of a stream in two parts with a restart between them; the same as at rest."""
    from ..sources.scratch import new_path
    from ..streaming.cache import hits
    from ..streaming.usage import event_stream, run_once

    at = new_path(spark, "requests")
    e = table(spark, d, "events").select("event_id", "event_type", "props", F.timestamp_seconds(F.col("event_id") + 946684800).alias("at"))
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        e.where(part).write.mode("append").parquet(f"{at}/in")
        run_once(hits(event_stream(spark, f"{at}/in", e.schema), "props", "event_id", "at", ttl="36500 days"), f"{at}/out", f"{at}/state")
    found = spark.read.schema("props string, event_id long, at timestamp, is_cached boolean").parquet(f"{at}/out")
    return found.join(e.select("event_id", F.col("event_type").alias("phase")), "event_id").groupBy("phase", "is_cached").agg(F.count("*").alias("n"))


@query(_DEDUP + """, u AS (SELECT count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events)
SELECT count(*) AS raw_findings, count(*) FILTER (place > 1) AS duplicates, count(*) FILTER (place = 1) AS unique_findings, count(*) FILTER (place = 1 AND status = 'validated') AS validated_findings,
 round(count(*) FILTER (place > 1) / CAST(count(*) AS DOUBLE), 4) AS duplicate_rate, any_value(u.calls) AS llm_calls, round(count(*) FILTER (place = 1) / CAST(0.5 AS DOUBLE), 2) AS findings_per_minute FROM best, u""")
def experiment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The record of an experiment."""
    x = findings.deduplicated(_findings(spark, d))
    outcomes = findings.evaluation(x.select("finding_id", F.lit("uncertain").alias("outcome")))
    m = findings.metrics(x, _usage(spark, d), outcomes, "exp", 30.0)
    return m.select("raw_findings", "duplicates", "unique_findings", "validated_findings", "duplicate_rate", "llm_calls", "findings_per_minute")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Lines, rule scan, early rejection, ids, dedup keys, canonical findings, counts per rule."""
    hits = rules.rejected(_hits(spark, d)).where("NOT is_rejected")
    raw = hits.select(F.col("category").alias("vulnerability_type"), F.col("matched_rule").alias("sink"), F.col("priority").alias("severity"), "file", F.col("line_no").cast("string").alias("start_line"), F.col("snippet").alias("evidence"), F.lit("0.9").alias("confidence"))
    found = findings.deduplicated(findings.normalised(stored(raw, "flagship"), "flagship"))  # read three times
    return found.groupBy("vulnerability_type", "sink").agg(F.count("*").alias("raw"), F.count_if("is_canonical").alias("canonical")).orderBy("vulnerability_type", "sink")


QUERIES["flagship"] = flagship
SQL["flagship"] = (
    f"WITH {_HITS}, fnd AS (SELECT *, substr({_STRIP.format('line')}, 1, 200) AS snippet, regexp_extract(line, '\\(([^)]+)\\)', 1) AS arg FROM hits), "
    + r"""ok AS (SELECT * FROM fnd WHERE NOT regexp_matches(line, '(?i)\b(htmlEscape|clean|encode|sanitize|safePath|normalize|validate|ESAPI)\b') AND NOT (arg <> '' AND regexp_matches(arg, '^\s*["''][^"'']*["'']\s*$')))
SELECT category AS vulnerability_type, matched_rule AS sink, count(*) AS raw, count(DISTINCT (file, line_no // 10, """
    + _STRIP.format("snippet")
    + ")) AS canonical FROM ok GROUP BY category, matched_rule"
)
