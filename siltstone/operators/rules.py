"""Declarative rule catalogs, unrolled into one projection per line.

A catalog is a list of rules with literal patterns; a scan is one pass over the lines, with
all patterns compiled once into the plan (a join with a table of patterns would compile
one for every row). Matches come out in the catalog's order.
"""

from __future__ import annotations

import functools
import operator
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import starts_with_any
from ..functions.text import path_parts, trimmed
from ..sources.files import lines
from ..sources.scratch import apart, stored
from .order import running


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    pattern: str
    priority: str = "medium"
    suffixes: tuple[str, ...] = (".java",)


SCRIPT, PAGE = (".js", ".mjs"), (".html", ".htm")
# The source rules, in catalog order.
SOURCE_RULES = [
    Rule("sqli_string_concat", "database", r"(?i)(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b[^\n\r]*?\+[\s\n]*?\w+", "high"),
    Rule("sqli_statement_execute", "database", r"\b(Statement|createNativeQuery)\s*\.\s*(executeQuery|executeUpdate|execute)\b", "high"),
    Rule("xss_raw_write", "html_template", r"\b(response|writer|out)\s*\.\s*(print|println|write|append)\s*\([^\)]*?\w+", "medium"),
    Rule("xss_thymeleaf_unescaped", "html_template", r"th:utext\s*=", "high"),
    Rule("xss_dom_sink", "html_template", r"\b(innerHTML|outerHTML|document\.write|eval)\s*(=|\()", "high", SCRIPT + PAGE),
    Rule("xss_unescaped_template", "html_template", r"(?:v-html\s*=|\{\{\{[^}]+\}\}\}|<%=)", "high", PAGE + SCRIPT),
    Rule("cmd_runtime_exec", "command_execution", r"\b(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\b", "high"),
    Rule("file_path_traversal", "file_handling", r"\bnew\s+(File|FileInputStream|FileOutputStream|FileReader|FileWriter|Path)\s*\([^\)]*?\+", "high"),
    Rule("file_zip_slip", "file_handling", r"\b(ZipEntry|TarArchiveEntry)\s*\.\s*getName\b", "medium"),
    Rule("xml_xxe_parser", "xml_parsing", r"\b(DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\s*\.\s*newInstance\b", "medium"),
    Rule("deserialization_unsafe", "deserialization", r"\b(ObjectInputStream\s*\.\s*readObject|XMLDecoder|XStream\s*\.\s*fromXML)\b", "critical"),
    Rule("ssrf_http_connection", "http_client", r"\b(URL\s*\.\s*openStream|HttpURLConnection|RestTemplate|WebClient)\b", "medium"),
    Rule("redirect_open", "redirect", r"\b(sendRedirect|RedirectView|redirect:)\b", "medium"),
    Rule("auth_custom_check", "authentication", r"\b(UserDetailsService|PasswordEncoder|AuthenticationManager)\b", "low"),
    Rule("access_control_annotation", "authorization", r"@(PreAuthorize|Secured|RolesAllowed)\b", "low"),
    Rule("session_cookie_handling", "session", r"\b(HttpSession|Cookie|csrf)\b", "low"),
    Rule("crypto_weak_algorithm", "cryptography", r'(?i)MessageDigest\.getInstance\s*\(\s*"MD5"|"SHA-1"\s*\)|Cipher\.getInstance\s*\(\s*"DES"|"RC4"\s*\)', "high"),
    Rule("crypto_hardcoded_secret", "cryptography", r'(?i)(password|secret|apiKey|privateKey)\s*=\s*"[^"]{4,}"', "high"),
    Rule("logging_sensitive", "logging_sensitive", r"(?i)\blog\s*\.\s*(info|debug|error|warn)\s*\([^\)]*?(password|token|secret|credit)", "medium"),
    Rule("reflection_unsafe", "reflection", r"\b(Class\.forName|Method\.invoke|Field\.set|Constructor\.newInstance)\b", "medium"),
    Rule("xml_external_entity", "xml_parsing", r"(?i)<!DOCTYPE[^>]*(?:SYSTEM|PUBLIC)|external-general-entities", "high", (".xml", ".xhtml", ".html")),
    Rule("config_hardcoded_secret", "cryptography", r"(?i)(?:password|secret|api[_-]?key|private[_-]?key)\s*[:=]\s*[^${}\s][^\s#]+", "high", (".properties", ".yml", ".yaml", ".xml")),
]
# What rejects a match early, and why.
PARAMETERISED = r"\?|\:[\w]+|\bPreparedStatement\b|\bJdbcTemplate\b"
SANITISER = r"(?i)\b(htmlEscape|clean|encode|sanitize|safePath|normalize|validate|ESAPI)\b"
CONSTANT_ONLY = r"^\s*[\"'][^\"']*[\"']\s*$"
REASONS = {
    "parameterised": "Query appears parameterized or uses PreparedStatement/JdbcTemplate",
    "sanitised": "Sanitizer or encoding function detected on line",
    "constant": "Argument appears to be a constant string literal",
    "authorised": "Authorization annotation explicitly present on method",
}
# Security patterns by category, in catalog order.
SECURITY_PATTERNS = {
    "database": [
        ("JDBC/Statement", r"(?:createStatement|prepareStatement|executeQuery|executeUpdate)\s*\("),
        ("SQL string concat", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\+\s*\w"),
        ("JPA native query", r"(?:nativeQuery|createNativeQuery|createQuery)\s*\("),
        ("JdbcTemplate", r"JdbcTemplate|NamedParameterJdbcTemplate"),
        ("DriverManager", r"DriverManager\.getConnection"),
    ],
    "deserialization": [("ObjectInputStream", r"ObjectInputStream|readObject\s*\("), ("XMLDecoder", r"XMLDecoder"), ("XStream", r"XStream"), ("Serializable", r"implements\s+.*Serializable")],
    "command_execution": [("Runtime.exec", r"Runtime\.getRuntime\(\)\.exec\s*\("), ("ProcessBuilder", r"new\s+ProcessBuilder\s*\(")],
    "file_handling": [
        ("File I/O", r"new\s+File\s*\(|Files\.\w+\s*\(|FileInputStream|FileOutputStream"),
        ("MultipartFile", r"MultipartFile|@RequestParam.*file"),
        ("Path traversal risk", r"\.resolve\s*\(|\.normalize\s*\(|Paths\.get\s*\("),
        ("ZipEntry", r"ZipEntry|ZipInputStream|ZipFile"),
    ],
    "xml_parsing": [("SAXParser", r"SAXParser|SAXParserFactory"), ("DocumentBuilder", r"DocumentBuilder|DocumentBuilderFactory"), ("XMLReader", r"XMLReader|XMLInputFactory"), ("TransformerFactory", r"TransformerFactory")],
    "authentication": [
        ("UserDetailsService", r"UserDetailsService|UserDetails"),
        ("PasswordEncoder", r"PasswordEncoder|BCryptPasswordEncoder"),
        ("AuthenticationManager", r"AuthenticationManager|AuthenticationProvider"),
        ("Login form", r"formLogin|loginPage|loginProcessingUrl"),
    ],
    "authorization": [("@PreAuthorize", r"@PreAuthorize"), ("@Secured", r"@Secured"), ("hasRole/hasAuthority", r"hasRole|hasAuthority|hasAnyRole"), ("antMatchers/requestMatchers", r"antMatchers|requestMatchers|authorizeRequests|authorizeHttpRequests")],
    "session": [("HttpSession", r"HttpSession|getSession\s*\("), ("Cookie", r"new\s+Cookie|addCookie|getCookies"), ("CSRF config", r"csrf\(\)|CsrfToken|csrfTokenRepository")],
    "cryptography": [
        ("MessageDigest", r"MessageDigest\.getInstance"),
        ("Cipher", r"Cipher\.getInstance"),
        ("SecureRandom", r"SecureRandom"),
        ("KeyGenerator", r"KeyGenerator|KeyPairGenerator"),
        ("Hardcoded key/secret", r'(?i)(?:password|secret|key)\s*=\s*"[^"]{3,}"'),
    ],
    "redirect": [("sendRedirect", r"sendRedirect\s*\("), ("redirect:", r'"redirect:'), ("forward:", r'"forward:'), ("RedirectView", r"RedirectView")],
    "template_rendering": [("Thymeleaf", r"th:|TemplateEngine|SpringTemplateEngine"), ("ModelAndView", r"ModelAndView|addAttribute")],
    "http_client": [("URLConnection", r"URLConnection|HttpURLConnection|openConnection"), ("RestTemplate", r"RestTemplate|WebClient|HttpClient"), ("URL constructor", r"new\s+URL\s*\(")],
    "jwt": [("JWT parsing", r"Jwts?\.|JwtParser|JwtDecoder|JwtBuilder"), ("JWT token", r"(?i)Bearer|Authorization.*token")],
    "logging_sensitive": [("Log injection risk", r"(?i)(?:log|logger|LOG)\.\w+\s*\(.*(?:request|param|input|user)")],
    "reflection": [("Class.forName", r"Class\.forName\s*\("), ("Method.invoke", r"\.invoke\s*\("), ("newInstance", r"\.newInstance\s*\(")],
}

#: Rules for plain text collections, in patterns that mean the same to RE2.
TEXT_RULES = [
    Rule("assigned_token", "secret", r'token = "[0-9a-f]{40}"', "critical", ("",)),
    Rule("access_key", "secret", r"AKIA[0-9A-Z]{16}", "critical", ("",)),
    Rule("card_number", "personal", r"[0-9]{16}", "high", ("",)),
    Rule("email_address", "personal", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z][A-Za-z]+", "medium", ("",)),
    Rule("phone_number", "personal", r"[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "medium", ("",)),
    Rule("ip_address", "network", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "low", ("",)),
    Rule("licence_line", "licence", r"(?i)licen[sc]ed? under|apache license|all rights reserved", "low", ("",)),
    Rule("marked_up_noise", "junk", r"[#*%&$][#*%&$][#*%&$]", "low", ("",)),
]


def spoken(line: Column) -> Column:
    """False for blank lines and lines of comments."""
    s = trimmed(line)
    return (s != "") & ~starts_with_any(s, ("//", "*"))


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest word is longest; empty if there is none."""
    return max((s for s in sets if s), key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def _words(parts: list) -> frozenset[str]:
    """Words of which a match of a parsed pattern holds at least one; empty if nothing is known."""
    runs, found = [""], []
    for op, value in parts:
        if op is sre.LITERAL:
            runs[-1] += chr(value)
            continue
        runs.append("")
        if op is sre.SUBPATTERN and not value[1] and not value[2]:
            found.append(_words(value[3]))
        elif op is sre.BRANCH:
            each = [_words(x) for x in value[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            found.append(_words(value[2]))
    return _best([*found, *[frozenset([r]) for r in runs if r]])


#: Texts whose lines are held as an Arrow array at a time.
SCANNED = 256


@functools.cache
def needed(pattern: str) -> tuple[frozenset[str], bool]:
    """Words of which a text that matches holds at least one (none: not known), and whether case doesn't matter (words are lower then)."""
    if re.search(r"\\0|\(\?(?!i\))-?[a-zA-Z]", pattern):  # means something else to Java, or may
        return frozenset(), False
    try:
        parsed = sre_parse.parse(pattern)
    except Exception:  # syntax that only Java knows
        return frozenset(), False
    any_case = bool(parsed.state.flags & sre.SRE_FLAG_IGNORECASE)
    words = _words(list(parsed))
    if not all(w.isascii() for w in words):
        return frozenset(), False
    return frozenset(w.lower() for w in words) if any_case else words, any_case


def _may_match(line: Column, patterns: list[str], low: Column | None = None) -> Column:
    """False only where no pattern matches: a search for the words they need, and the patterns that need none. low: the line in lower case, if it is a column."""
    plain, lower, rest = set(), set(), []
    for p in patterns:
        words, any_case = needed(p)
        (lower if any_case else plain).update(words)
        if not words:
            rest.append(p)
    short = lambda words: [w for w in sorted(words) if not any(x != w and x in w for x in words)]
    low = F.lower(line) if low is None else low
    return functools.reduce(operator.or_, [*[line.contains(w) for w in short(plain)], *[low.contains(w) for w in short(lower)], *[line.rlike(p) for p in rest]])


def scan(lines: DataFrame, rules: list[Rule], file: str = "file", snippet: int = 200, bare: bool = False, likely: bool = False) -> DataFrame:
    """A row per line and rule that matches: the columns of lines, rule_ord, matched_rule, category, priority, snippet.

    lines: `file`, line_no, line; patterns see the raw line, or, if bare, the stripped one, which
    is given back as well. The suffix gate compares in lower case.
    Lines without any word that some pattern needs go before a pattern is tried (likely: they are gone).
    """
    name, hits = F.lower(F.col(file)), []
    low = "line_low"
    while low in lines.columns:
        low += "_"
    for k, r in enumerate(rules):
        hit = F.col("line").rlike(r.pattern)
        if r.suffixes != ("",):
            hit = _ends(name, r.suffixes) & hit
        if needed(r.pattern)[0]:
            hit = _may_match(F.col("line"), [r.pattern], F.col(low)) & hit
        hits.append(F.when(hit, F.struct(F.lit(k).alias("rule_ord"), F.lit(r.id).alias("matched_rule"), F.lit(r.category).alias("category"), F.lit(r.priority).alias("priority"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    tried = lines if likely else lines.where(_may_match(F.col("line"), [r.pattern for r in rules]))
    tried = tried.where(spoken(F.col("line")))
    tried = tried.withColumn("line", trimmed(F.col("line"))) if bare else tried
    return tried.withColumn(low, F.lower("line")).select(*lines.columns, F.explode(found).alias("hit")).select(*lines.columns, "hit.*", F.substring(trimmed(F.col("line")), 1, snippet).alias("snippet"))


def likely_lines(files: DataFrame, rules: list[Rule], file: str = "file", content: str = "content") -> DataFrame:
    """`file`, line_no, line of the lines that hold a word some pattern needs: all that a scan needs to see.

    All words are looked for at once (one automaton over the lines of an Arrow batch). If a
    pattern needs no word that is known, all lines come.
    """
    plain, lower = set(), set()
    for words, any_case in (needed(r.pattern) for r in rules):
        if not words:
            return lines(files, file, content)
        (lower if any_case else plain).update(words)
    either = lambda words: "|".join(re.escape(w) for w in sorted(words))
    wanted = "|".join(x for x in (either(plain), f"(?i:{either(lower)})" if lower else "") if x)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCANNED):
                names, texts = batch.slice(at, SCANNED).columns
                if pc.any(pc.match_substring(texts, "\r")).as_py():
                    texts = pc.replace_substring(pc.replace_substring(texts, "\r\n", "\n"), "\r", "\n")
                pieces = pc.split_pattern(texts, "\n")
                flat, owner = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
                hit = np.flatnonzero(pc.match_substring_regex(flat, wanted).to_numpy(zero_copy_only=False))
                of = owner.to_numpy()[hit]
                number = hit - np.searchsorted(owner.to_numpy(), of) + 1  # owners are in order
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(number, pa.int32()), flat.take(pa.array(hit))], [file, "line_no", "line"])

    return files.select(file, content).mapInArrow(run, f"`{file}` string, line_no int, line string")


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    return functools.reduce(operator.or_, [name.endswith(s) for s in suffixes])


def rejected(hits: DataFrame, annotations: Column | None = None) -> DataFrame:
    """hits with is_rejected, rejection_reason and the priority that goes with it; the first reason counts.

    annotations: names of the annotations on the enclosing method, if they are known.
    """
    line = F.col("line")
    argument = F.regexp_extract(line, r"\(([^)]+)\)", 1)
    reason = (
        F.when((F.col("category") == "database") & (F.col("matched_rule") == "sqli_string_concat") & line.rlike(PARAMETERISED), F.lit(REASONS["parameterised"]))
        .when(line.rlike(SANITISER), F.lit(REASONS["sanitised"]))
        .when((argument != "") & argument.rlike(CONSTANT_ONLY), F.lit(REASONS["constant"]))
    )
    if annotations is not None:
        guarded = F.arrays_overlap(F.coalesce(annotations, F.array().cast("array<string>")), F.array(F.lit("PreAuthorize"), F.lit("Secured")))
        reason = reason.when(F.col("category").isin("authorization", "authentication") & guarded, F.lit(REASONS["authorised"]))
    return hits.withColumn("rejection_reason", reason).withColumn("is_rejected", F.col("rejection_reason").isNotNull()).withColumn("priority", F.when(F.col("is_rejected"), F.lit("low")).otherwise(F.col("priority")))


def numbered(hits: DataFrame, prefix: str = "CAND-WG-", file: str = "file") -> DataFrame:
    """hits with candidate_id, a running number in the order of path parts, line and rule.

    Numbers inside a file come from a window over the file; where a file begins comes from
    the counts of the files before it, range-sorted, so no task sees all hits or all files. Hits
    are stored first, since both need them.
    """
    found = apart(stored(hits, "hits"))
    begin = running(found.groupBy(file).agg(F.count("*").alias("n")), [path_parts(F.col(file)), F.col(file)], {"before": "n"}).drop("n")
    inside = F.row_number().over(Window.partitionBy(file).orderBy("line_no", "rule_ord"))
    return found.join(begin, file).withColumn("candidate_id", F.format_string(f"{prefix}%04d", F.col("before") + inside)).drop("before")


def _flat(patterns: dict[str, list[tuple[str, str]]] | None) -> list[Rule]:
    return [Rule(name, category, regex, suffixes=("",)) for category, group in (patterns or SECURITY_PATTERNS).items() for name, regex in group]


def pattern_hits(lines: DataFrame, patterns: dict[str, list[tuple[str, str]]] | None = None, file: str = "file", likely: bool = False) -> DataFrame:
    """A row per line and security pattern; patterns see the stripped line."""
    return scan(lines, _flat(patterns), file, bare=True, likely=likely).select(file, F.col("line_no").alias("line"), "category", F.col("matched_rule").alias("pattern"), "snippet", "rule_ord")


def pattern_hits_of(files: DataFrame, patterns: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """pattern_hits of the lines of files (file, content); lines without any word that a pattern needs are left behind first."""
    return pattern_hits(likely_lines(files, _flat(patterns)), patterns, likely=True)
