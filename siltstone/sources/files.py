"""Reading source trees, line tables and JSON records."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.findings import sarif_cwe, sarif_severity
from ..functions.text import blank_to, lines_of, path_parts
from ..schemas import CLASS, EDGE, FINDING, GROUND_TRUTH, RAW_FINDING, SARIF, USAGE


@dataclass(frozen=True)
class ExclusionRule:
    pattern: str
    match: str  # directory_segment, suffix or path_prefix
    value: str
    category: str
    reason: str


def read_policy(spark: SparkSession, path: str) -> list[ExclusionRule]:
    """Rules of an exclusion file, in order."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return [ExclusionRule(**r) for r in json.loads(text)["rules"]]


def matching_rule(path: Column, rules: list[ExclusionRule]) -> Column:
    """struct(pattern, category, reason) of the first rule that matches a path, else null."""
    p = F.ltrim(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), F.lit("/"))
    found = F.lit(None).cast("struct<pattern:string,category:string,reason:string>")
    for r in reversed(rules):
        base = r.value.rstrip("/")
        hit = {"directory_segment": F.array_contains(F.split(p, "/"), r.value), "suffix": p.endswith(r.value), "path_prefix": (p == base) | p.startswith(base + "/")}[r.match]
        found = F.when(hit, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.category).alias("category"), F.lit(r.reason).alias("reason"))).otherwise(found)
    return found


def policy_table(spark: SparkSession, rules: list[ExclusionRule]) -> DataFrame:
    return spark.createDataFrame([(k, r.pattern, r.category, r.reason) for k, r in enumerate(rules)], "rule_ord int, pattern string, category string, reason string")


def _glob(suffixes: tuple[str, ...], any_case: bool) -> str:
    each = ["".join(f"[{c.lower()}{c.upper()}]" if any_case and c.isalpha() else c for c in s) for s in suffixes]
    return "*{" + ",".join(each) + "}" if len(each) > 1 else "*" + each[0]


def read_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), rules: list[ExclusionRule] | None = None, any_case: bool = False) -> DataFrame:
    """file (path below root), content (UTF-8, bad bytes replaced), excluded files left out.

    Suffixes are checked while files are listed. Folders that a rule excludes whole are found
    from paths alone and never opened; the driver gets the folders that are left. What a rule
    says about a file's own name is checked last.
    """
    reader = spark.read.format("binaryFile")
    if suffixes:
        reader = reader.option("pathGlobFilter", _glob(suffixes, any_case))
    base = unquote(re.sub("^file:/+", "/", root)).rstrip("/") + "/"

    def below(d: DataFrame) -> Column:
        full = F.regexp_replace(d["path"], "^file:/+", "/")
        at = F.position(F.lit(base), full)
        return F.when(at > 0, F.substring(full, at + len(base), F.length(full))).otherwise(full)

    raw = reader.option("recursiveFileLookup", "true").load(root)
    whole = [r for r in rules or [] if r.match != "suffix"]
    if whole:
        name = F.element_at(F.split("path", "/"), -1)
        folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(name))
        in_folder = F.substring(below(raw), F.lit(1), F.length(below(raw)) - F.length(name))
        folders = raw.select(folder.alias("folder"), (matching_rule(in_folder, whole).isNull()).alias("kept")).distinct().collect()  # a row per folder, without contents
        if not all(r["kept"] for r in folders):
            kept = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", r["folder"]) for r in folders if r["kept"]]
            if not kept:
                return spark.createDataFrame([], "file string, content string")
            raw = reader.option("recursiveFileLookup", "false").load(kept)
    f = raw.withColumn("file", below(raw))
    if rules:
        f = f.where(matching_rule(F.col("file"), rules).isNull())
    return f.select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def lines(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """`file`, line_no (from 1), line."""
    return files.select(file, F.posexplode(lines_of(F.col(content))).alias("pos", "line")).select(file, (F.col("pos") + 1).alias("line_no"), "line")


def extension(file: Column) -> Column:
    """Suffix of the last path part with its dot, in lower case; a name that only begins with a dot has none."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def inventory(files: DataFrame) -> DataFrame:
    """Per extension: files and the lines of them that end in a line feed."""
    n = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    return files.withColumn("extension", extension(F.col("file"))).groupBy("extension").agg(F.count("*").alias("files"), F.sum(n).alias("lines"))


def tree_roots(files: DataFrame, marker: str) -> DataFrame:
    """Distinct folders that a marker such as src/main/ begins in, marker included."""
    at = F.instr(F.col("file"), marker)
    prefix = F.rtrim(F.substring(F.col("file"), F.lit(1), at - 1), F.lit("/"))
    mark = marker.rstrip("/")
    return files.where(at > 0).select(F.when(prefix != "", F.concat(prefix, F.lit("/" + mark))).otherwise(F.lit(mark)).alias("root")).distinct()


# What a POM's names tell about frameworks.
FRAMEWORKS = {"spring-boot": "Spring Boot", "spring-security": "Spring Security", "thymeleaf": "Thymeleaf", "hibernate": "Hibernate", "junit": "JUnit"}


def _pom_files(files: DataFrame) -> DataFrame:
    return files.where(F.element_at(F.split("file", "/"), -1) == "pom.xml")


def pom_artifacts(files: DataFrame) -> DataFrame:
    """Of each pom.xml, read as text: the first artifact outside <parent>."""
    own = F.regexp_replace(F.col("content"), r"(?s)<parent>.*?</parent>", "")
    first = F.trim(F.regexp_extract(own, r"<artifactId>\s*([^<]+?)\s*</artifactId>", 1))
    return _pom_files(files).select("file", F.when(first != "", first).alias("artifact"))


def poms(files: DataFrame) -> DataFrame:
    """Of each pom.xml, read as XML: its own artifact (a child of the root), modules at any depth, frameworks that artifacts, groups and names tell of.

    Comments are no elements, prefixes of names don't matter, and a file that isn't XML has nothing.
    """
    d = _pom_files(files).withColumn("x", F.from_xml("content", "broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    sound = F.col("x").isNotNull() & F.col("x.broken").isNull()
    named = lambda *names: " or ".join(f"local-name()='{n}' or name()='{n}' or substring-after(name(), ':')='{n}'" for n in names)

    def texts(path: str) -> Column:
        found = F.when(sound, F.xpath("content", F.lit(path))).otherwise(F.array().cast("array<string>"))
        return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")

    told = F.lower(F.array_join(texts(f"//*[{named('artifactId', 'groupId', 'name')}]/text()"), "\n"))
    frameworks = F.array_sort(F.filter(F.array(*[F.when(told.contains(k), F.lit(v)) for k, v in FRAMEWORKS.items()]), lambda x: x.isNotNull()))
    return d.select("file", F.get(texts(f"/*/*[{named('artifactId')}]/text()"), F.lit(0)).alias("artifact"), F.array_distinct(texts(f"//*[{named('module')}]/text()")).alias("modules"), frameworks.alias("frameworks"))


def lesson_modules(files: DataFrame, marker: str = "lessons") -> DataFrame:
    """Folders below the marker, and how many files each has."""
    parts = path_parts(F.col("file"))
    at = F.array_position(parts, marker).cast("int")
    return files.where((at > 0) & (F.size(parts) > at + 1)).groupBy(F.element_at(parts, at + 1).alias("name")).agg(F.count_distinct("file").alias("files"))


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, malformed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed cases, a JSON object per line; malformed lines go. No review status is 'heuristic'."""
    d = _records(spark, path, GROUND_TRUTH).where("malformed IS NULL").drop("malformed")
    return d.withColumn("review_status", F.coalesce("review_status", F.lit("heuristic")))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, USAGE).where("malformed IS NULL").drop("malformed")


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, malformed lines)."""
    d = _records(spark, path, FINDING).cache()
    return d.where("malformed IS NULL").drop("malformed"), d.where("malformed IS NOT NULL").select("malformed")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics.json of every experiment folder."""
    return spark.read.option("multiLine", "true").json(f"{path}/*/metrics.json")


# What an imported finding says where its report says nothing.
SARIF_KIND, SARIF_TEXT, SARIF_ATTACK, SARIF_ADVICE = "Vulnerability", "SARIF vulnerability detection", "Potentially exploitable security flaw", "Review and remediate according to security guidelines"


def sarif_results(reports: DataFrame, column: str = "report", tool: str = "sarif-tool") -> DataFrame:
    """A raw finding row for each result of SARIF reports (a JSON text per row).

    A result looks its rule up inside its own run (of equal ids the last counts), before it
    becomes a row, so nothing is shuffled.
    """
    runs = reports.select(F.explode(F.from_json(F.col(column), SARIF)["runs"]).alias("run"))
    ruled = F.transform("run.results", lambda r: F.struct(r.alias("r"), F.try_element_at(F.filter("run.tool.driver.rules", lambda x: x["id"] == r["ruleId"]), F.lit(-1)).alias("rule")))
    r = runs.select(F.coalesce("run.tool.driver.name", F.lit(tool)).alias("tool"), F.explode(ruled).alias("x")).select("tool", "x.r", "x.rule")
    message = blank_to(F.col("r.message.text"), F.col("rule.shortDescription.text"))
    place = F.try_element_at(F.col("r.locations"), F.lit(1))["physicalLocation"]
    return r.select(
        F.col("r.id").alias("finding_id"), "tool", blank_to(F.coalesce("rule.name", "r.ruleId"), SARIF_KIND).alias("vulnerability_type"),
        sarif_cwe(F.col("rule.properties.tags"), F.col("r.ruleId")).alias("cwe"), sarif_severity(F.col("r.level")).alias("severity"), F.lit("0.85").alias("confidence"),
        place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("start_line"), F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("end_line"),
        blank_to(message, SARIF_TEXT).alias("description"), message.alias("evidence"),
        F.lit(SARIF_ATTACK).alias("attack_scenario"), F.lit(SARIF_ADVICE).alias("recommendation"),
        F.lit("sarif-import-v1.0").alias("prompt_version"),
    )


def json_results(reports: DataFrame, column: str = "report") -> DataFrame:
    """A raw finding row for each finding of JSON texts: an array, an object with findings, or one object.

    A text is parsed once, to a variant; its shape says which part of it holds the findings.
    """
    fields = [(x.split(" ")[0], "boolean" if x.endswith(" boolean") else "string") for x in RAW_FINDING.split(", ")]
    v = reports.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    inside = F.try_variant_get("v", "$.findings", "array<variant>")
    v = v.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), inside, F.array("v"))).alias("x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    d = v.select(*[F.try_variant_get("x", f"$.{c}", kind).alias(c) for c, kind in fields if c != "data_flow"], F.try_variant_get("x", "$.data_flow", "array<string>").alias("steps"), F.try_variant_get("x", "$.data_flow", "string").alias("step"))
    flow = F.coalesce("steps", F.when(F.col("step") != "", F.array("step")))
    d = d.withColumn("data_flow", flow).drop("steps", "step").withColumn("tool", F.coalesce("tool", F.lit("json-tool"))).withColumn("prompt_version", F.coalesce("prompt_version", F.lit("json-import-v1.0")))
    return d.select(*[c for c, _ in fields])


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(types with their methods, call edges) that `index` wrote below path."""
    return spark.read.schema(CLASS).json(f"{path}/classes"), spark.read.schema(EDGE).json(f"{path}/edges")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, skill, text) of PROMPT.md files and of SKILL.md files in folders of their name."""
    f = read_files(spark, path, (".md",))
    parts = F.split("file", "/")
    skill = F.element_at(parts, -1) == "SKILL.md"
    name = F.when(skill, F.try_element_at(parts, F.lit(-2))).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.md$", ""))
    return f.select(name.alias("name"), skill.alias("skill"), F.col("content").alias("text"))
