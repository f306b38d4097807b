"""Reconnaissance of a source tree: components, endpoints, patterns, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import endpoint_path, lines_of
from ..sources.scratch import stored

# Fixed values.
COMPONENT = r"@(RestController|Controller|Service|Repository|Configuration|Component)\b"
CLASS_NAME = r"(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"
PACKAGE = r"(?m)^\s*package\s+([\w.]+)\s*;"
PATH_VALUE = r'(?:value\s*=\s*|path\s*=\s*)?["{]?\s*"([^"]*)"'
METHOD_VALUE = r"method\s*=\s*(?:RequestMethod\.)?(\w+)"
METHOD_NAME = r"(?:public|protected|private)?\s*\w[\w<>\[\], ]*\s+(\w+)\s*\("
MAPPINGS = {"RequestMapping": None, "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}


def _numbered(files: DataFrame, word: str, pattern: str | None = None) -> DataFrame:
    """files with lines, pos and line of each line that holds a word (and matches a pattern): only those lines meet their file's text."""
    holds = lambda x: x.contains(word) & x.rlike(pattern) if pattern else x.contains(word)
    d = files.where(F.col("content").contains(word)).withColumn("lines", lines_of(F.col("content")))
    hits = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("pos"), x.alias("line"))), lambda x: holds(x["line"]))
    return d.select(*files.columns, "lines", F.explode(hits).alias("hit")).select(*files.columns, "lines", "hit.pos", "hit.line")


def _first(lines: Column, pattern: str) -> Column:
    """Group 1 of the first line that matches, '' if none does."""
    hit = F.filter(lines, lambda x: x.rlike(pattern))
    return F.coalesce(F.regexp_extract(F.try_element_at(hit, F.lit(1)), pattern, 1), F.lit(""))


def components(files: DataFrame) -> DataFrame:
    """file, line, kind, class_name (within five lines), annotation, package."""
    kind = F.lower(F.regexp_extract("line", COMPONENT, 1))
    near = F.slice(F.col("lines"), F.col("pos") + 1, F.lit(5))
    d = _numbered(files, "@", COMPONENT)
    return d.select("file", (F.col("pos") + 1).alias("line"), F.when(kind == "restcontroller", "controller").otherwise(kind).alias("kind"), _first(near, CLASS_NAME).alias("class_name"), F.regexp_extract("line", COMPONENT, 0).alias("annotation"), F.regexp_extract("content", PACKAGE, 1).alias("package"))


def endpoints(files: DataFrame) -> DataFrame:
    """file, line, annotation, method, path, java_method of every mapping annotation.

    A class-level mapping near the top gives the base path (and is an endpoint itself); an
    annotation that isn't closed on its line takes up to four more.
    """
    top = F.try_element_at(F.filter(F.slice("lines", 1, 50), lambda x: x.contains("@RequestMapping")), F.lit(1))
    base = F.coalesce(F.regexp_extract(top, PATH_VALUE, 1), F.lit(""))
    d = _numbered(files, "Mapping").withColumn("base", base)
    names = F.filter(F.array(*[F.when(F.col("line").contains("@" + n), F.lit(n)) for n in MAPPINGS]), lambda x: x.isNotNull())
    d = d.withColumn("annotation", F.explode(names))
    more = F.slice("lines", F.col("pos") + 2, F.lit(4))
    closed = F.array_position(F.transform(more, lambda x: x.contains(")").cast("int")), 1).cast("int")
    rest = F.slice(more, F.lit(1), F.when(closed > 0, closed).otherwise(F.size(more)))
    open_ = F.col("line").contains("(") & ~F.col("line").contains(")")
    text = F.when(open_, F.concat_ws(" ", F.array("line"), rest)).otherwise(F.col("line"))
    d = d.withColumn("text", text)
    default = F.create_map(*[x for k, v in MAPPINGS.items() if v for x in (F.lit(k), F.lit(v))])
    verb = F.upper(F.regexp_extract("text", METHOD_VALUE, 1))
    method = F.coalesce(F.try_element_at(default, F.col("annotation")), F.when(verb != "", verb).otherwise("ANY"))
    after = F.slice("lines", F.col("pos") + 2, F.lit(5))
    return d.select("file", (F.col("pos") + 1).alias("line"), "annotation", method.alias("method"), endpoint_path(F.col("base"), F.regexp_extract("text", PATH_VALUE, 1)).alias("path"), _first(after, METHOD_NAME).alias("java_method"))


def counts(rows: DataFrame, of: str) -> DataFrame:
    return rows.groupBy(F.col(of).alias("value")).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by each column alone and in all: of (the column, or total), value, n."""
    sets = rows.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(F.count("*").alias("n"), F.grouping_id(*by).alias("g"))
    full = (1 << len(by)) - 1
    of = F.lit("total")
    value = F.lit(None).cast("string")
    for k, c in enumerate(by):
        hit = F.col("g") == (full & ~(1 << (len(by) - 1 - k)))
        of, value = F.when(hit, F.lit(c)).otherwise(of), F.when(hit, F.col(c).cast("string")).otherwise(value)
    return sets.select(of.alias("of"), value.alias("value"), "n")


def first_few(rows: DataFrame, by: list[str], value: str, most: int, name: str = "first") -> DataFrame:
    """Per group of `by`: how many distinct values there are (n_values), and the first `most` of them in order.

    Distinct values are numbered within their group and the group's hash slices first, so no
    task holds more than `most` values of a slice.
    """
    slices = 64
    d = rows.select(*by, F.col(value).alias("v")).distinct().withColumn("cut", F.pmod(F.xxhash64("v"), F.lit(slices)))
    near = Window.partitionBy(*by, "cut").orderBy("v")
    n = d.groupBy(*by).agg(F.count("*").cast("int").alias("n_values"))
    top = d.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= most).groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("v")), 1, most).alias(name))
    return n.join(top, by)


def top_files(hits: DataFrame, most: int = 5) -> DataFrame:
    """Per pattern: hits, distinct files, the first few of them and how many more there are."""
    of_file = stored(hits.groupBy("category", "pattern", "file").agg(F.count("*").alias("n")), "pattern-files")  # read three times, found once
    n = of_file.groupBy("category", "pattern").agg(F.sum("n").alias("hits"))
    d = n.join(first_few(of_file, ["category", "pattern"], "file", most, "first_files"), ["category", "pattern"])
    return d.select("category", "pattern", "hits", F.col("n_values").alias("n_files"), "first_files", F.greatest(F.lit(0), F.col("n_values") - most).alias("more"))


def document(modules: DataFrame, comps: DataFrame, ends: DataFrame, hits: DataFrame) -> DataFrame:
    """What reconnaissance found as one table of JSON records: section (lesson, component, endpoint, pattern, total) and record."""
    comps, ends, hits = (stored(d, "found") for d in (comps, ends, hits))  # read twice, found once
    part = lambda d, name: d.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    sums = comps.select(F.lit("components").alias("of")).unionByName(ends.select(F.lit("endpoints").alias("of"))).unionByName(hits.select(F.lit("patterns").alias("of"))).groupBy("of").agg(F.count("*").alias("n"))
    return part(modules, "lesson").unionByName(part(comps, "component")).unionByName(part(ends, "endpoint")).unionByName(part(hits, "pattern")).unionByName(part(sums, "total"))
