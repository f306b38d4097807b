"""Column functions over text, JSON and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() would keep tabs and line ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trimmed(c: Column) -> Column:
    """As strip, without a pattern: for what is done per line of a file."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to(c: Column, default: Column | str) -> Column:
    """c, or the default where c is null or empty."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, c).otherwise(default if isinstance(default, Column) else F.lit(default))


def lines_of(c: Column) -> Column:
    """Lines of a text; the empty piece after a last line end is none.

    The text is split once: what ends it is cut off before, not looked for in the pieces.
    """
    less = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    plain = F.split(F.when(c.endswith("\n"), less(1)).otherwise(c), "\n", -1)
    mixed = F.split(F.when(c.endswith("\r\n"), less(2)).when(c.endswith("\n") | c.endswith("\r"), less(1)).otherwise(c), r"\r\n|\n|\r", -1)
    return F.when(c == "", F.array().cast("array<string>")).when(c.contains("\r"), mixed).otherwise(plain)


def line_range(lines: Column, start: Column | int, stop: Column | int, most: int = 200, mark: str = "// ... [truncated]") -> Column:
    """Text of lines start to stop (from 1, both in), held to the file and to `most` lines with a mark."""
    start, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    first = F.greatest(F.lit(1), start)
    n = F.greatest(F.lit(0), F.least(stop, F.size(lines)) - first + 1)
    text = F.array_join(F.slice(lines, first, F.least(n, F.lit(most))), "\n")
    return F.when(n > most, F.concat(text, F.lit("\n" + mark))).otherwise(text)


def head(lines: Column, most: int = 200) -> Column:
    """The first lines of a file, marked if there are more."""
    return line_range(lines, F.lit(1), F.size(lines), most, "// ... [file truncated]")


def tokens_estimated(c: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def budget_tokens(chars: Column, multiplier: float = 4.0) -> Column:
    return F.floor(chars / F.lit(multiplier)).cast("int")


def cache_key(source_hash: Column, prompt_version: Column, model: Column, analysis_type: Column, context_hash: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (source_hash, prompt_version, model, analysis_type, context_hash)]
    return F.sha2(F.concat_ws(":", *parts), 256)


def fenced_json(c: Column) -> Column:
    """The JSON text of a model response: what the first code fence holds, or the whole; null if it doesn't parse."""
    text = strip(c)
    inside = lambda fence: F.split(F.element_at(F.split(text, fence), 2), "```").getItem(0)
    body = F.when(text.contains("```json"), inside("```json")).when(text.contains("```"), inside("```")).otherwise(text)
    body = strip(body)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))


def clean_path(c: Column, root: str = "") -> Column:
    """Path relative to root: '/' separators, no '.', no empty parts, '..' resolved; empty stays empty.

    A '..' that would leave the start stays in front, as in a normalised relative path. Paths
    without any '..' (and without a root to compare) go without the fold over their parts.
    """
    absolute = c.startswith("/")
    start = F.struct(F.array().cast("array<string>").alias("p"))

    def step(s: Column, x: Column) -> Column:
        p = s["p"]
        up = (x == "..") & (F.size(p) > 0) & (F.element_at(F.concat(F.array(F.lit("")), p), -1) != "..")
        return F.struct(F.when(up, F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(F.concat(p, F.array(x))).alias("p"))

    parts = F.aggregate(path_parts(F.regexp_replace(c, r"\\", "/")), start, step, lambda s: s["p"])
    if root:
        base = [x for x in root.split("/") if x not in ("", ".")]
        above = F.array(*[F.lit(x) for x in base])
        under = absolute & (F.slice(parts, 1, len(base)) == above)
        outside = F.concat(F.array_repeat(F.lit(".."), len(base)), parts)
        parts = F.when(under, F.slice(parts, F.lit(len(base) + 1), F.size(parts))).when(absolute, outside).otherwise(parts)
        absolute = F.lit(False)
    joined = F.array_join(parts, "/")
    if not root:
        plain = F.rtrim(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"(?:^|(?<=/))(?:\.?(?:/|\z))+", ""), F.lit("/"))
        joined = F.when(c.contains(".."), joined).otherwise(plain)
    full = F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(blank_to(joined, "."))
    return F.when(c == "", c).otherwise(full)


def endpoint_path(base: Column, path: Column) -> Column:
    """base and path with one slash between and none at the end; '/' for nothing."""
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))
    return blank_to(F.rtrim(joined, F.lit("/")), "/")


def module_of(path: Column, marker: str = "lessons", default: str = "core") -> Column:
    """The path part after the first marker."""
    parts = path_parts(path)
    return F.coalesce(F.when(F.array_position(parts, marker) > 0, F.try_element_at(parts, (F.array_position(parts, marker) + 1).cast("int"))), F.lit(default))


def telling_line(text: Column, words: list[str], comments: tuple[str, ...] = ("*", "//", "/*", "import ")) -> Column:
    """The first line with one of the words that isn't a comment, else the text's first 100 characters."""
    from functools import reduce

    def wanted(x: Column) -> Column:
        s = strip(x)
        plain = reduce(lambda a, b: a & b, [~s.startswith(p) for p in comments])
        return plain & reduce(lambda a, b: a | b, [x.contains(w) for w in words])

    return F.coalesce(strip(F.try_element_at(F.filter(lines_of(text), wanted), F.lit(1))), strip(F.substring(text, 1, 100)))
