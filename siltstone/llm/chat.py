"""Chat formatting: conversations through a compiled template, and back.

Rows are sorted by conversation and turn within their partition and stream through the
template; what is held is one turn, not one conversation. A conversation is written by one
task all the same, since a template may count its turns and its digest is one stream: one of a
third of all rows takes that task as long as its text is, but no more memory. Output comes as
parts of a conversation of about PART characters, each with the spans under the loss mask.
Reading back takes each part once, whatever the length of a turn.

The template marks turns; the filter `guard` escapes, with a backslash, backslashes and
whatever could be read as a mark inside texts and roles, and `unguarded` undoes it.

Defined cases: a null text is an empty one; a null role an empty role; turns with equal
numbers are ordered by role and text; repeated rows are repeated turns; rows with a null
conv_id are one conversation of that id; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .templates import compiled

TEMPLATE = (
    "{% for m in messages %}{{ '### ' ~ m.role|header ~ ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|guard }}{% endgeneration %}{% else %}{{ m.text|guard }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}{% endfor %}"
)
PART = 1 << 20
PARTS = "conv_id long, part int, text string, loss array<struct<start:int,stop:int>>"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_GUARD = re.compile(r"\\|(?<=<)/|#(?=##)|(?<=##)#")
_PLAIN = re.compile(r"\\(.)", re.S)


def guarded(text: str) -> str:
    """text with marks made harmless: no '</' nor '###' is left in it."""
    return _GUARD.sub(lambda m: "\\" + m[0], text or "")


def unguarded(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def header(role: str) -> str:
    """Name of a role: the three common ones by name, others guarded behind '='."""
    return NAMES.get(role) or "=" + guarded(role).replace(":", "\\:")


def role_of(name: str) -> str:
    return next((r for r, n in NAMES.items() if n == name), None) or unguarded(name[1:])


def _sorted(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterable[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for b in batches:
        ids = [None if pd.isna(x) else int(x) for x in b["conv_id"]]
        yield from zip(ids, *[b[c] for c in columns], strict=True)


def formatted(conversations: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """Rows of parts: conv_id, part, text and loss (spans of text, in code points)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compiled(template, {"guard": guarded, "header": header})

        def parts() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches, "role", "text"), key=lambda r: r[0]):
                texts, spans, size, k = [], [], 0, 0
                for text, loss in render(messages=({"role": r, "text": t} for _, r, t in rows)):
                    if loss and text:
                        if spans and spans[-1]["stop"] == size:
                            spans[-1]["stop"] += len(text)
                        else:
                            spans.append({"start": size, "stop": size + len(text)})
                    texts.append(text)
                    size += len(text)
                    if size >= part:
                        yield conv, k, "".join(texts), spans
                        texts, spans, size, k = [], [], 0, k + 1
                if texts or not k:
                    yield conv, k, "".join(texts), spans

        yield from _frames(parts(), ["conv_id", "part", "text", "loss"])

    return _sorted(conversations).mapInPandas(run, PARTS)


def _frames(rows: Iterator[tuple], columns: list[str], at_once: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """Frames of up to 1,000 rows or about `at_once` characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if size > at_once or len(held) >= 1000:
            yield pd.DataFrame(held, columns=columns).astype({"conv_id": "Int64"})
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype({"conv_id": "Int64"})


class TurnReader:
    """Digest of the turns in formatted text that comes in parts; holds what may be part of a mark."""

    END = "</turn>\n"

    def __init__(self):
        self.turns, self.n, self.rest, self.seen, self.inside = hashlib.sha256(), 0, "", 0, False

    def _say(self, text: str) -> None:
        self.turns.update(text.encode("utf-8", "surrogatepass"))

    def feed(self, text: str) -> None:
        rest, at = self.rest + text, 0
        while True:
            if not self.inside:
                # The name ends at the first ': ' whose colon isn't escaped.
                stop = rest.find(": ", max(at, self.seen))
                while stop >= 0 and _odd(rest, stop):
                    stop = rest.find(": ", stop + 1)
                if stop < 0:
                    self.seen = max(at, len(rest) - 1) - at
                    break
                if rest[at : at + 4] != "### ":
                    raise ValueError(f"output that isn't a turn: {rest[at : at + 80]!r}")
                self._say(role_of(rest[at + 4 : stop]) + "\n")
                self.inside, at, self.seen = True, stop + 2, 0
            stop = rest.find(self.END, at)
            if stop < 0:
                whole = max(at, len(rest) - len(self.END) + 1)
                whole -= whole > at and _odd(rest, whole)
                self._say(unguarded(rest[at:whole]))
                at = whole
                break
            self._say(unguarded(rest[at:stop]) + "\n")
            self.n, self.inside, at = self.n + 1, False, stop + len(self.END)
        self.rest = rest[at:]


def _odd(text: str, stop: int) -> bool:
    """True if an odd number of backslashes stands before stop: the last one escapes what is there."""
    k = stop
    while k and text[k - 1] == "\\":
        k -= 1
    return (stop - k) % 2 == 1


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the formatted parts (in order, as `formatted` gives them) say."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(batches, "part", "text", "loss"), key=lambda r: r[0]):
                reader, chars = TurnReader(), 0
                masked, loss, held = hashlib.sha256(), 0, ""
                for _, _, text, spans in rows:
                    chars += len(text)
                    for s in spans:
                        held += text[s["start"] : s["stop"]]
                        # A backslash at a part's end belongs with what follows it.
                        odd = _odd(held, len(held))
                        plain, held = unguarded(held[: len(held) - odd]), held[len(held) - odd :]
                        loss += len(plain)
                        masked.update(plain.encode("utf-8", "surrogatepass"))
                    reader.feed(text)
                if reader.rest or reader.inside or held:
                    raise ValueError(f"conversation {conv}: output that isn't a turn: {(reader.rest or held)[:80]!r}")
                yield conv, reader.n, reader.turns.hexdigest(), loss, masked.hexdigest(), chars

        yield from _frames(found(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


TRIAL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = spark.createDataFrame(TRIAL, "conv_id long, turn long, role string, text string")
    return read_back(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(trial)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, len(text) - len(replace(text, '\', '')) + (len(text) - len(replace(text, '</', ''))) // 2
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: CASE WHEN len(x) = 3 THEN 2 ELSE len(x) END)), 0) AS extra FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(len('### ' || role || ': ') + len(text) + extra + len('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
