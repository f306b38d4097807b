"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an earlier response with the same
payload) and a metadata record. Request and metadata name the response in
WARC-Concurrent-To. Archives are gzip files of records that end in two CRLF; Spark's text
source writes and streams them, cut at those ends, so a reader holds one record at a time
and archives may have any size and lie in any store that Spark reads. Content-Length tells
which ends are inside a payload.

Defined cases: a null html is an empty payload; payloads under 100 bytes never revisit; of
equal longer payloads that with the least page_id is the response; equal rows (page_id, url
and html) are equal captures, assembled once and returned as often as they were written; a
null page_id or url is stored as absent and read back as null; an empty table gives an empty
result; other columns play no part. An archive that ends within a record, or holds something
between records, stops the reader with an error that names the file; a response whose payload
isn't what its digest says is read with intact = false.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, table

LEAST = 100
CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + END
RECORD = "file string, record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>"


def _uuid(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, *headers: Column) -> Column:
    """One record without the end that the text source writes after it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), *headers]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)  # concat_ws leaves out null headers


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", " "))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write page_id, url and html of pages as WARC records under path."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    heads = p.select(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")).alias("first"), "digest", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= LEAST)
    # Only payloads that occur again; stored, so that the join's sides are plain shuffles and a hot payload is split.
    again = stored(heads.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payloads")
    p = p.join(again, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    # A row is named by its page, url and payload; a null url and an empty one are two names.
    told = lambda page, url: (F.coalesce(F.col(page).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col(url)), F.lit("")), F.col("digest"))
    row = told("page_id", "url")
    this, first = _uuid("capture", *row), _uuid("capture", *told("first_id", "first_url"))
    uri, digest = _header("WARC-Target-URI", F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    together = F.concat(F.lit("WARC-Concurrent-To: "), this)
    get = F.concat(F.lit("GET "), F.regexp_replace(F.coalesce("url", F.lit("/")), r"[\r\n]", " "), F.lit(" HTTP/1.1" + END))
    about = F.concat_ws(CRLF, _header("pageId", F.col("page_id").cast("string")), F.lit("software: siltstone"))
    answer = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    records = F.array(
        _record("request", _uuid("request", *row), "application/http; msgtype=request", get, uri, together),
        _record(F.when(revisit, "revisit").otherwise("response"), this, "application/http; msgtype=response", answer, uri, digest, F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first)), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _record("metadata", _uuid("metadata", *row), "application/warc-fields", about, uri, together),
    )
    p.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _named(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split(CRLF) if ":" in x)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class RecordReader:
    """Turns the pieces between ends, in file order, into records; holds one record at a time."""

    def __init__(self, payloads: bool):
        self.file, self.headers, self.block, self.length, self.payloads = None, None, [], 0, payloads

    def close(self) -> None:
        """Nothing comes after this: a record that isn't whole is an error."""
        if self.headers is not None:
            raise ValueError(f"{self.file}: record {self.headers.get('warc-record-id')} ends after {max(0, self.length)} of {self.headers.get('content-length')} bytes")

    def feed(self, file: str, piece: bytes) -> tuple | None:
        if file != self.file:
            self.close()
            self.file = file
        if self.headers is None:
            start = piece.find(b"WARC/")
            if piece[: start if start >= 0 else None].strip():
                raise ValueError(f"{file}: no record where one should begin: {piece[:60]!r}")
            if start >= 0:
                self.headers, self.block, self.length = _named(piece[start:]), [], -len(END)
            return None
        self.block.append(piece)
        self.length += len(END) + len(piece)
        need = int(self.headers.get("content-length", 0))
        if self.length < need:
            return None
        h, block = self.headers, END.encode().join(self.block)
        block, rest = block[:need], block[need:]
        self.headers = None
        # A block that ends in CRLF makes a cut before its end, and the next header stands in the same piece.
        start = rest.find(b"WARC/")
        if rest[: start if start >= 0 else None].strip():
            raise ValueError(f"{file}: no record where one should begin: {rest[:60]!r}")
        if start >= 0:
            self.headers, self.block, self.length = _named(rest[start:]), [], -len(END)
        kind, fields, payload = h.get("warc-type"), {}, b""
        if "http" in h.get("content-type", ""):
            _, _, payload = block.partition(END.encode())
        elif kind == "metadata":
            fields = _named(block)
        digest = (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        sha = hashlib.sha256(payload).hexdigest() if kind == "response" else digest
        row = (file, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, len(payload), sha, digest is None or sha == digest, fields)
        return (*row, payload) if self.payloads else row


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the gzip archives under path; payloads: also the payload bytes."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in re.split(r", (?!string>)", schema)]

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = RecordReader(payloads)
        for batch in batches:
            rows = [r for f, v in zip(batch["file"], batch["value"], strict=True) if (r := reader.feed(f, v))]
            if rows:
                yield pd.DataFrame(rows, columns=names)
        reader.close()

    raw = spark.read.option("lineSep", END).text(path)
    return raw.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")).mapInPandas(parse, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit), metadata, times.

    Records meet through WARC-Concurrent-To. Identical records are one, `times` how often.
    """
    own = F.struct(*[F.col(c) for c in records.columns if c != "fields"])
    r = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), "type", own.alias("record"), F.map_entries("fields").alias("fields"))
    answer = F.col("type").isin("response", "revisit")
    return r.groupBy("capture_id").agg(
        F.max(F.when(F.col("type") == "request", F.col("record"))).alias("request"),
        F.max(F.when(answer, F.col("record"))).alias("response"),
        F.max(F.when(F.col("type") == "metadata", F.struct("record", "fields"))).alias("metadata"),
        F.sum(answer.cast("int")).cast("int").alias("times"),
    ).withColumn("metadata", F.struct("metadata.record", F.map_from_entries("metadata.fields").alias("fields")))


def captures(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back: a row per page as the archives tell it."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    t = stored(transactions(read_records(spark, path)), "transactions").where(F.col("response").isNotNull())
    page = F.col("metadata.fields").getItem("pageid").cast("long").alias("page_id")
    c = t.select("capture_id", page, F.col("response.uri").alias("url"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), "times")
    whole = c.where("record_type = 'response'")
    first = whole.select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("sha"))
    again = c.where("record_type = 'revisit'").join(first, "refers").select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to", "times")
    out = whole.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "times").union(again)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("copy", "times")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
