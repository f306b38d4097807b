"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, decoded to resampled PCM.

mu-law and A-law expand by lookup tables of 256 samples. ADPCM blocks are decoded together:
a step of the loop takes the k-th code of every block at once. Decoded audio is 16-bit PCM,
resampled by a rational factor with linear interpolation in integers.

`stored_payloads` keeps any bytes losslessly as telephony audio: 8-bit mu-law or A-law
samples, or the data bytes of ADPCM blocks of 192 (each after its own 4-byte header). Which
of the three is told by a CRC of the payload, so equal payloads have equal media.

The PCM is stored too, in parts of some SLICE coded bytes, so that a medium of any length is
decoded, written and measured a part at a time; features come from the stored PCM, read back.

Defined cases: a null text is an empty one; an empty payload is 192 pad bytes; media that
are null or no telephony WAV have one part, with null PCM, and null features; repeated rows
stay separate rows and have equal media; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, made, new_path, spread, stored, table

UNIT, PAD, TAIL = 192, b"\x20", 16
RATE, UP, DOWN = 8000, 2, 1
ALAW, MULAW, ADPCM = 6, 7, 0x11  # format tags of WAV
BLOCK_HEADER = 4
SLICE = 1 << 17  # coded bytes of a part
BATCH_ROWS, WAVES = 64, 4  # rows of audio that go to Python at a time; shares that PCM is measured in
#: Audio compresses better in large pages.
PAGES = {"parquet.page.size": str(1 << 23), "parquet.block.size": str(1 << 25), "parquet.compression.codec.zstd.level": "9"}
#: Index changes of IMA ADPCM, fixed values of the format.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Step sizes of IMA ADPCM, fixed values of the format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


@cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law: sample of each code."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """G.711 A-law: sample of each code."""
    code = np.arange(256) ^ 0x55
    part, power = (code & 15) << 4, code >> 4 & 7
    size = np.where(power == 0, part + 8, (part + 264) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (one per row, header first): 1 + 2 for each data byte."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    data = np.ascontiguousarray(blocks[:, BLOCK_HEADER:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value = head
    for k in range(2 * len(data)):
        code = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        out[k + 1] = value
    return out.T


def wav(tag: int, data: bytes, samples: int, block: int, bits: int) -> bytes:
    extra = struct.pack("<H", 2 * (block - BLOCK_HEADER) + 1) if tag == ADPCM else b""
    form = struct.pack("<HHIIHHH", tag, 1, RATE, RATE * block // (2 * (block - BLOCK_HEADER) + 1) if tag == ADPCM else RATE, block, bits, len(extra)) + extra
    data_pad = data + b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data_pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes | None) -> tuple[int, int, bytes] | None:
    """(format tag, block size, data) of a telephony WAV, None for anything else."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, tag, block = 12, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data" and tag in (ALAW, MULAW, ADPCM) and (tag != ADPCM or block > BLOCK_HEADER):
            return tag, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def encode(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of UNIT."""
    tag = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    if tag != ADPCM:
        return wav(tag, payload, len(payload), 1, 8)
    data = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    blocks = np.zeros((len(data), BLOCK_HEADER + UNIT), np.uint8)
    blocks[:, BLOCK_HEADER:] = data
    return wav(tag, blocks.tobytes(), len(data) * (2 * UNIT + 1), BLOCK_HEADER + UNIT, 4)


def payload_of(parsed: tuple[int, int, bytes]) -> bytes:
    """The bytes that `encode` stored."""
    tag, block, data = parsed
    return data if tag != ADPCM else np.frombuffer(data, np.uint8)[: len(data) // block * block].reshape(-1, block)[:, BLOCK_HEADER:].tobytes()


def decode(parsed: list[tuple[int, int, bytes] | None]) -> list[np.ndarray | None]:
    """16-bit samples of each; ADPCM blocks of all media are decoded together."""
    out: list[np.ndarray | None] = [None] * len(parsed)
    together: dict[int, list[int]] = {}
    for k, p in enumerate(parsed):
        if p and p[0] == ADPCM:
            together.setdefault(p[1], []).append(k)
        elif p:
            out[k] = (mulaw_table() if p[0] == MULAW else alaw_table())[np.frombuffer(p[2], np.uint8)]
    for block, ks in together.items():
        each = [np.frombuffer(parsed[k][2], np.uint8)[: len(parsed[k][2]) // block * block].reshape(-1, block) for k in ks]
        samples, at = decode_adpcm(np.concatenate(each)), 0
        for k, x in zip(ks, each, strict=True):
            out[k] = samples[at : at + len(x)].ravel()
            at += len(x)
    return out


def resample(pcm: np.ndarray, up: int = UP, down: int = DOWN, after: int | None = None) -> np.ndarray:
    """up/down times as many samples, linear between neighbours; behind the last one comes `after`, or it is held."""
    n = len(pcm) * up // down
    at = np.arange(n, dtype=np.int64) * down
    left, rest = at // up, at % up
    x = np.append(pcm, pcm[-1:] if after is None else np.array([after], pcm.dtype)).astype(np.int32)
    return ((x[left] * (up - rest) + x[left + 1] * rest) // up).astype("<i2")


def slices(parsed: tuple[int, int, bytes], size: int = SLICE, down: int = DOWN) -> Iterator[tuple[tuple[int, int, bytes], int | None]]:
    """(part, the sample that follows it) of one medium; parts hold whole blocks and a multiple of `down` samples."""
    tag, block, data = parsed
    unit = block * down if tag == ADPCM else down
    step = max(1, size // unit) * unit
    end = max(1, len(data) // block * block if tag == ADPCM else len(data))
    for at in range(0, end, step):
        after = None
        if at + step < end:
            after = struct.unpack_from("<h", data, at + step)[0] if tag == ADPCM else int((mulaw_table() if tag == MULAW else alaw_table())[data[at + step]])
        yield (tag, block, data[at : min(at + step, end)]), after


def _chunks(values: Iterable[tuple], size_of, limit: int = 1 << 20) -> Iterator[list]:
    """Lists of values of about `limit` bytes, so that a batch of long media is worked on in parts."""
    part, size = [], 0
    for v in values:
        part.append(v)
        size += size_of(v)
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def payload_digests(parsed: tuple[int, int, bytes]) -> tuple[int, str, int]:
    """Length, SHA-256 and CRC-32 of the tail of the payload that a medium stores, a slice at a time."""
    sha, n, tail = hashlib.sha256(), 0, b""
    for part, _ in slices(parsed):
        x = payload_of(part)
        sha.update(x)
        n, tail = n + len(x), (tail + x[-TAIL:])[-TAIL:]
    return n, sha.hexdigest(), zlib.crc32(tail)


MEDIA = "doc_id long, n_bytes long, media binary"
PCM = "id long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tag int, part int, pcm binary"


def decoded(media: DataFrame) -> DataFrame:
    """Rows of PCM from media (id, doc_id, n_bytes, media): what the coded bytes say, and resampled 16-bit PCM by parts."""
    names = [x.split()[0] for x in PCM.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts(batch: pd.DataFrame) -> Iterator[tuple]:
            for row, doc_id, n, m in zip(batch["id"], batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                p = parse_wav(m)
                about = (row, doc_id, n, *(payload_digests(p) if p else (None, None, None)), len(m) if m is not None else None, hashlib.sha256(m).hexdigest() if m is not None else None, p[0] if p else None)
                for k, (x, after) in enumerate(slices(p) if p else [(None, None)]):
                    yield about, k, x, after

        for batch in batches:
            for chunk in _chunks(parts(batch), lambda v: len(v[2][2]) if v[2] else 1):
                found = decode([x for _, _, x, _ in chunk])
                rows = [(*about, k, None if pcm is None else resample(pcm, after=after).tobytes()) for (about, k, _, after), pcm in zip(chunk, found, strict=True)]
                whole = {c: "Int64" for c, kind in (x.split() for x in PCM.split(", ")) if kind in ("long", "int")}
                yield pd.DataFrame(rows, columns=names).astype(whole)

    return media.select("id", "doc_id", "n_bytes", "media").mapInPandas(run, PCM)


def stored_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the stored form of each whole text."""

    def make(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in _chunks(zip(batch["doc_id"], batch["text"], strict=True), lambda v: len(v[1]) if isinstance(v[1], str) else 1):
                out = []
                for doc_id, text in chunk:
                    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                    out.append((doc_id, len(raw), encode(raw + PAD * (-len(raw) % UNIT if raw else UNIT))))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})

    return spread(docs.select("doc_id", "text")).mapInPandas(make, MEDIA)


def features(pcm: DataFrame) -> DataFrame:
    """What the stored audio says, per medium: digests, and of its PCM format, rate, samples, mean square, zero crossings, CRC-32 of its parts' CRC-32s."""
    about = [x.split()[0] for x in PCM.split(", ")][:9]

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["pcm"]:
                v = np.frombuffer(x or b"", "<i2")
                negative = v < 0
                square = sum(int((v[a : a + SLICE].astype(np.int64) ** 2).sum()) for a in range(0, len(v), SLICE))
                out.append((len(v), square, int((negative[1:] != negative[:-1]).sum()), *((bool(negative[0]), bool(negative[-1])) if len(v) else (None, None)), zlib.crc32(v.tobytes())))
            yield pd.concat([b[[*about, "part"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "square", "crossings", "first", "last", "crc"])], axis=1)

    schema = ", ".join(PCM.split(", ")[:10]) + ", n long, square long, crossings long, first boolean, last boolean, crc long"
    d = pcm.mapInPandas(measure, schema)
    part = F.struct("part", "n", "square", "crossings", "first", "last", "crc")
    g = d.groupBy("id").agg(*[F.first(c).alias(c) for c in about[1:]], F.array_sort(F.collect_list(part)).alias("parts"))  # a medium's parts: its length over SLICE

    def total(c: str) -> F.Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x[c])

    seams = F.size(F.filter(F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda a, b: a["last"] != b["first"]), lambda x: x))
    name = F.when(F.col("tag") == MULAW, "mulaw").when(F.col("tag") == ALAW, "alaw").when(F.col("tag") == ADPCM, "adpcm")
    crcs = F.array_join(F.transform("parts", lambda x: x["crc"].cast("string")), ",")
    g = g.withColumn("samples", total("n"))
    shown = F.concat_ws(":", name, F.lit(str(RATE * UP // DOWN)), F.col("samples").cast("string"), F.expr("CAST(aggregate(parts, 0L, (s, x) -> s + x.square) DIV greatest(1L, samples) AS STRING)"), (total("crossings") + seams).cast("string"), F.lower(F.lpad(F.hex(F.crc32(crcs)), 8, "0")))
    return g.select(*about[1:8], F.when(name.isNotNull(), shown).alias("feature"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While it lasts, jobs of this session send `rows` rows at a time to Python: rows of audio are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def heard(docs: DataFrame) -> DataFrame:
    """Texts stored as telephony audio, read back and decoded to stored PCM: features of each document.

    PCM is four to eight times as long as its text. It is written, read back and measured in
    WAVES, and goes once its features are kept, so the shared folder holds a wave of it at a
    time. A wave is a share of the tasks that wrote media, found by its folder.
    """
    spark = docs.sparkSession
    at, kept = new_path(spark, "media"), []
    media = stored_payloads(docs).select(F.monotonically_increasing_id().alias("id"), "doc_id", "n_bytes", "media", (F.spark_partition_id() % WAVES).alias("wave"))
    media.write.options(**PAGES).partitionBy("wave").parquet(at, compression="zstd")
    media = spark.read.schema(media.schema).parquet(at)
    with small_batches(spark):
        for wave in range(WAVES):
            pcm = stored(decoded(media.where(F.col("wave") == wave)), "pcm", **PAGES)
            path = made[-1]
            kept.append(stored(features(pcm), "features"))
            delete(spark, [path])
    delete(spark, [at])
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heard(table(spark, sf_dir, "documents"))
