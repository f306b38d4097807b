"""Removal of byte strings that repeat across documents, by suffix sorting with a difference cover.

Texts are kept in packs of a few megabytes. Equal strings of LENGTH bytes have to meet in
one task to be compared. Each such string has an anchor, the 25-byte string with the least
hash in it, which depends on the string alone. So:

1. every pack sends the hashes of its anchors, by range; anchors that occur in one document
   only are dropped there, since no string around them repeats (exact, nothing is lost);
2. every pack sends each remaining anchor with 25 bytes on both sides: all strings that it
   is the anchor of, in 75 bytes. Equal contexts of a pack are sent once, for the document
   with the least doc_id, however often it says them (the other places stay behind as
   numbers, so a text of one byte is one context); an anchor of very many documents is sent string by string, dealt
   by their own hashes, so that no task gets a hot one whole;
3. where they meet, all suffixes of the contexts are sorted by the difference-cover method
   modulo 3: triples at two of three positions are sorted and named, the string of names is
   sorted by recursion (to LENGTH bytes), the remaining suffixes are merged in by their first
   letter and the rank behind it, and adjacent suffixes are compared by their prefixes. In
   every run of equal prefixes the least doc_id tells whose bytes are repeats;
4. covered bytes go back to their pack, where they are removed.

Defined cases: a null or empty text has no bytes; texts shorter than LENGTH never lose any;
rows with equal doc_ids don't remove each other's bytes; a row with a null doc_id neither
loses bytes nor makes others lose theirs; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stored, table

LENGTH = 50
GRAM = 25
WIDTH = LENGTH - GRAM + 1  # grams in a string
SIDE = LENGTH - GRAM  # bytes on either side of an anchor that its strings reach
CONTEXT = GRAM + 2 * SIDE
PACK_BYTES = 1 << 22
CUT = 1 << 19  # contexts that are cut at a time
SLICE = 65_000  # strings whose anchors are found at a time: a hash and a place among them are 64 bits
BUCKET_BYTES = 1 << 23  # of text for each range of hashes
SORT_BYTES = 1 << 19  # of contexts whose suffixes are sorted at a time
HASH_BITS, BASE = 48, 0x9E3779B97F4A7C15
HOT = 20_000
PACK_ROWS = 1 << 16  # a row's number and a hash are 64 bits
PACK = "pack string, size long, ids binary, known binary, ends binary, bytes binary"


@cache
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def _zip(a: np.ndarray, level: int = 1) -> bytes:
    return _compressor(level).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(b), kind)


def _columns(a: np.ndarray) -> np.ndarray:
    """Bytes of sorted 64-bit numbers, the high ones together: they compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)


def _numbers(b: bytes) -> np.ndarray:
    c = _unzip(b, "u1").reshape(6, -1)
    out = np.zeros((c.shape[1], 8), np.uint8)
    out[:, :6] = c.T
    return out.view("<u8").ravel()


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit numbers, those of one place together."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


# --- suffix order -----------------------------------------------------------------------


def _names(*letters: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of letters, in their order."""
    code = letters[0].astype(np.int64)
    for x in letters[1:]:
        top = int(x.max()) + 1 if len(x) else 1
        if len(code) and (int(code.max()) + 1) * top >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * top + x
    most = int(code.max()) + 1 if len(code) else 0
    if most <= 8 * len(code):  # few tuples: ranked by a table of those that there are
        there = np.zeros(most, bool)
        there[code] = True
        return (np.cumsum(there) - 1)[code]
    return np.unique(code, return_inverse=True)[1]


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of s (letters from 1 on) how many come before it, told by `depth` letters at least.

    Suffixes that agree so far, and only such, may get ranks in any order or the same.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _names(t[sample], t[sample + 1], t[sample + 2]) + 1
    if depth > 3 and len(sample) and names.max() < len(sample):
        # The string of names: those of 1 modulo 3, a stop, those of 2 modulo 3.
        string = np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1])
        r = suffix_ranks(string, -(-depth // 3))
        names = np.concatenate([r[: len(one)], r[len(one) + 1 :]]) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    top = int(rank.max()) + 1
    zero = np.arange(0, n, 3)
    # By first letter and the rank behind it against those of 1 modulo 3, by two letters against those of 2.
    a0, a1 = t[zero] * top + rank[zero + 1], t[one] * top + rank[one + 1]
    pairs = _names(np.concatenate([t[zero], t[two]]), np.concatenate([t[zero + 1], t[two + 1]]))
    b0, b2 = pairs[: len(zero)] * top + rank[zero + 2], pairs[len(zero) :] * top + rank[two + 2]
    # Everything is looked up in order, so that neighbours are found next to each other.
    o0, o1, o2, among = np.argsort(a0), np.argsort(a1), np.argsort(b2), np.argsort(names)
    s0, s1, s2 = a0[o0], a1[o1], b2[o2]
    out = np.zeros(n, np.int64)
    out[zero[o0]] = np.searchsorted(s0, s0) + np.searchsorted(s1, s0) + np.searchsorted(s2, b0[o0])
    out[sample[among]] = np.searchsorted(names[among], names[among])
    out[one[o1]] += np.searchsorted(s0, s1)
    out[two[o2]] += np.searchsorted(np.sort(b0), s2)
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for each start; starts have the same one if the next `length` bytes are equal."""
    rank = suffix_ranks(_names(text) + 1, length)[starts]
    order = np.argsort(rank, kind="stable")
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 1 << 18):
        part = order[at - 1 : at + (1 << 18)]
        w = windows[starts[part]]
        new[at : at + len(part) - 1] = (w[1:] != w[:-1]).any(1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


# --- anchors ----------------------------------------------------------------------------


class Texts:
    """A pack, opened: bytes of its texts one after another, where each ends, whose they are."""

    def __init__(self, row: pd.Series):
        self.bytes = _unzip(row["bytes"], "u1")
        self.ends, self.ids = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], "?")

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(hash, place, row, first string, last string) of each anchor; strings by where they start.

        A slice at a time; an anchor that two slices share comes twice, each with its own strings.
        """
        n = len(self.bytes) - LENGTH + 1
        parts = [self._slice(a, min(a + SLICE, n)) for a in range(0, max(n, 1), SLICE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _slice(self, a: int, z: int) -> tuple[np.ndarray, ...]:
        """Anchors of the strings that start from a to z - 1."""
        n = z - a
        if n <= 0:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
        low = np.uint64(64 - HASH_BITS)
        x = self.bytes[a : z + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        h8, power, width = x, BASE, 1
        for _ in range(3):  # hashes of 2, 4, 8 bytes
            h8 = h8[:-width] * np.uint64(power) + h8[width:]
            power, width = power * power % (1 << 64), 2 * width
        power = np.uint64(power)
        g = (h8[:-17] * power + h8[8:-9]) * power + h8[16:-1]  # 24 bytes
        g = g[: len(x) - GRAM + 1] * np.uint64(BASE) + x[GRAM - 1 :]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        # A hash with its place behind it, so that the least one says where it is, the first of equal ones.
        g = (g ^ (g >> np.uint64(32))) >> low << low | np.arange(len(g), dtype=np.uint64)
        least, width = g, 1
        while 2 * width <= WIDTH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[WIDTH - width : WIDTH - width + n])
        start = np.arange(a, z)
        row, last = np.searchsorted(self.ends, [a, z - 1], side="right")
        row = np.repeat(np.arange(row, last + 1), np.diff(np.minimum(self.ends[row : last + 1], z), prepend=a))
        i = np.flatnonzero((start + LENGTH <= self.ends[row]) & self.known[row])
        if not len(i):
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
        place, own = (least[i] & np.uint64((1 << 64 - HASH_BITS) - 1)).astype(np.int64), row[i]
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (own[1:] != own[:-1]) | (i[1:] != i[:-1] + 1)))
        last = np.append(first[1:], len(i)) - 1
        # Least hashes are small; dealt anew they are even over all ranges.
        h = (least[i[first]] >> low) * np.uint64(BASE) & np.uint64((1 << HASH_BITS) - 1)
        return h, place[first] + a, own[first], i[first] + a, i[last] + a


def packed(docs: DataFrame) -> DataFrame:
    """Whole texts in packs; a longer text is a pack of its own."""

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known, texts, size = [], [], [], 0

        def row() -> pd.DataFrame:
            ends = np.cumsum([len(t) for t in texts]).astype("<i8")
            one = (uuid.uuid4().hex, size, np.array(ids, "<i8").tobytes(), np.array(known, bool).tobytes(), ends.tobytes(), _zip(np.frombuffer(b"".join(texts), np.uint8), 6))
            return pd.DataFrame([one], columns=["pack", "size", "ids", "known", "ends", "bytes"])

        for b in batches:
            for doc_id, known_id, text in zip(b["doc_id"], b["known"], b["text"], strict=True):
                ids.append(int(doc_id))
                known.append(bool(known_id))
                texts.append(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
                size += len(texts[-1])
                if size >= PACK_BYTES or len(ids) >= PACK_ROWS:
                    yield row()
                    ids, known, texts, size = [], [], [], 0
        if ids:
            yield row()

    d = spread(docs.select("doc_id", "text"))
    return d.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text").mapInPandas(pack, PACK)


def _dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h * np.uint64(buckets) >> np.uint64(HASH_BITS)).astype(np.int64)


def _prints(buckets: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, p in b.iterrows():
                h, _, row, _, _ = Texts(p).anchors()
                own = np.unique(h << np.uint64(16) | row.astype(np.uint64)) >> np.uint64(16)  # once a document
                hashes, many = np.unique(own, return_counts=True)
                bucket = _dealt(hashes, buckets)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                out = [(int(bucket[a]), p["pack"], _zip(_columns(hashes[a:z])), _zip(np.minimum(many[a:z], 65535).astype("<u2"))) for a, z in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
                yield pd.DataFrame(out, columns=["bucket", "pack", "hashes", "many"])

    return run


def _shared(limit: int):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """Of one range of hashes, for each pack those of its hashes that more than one document has, and the hot ones among them."""
        each = [_numbers(x) for x in b["hashes"]]
        h, many = np.concatenate(each), np.concatenate([_unzip(x, "<u2") for x in b["many"]]).astype(np.int64)
        values, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, many)
        keep, hot, out, begin = total[at] > 1, total[at] > limit, [], 0
        for pack, x in zip(b["pack"], each, strict=True):
            k, w = keep[begin : begin + len(x)], hot[begin : begin + len(x)]
            begin += len(x)
            if k.any():
                out.append((pack, _zip(_columns(x[k])), _zip(w[k].astype(np.uint8))))
        return pd.DataFrame(out, columns=["pack", "hashes", "hot"])

    return run


CONTEXTS = "bucket int, pack string, many int, data binary"


def _contexts(buckets: int):
    def run(key: tuple, packs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(packs) or not len(shared):
            return pd.DataFrame(columns=[x.split(" ")[0] for x in CONTEXTS.split(", ")])
        p, name = Texts(packs.iloc[0]), packs["pack"].iloc[0]
        hashes = np.concatenate([_numbers(x) for x in shared["hashes"]])
        order = np.argsort(hashes)
        hashes, hot = hashes[order], np.concatenate([_unzip(x, "u1") for x in shared["hot"]])[order]
        h, place, row, first, last = p.anchors()
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        keep = hashes[at] == h
        h, place, row, first, last, at = (x[keep] for x in (h, place, row, first, last, at))
        padded = np.concatenate([np.zeros(SIDE, np.uint8), p.bytes, np.zeros(CONTEXT, np.uint8)])
        doc = p.ids[row]
        # A hot anchor's strings go one by one: no anchor, no sides.
        single = np.repeat(np.flatnonzero(hot[at] > 0), (last - first + 1)[hot[at] > 0])
        runs = (last - first + 1)[hot[at] > 0]
        start = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + first[single]
        window = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)
        cold = np.flatnonzero(hot[at] == 0)
        pos = np.concatenate([place[cold], start + SIDE])
        low = np.concatenate([place[cold] - last[cold], np.full(len(start), SIDE)]).astype(np.int64)
        high = np.concatenate([place[cold] - first[cold], np.full(len(start), SIDE)]).astype(np.int64)
        docs = np.concatenate([doc[cold], doc[single]])
        whole = _cut(window, pos, low, high) if len(pos) <= CUT else None  # more of them are cut anew where they are needed
        cut = lambda i: _cut(window, pos[i], low[i], high[i]) if whole is None else whole[i]
        mark = np.concatenate([_mark(cut(slice(a, z)), low[a:z], high[a:z]) for a, z in _steps(len(pos))]) if len(pos) else np.zeros(0, np.uint64)
        # Of equal contexts one stands for all: that of the least document, at its first place. Marks only suggest which are equal.
        order = np.lexsort((pos, docs))
        _, which, inverse = np.unique(mark[order], return_index=True, return_inverse=True)
        of = np.empty(len(pos), np.int64)
        of[order] = order[which][inverse.ravel()]
        other = np.flatnonzero(of != np.arange(len(pos)))
        for a, z in _steps(len(other)):
            i, j = other[a:z], of[other[a:z]]
            same = (low[i] == low[j]) & (high[i] == high[j])
            same &= (cut(i) == cut(j)).all(1)
            of[i] = np.where(same, j, i)
        covered = docs > docs[of]  # by a smaller document of this pack
        echo = ~covered & (of != np.arange(len(pos)))  # the same document says it again: its places stay here
        out = []
        if covered.any():
            spans = np.stack([pos - high, pos - low + LENGTH], axis=1)[covered]
            out.append((-1 - int(spans[0, 0]) % buckets, name, len(spans), _zip(spans.astype("<i8"))))
        if echo.any():
            again = [_planes((pos - high)[of[echo]]), _planes((pos - high)[echo]), (high - low + 1)[echo].astype(np.uint8)]
            out.append((-1 - int(pos[echo][0]) % buckets, name, -int(echo.sum()), _zip(np.concatenate([x.ravel() for x in again]))))
        send = np.flatnonzero(~covered & ~echo)
        text, pos, low, high, docs = cut(send), pos[send], low[send], high[send], docs[send]
        n_cold = int(np.searchsorted(send, len(cold)))
        code = np.concatenate([h[cold][send[:n_cold]], _string_hash(text[n_cold:])])
        bucket = _dealt(code, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:z]
            data = [_planes(docs[part]), _planes(pos[part]), low[part].astype(np.uint8), high[part].astype(np.uint8), text[part]]
            out.append((int(bucket[part[0]]), name, len(part), _zip(np.concatenate([x.ravel() for x in data]), 3)))
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in CONTEXTS.split(", ")])

    return run


def _steps(n: int) -> list[tuple[int, int]]:
    """Slices of n rows that are handled at a time."""
    return [(a, min(a + CUT, n)) for a in range(0, n, CUT)]


def _cut(window: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Contexts, which begin SIDE before their anchor; bytes that none of its strings has are no part of one."""
    text, column = window[pos], np.arange(CONTEXT)
    text[(column < (SIDE - high)[:, None]) | (column >= (SIDE - low + LENGTH)[:, None])] = 0
    return text


def _mark(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hashes of contexts: of their bytes in words of eight, and of which strings they have."""
    words = np.zeros((len(text), -(-CONTEXT // 8) * 8), np.uint8)
    words[:, :CONTEXT] = text
    h = (low << 8 | high).astype(np.uint64) + np.uint64(BASE)
    for w in words.view("<u8").T:
        h = (h ^ w) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def _string_hash(text: np.ndarray) -> np.ndarray:
    """48-bit hashes of rows of bytes."""
    h = np.zeros(len(text), np.uint64)
    for k in range(text.shape[1]):
        h = (h ^ text[:, k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(23)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - HASH_BITS)


def _first_documents(text: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every string of the contexts, one context's after another's, from the highest offset
    down, the least of docs whose context has it.
    """
    many = high - low + 1
    of = np.repeat(np.arange(len(low)), many)
    offset = high[of] - (np.arange(many.sum()) - (np.cumsum(many) - many)[of])
    # Without the bytes that no string of a context has, and in dense letters.
    column = np.arange(CONTEXT)
    used = (column >= (SIDE - high)[:, None]) & (column < (SIDE - low + LENGTH)[:, None])
    size = high - low + LENGTH
    group = equal_prefixes(text[used], (np.cumsum(size) - size - SIDE + high)[of] + SIDE - offset)
    first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, docs[of])
    return first[group]


def _compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Of the contexts that met, for each pack the spans that a smaller document has too."""
    if key[0] < 0:  # spans that are known already, and places that say what another place says
        return pd.DataFrame({"pack": b["pack"], "spans": b["data"].where(b["many"] > 0, None), "echo": b["data"].where(b["many"] < 0, None)})
    docs, places, low, high, text = [], [], [], [], []
    for many, data in zip(b["many"], b["data"], strict=True):
        raw = _unzip(data, "u1")
        docs.append(_whole(raw[: 8 * many]))
        places.append(_whole(raw[8 * many : 16 * many]))
        low.append(raw[16 * many : 17 * many])
        high.append(raw[17 * many : 18 * many])
        text.append(raw[18 * many :].reshape(many, CONTEXT))
    sent, docs, pos = [len(x) for x in docs], np.concatenate(docs), np.concatenate(places)
    low, high, text = np.concatenate(low), np.concatenate(high), np.concatenate(text)
    keys = np.ascontiguousarray(np.concatenate([text, low[:, None], high[:, None]], axis=1)).view(f"V{CONTEXT + 2}").ravel()
    _, which, inverse = np.unique(keys, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    del keys
    least = np.full(len(which), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs)
    lo, hi, text = low[which].astype(np.int64), high[which].astype(np.int64), text[which]
    many = hi - lo + 1
    begin = np.cumsum(many) - many
    first = np.empty(many.sum(), np.int64)
    # Equal strings have the same bytes in the middle of their contexts, so they stay together here.
    parts = -(-text.size // SORT_BYTES)
    part = (_string_hash(text[:, SIDE : SIDE + GRAM]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:z]
        if len(own):
            n = many[own]
            at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            first[at] = _first_documents(text[own], lo[own], hi[own], least[own])
    # And of every context that was sent.
    many = many[inverse]
    row = np.repeat(np.arange(len(docs)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    covered = first[begin[inverse[row]] + k] < docs[row]
    start = (pos[row] - high[row] + k)[covered]
    sender = np.repeat(np.arange(len(sent)), sent)[row][covered]
    out = []
    cuts = np.searchsorted(sender, np.arange(len(sent) + 1))
    for n, pack in enumerate(b["pack"]):
        s = np.sort(start[cuts[n] : cuts[n + 1]])
        if len(s):
            new = np.append(True, s[1:] > s[:-1] + 1)
            ends = np.append(np.flatnonzero(new)[1:], len(s)) - 1
            out.append((pack, _zip(np.stack([s[new], s[ends] + LENGTH], axis=1).astype("<i8"))))
    return pd.DataFrame([(*x, None) for x in out], columns=["pack", "spans", "echo"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(texts: bool):
    def run(key: tuple, packs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        p = Texts(packs.iloc[0])
        n = len(p.bytes)
        s = np.concatenate([np.zeros((0, 2), "<i8"), *[_unzip(x, "<i8").reshape(-1, 2) for x in spans["spans"].dropna()]])
        change = np.bincount(s[:, 0], minlength=n + 1) - np.bincount(s[:, 1] - LENGTH + 1, minlength=n + 1)
        starts = np.cumsum(change[:n]) > 0  # of strings that a smaller document has
        again = np.zeros(n, bool)
        for x in spans["echo"].dropna():
            raw = _unzip(x, "u1")
            k = len(raw) // 17
            of, to, many = _whole(raw[: 8 * k]), _whole(raw[8 * k : 16 * k]), raw[16 * k :]
            for j in range(int(many.max())):
                more = many > j
                again[to[more] + j] |= starts[of[more] + j]
        so_far = np.cumsum(starts | again, dtype=np.int64)
        gone = so_far > np.concatenate([np.zeros(min(n, LENGTH), np.int64), so_far[:-LENGTH]])
        out, a = [], 0
        for doc_id, known, z in zip(p.ids.tolist(), p.known.tolist(), p.ends.tolist(), strict=True):
            g = gone[a:z]
            kept = p.bytes[a:z][~g].tobytes()
            runs = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
            out.append((doc_id if known else None, z - a, int(g.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            a = z
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return run


def deduplicated(docs: DataFrame, texts: bool = True, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    hot: anchors of more documents are sent string by string.
    """
    packs = stored(packed(docs), "packs")
    size = packs.agg(F.sum("size")).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (lambda d: d.repartition(buckets, "bucket")) if buckets > tasks else (lambda d: d)  # a range of hashes per task at most
    prints = dealt(packs.mapInPandas(_prints(buckets), "bucket int, pack string, hashes binary, many binary"))
    shared = prints.groupBy("bucket").applyInPandas(_shared(hot), "pack string, hashes binary, hot binary")
    met = packs.groupBy("pack").cogroup(shared.groupBy("pack")).applyInPandas(_contexts(buckets), CONTEXTS)
    spans = stored(dealt(met).groupBy("bucket").applyInPandas(_compare, "pack string, spans binary, echo binary"), "spans")
    found = packs.groupBy("pack").cogroup(spans.groupBy("pack")).applyInPandas(_remove(texts), RESULT)
    return found if texts else found.drop("kept")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS new FROM w JOIN f USING (s) WHERE m < doc_id),
n AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, k),
q AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail, list(struct_pack(a, z) ORDER BY a) AS spans FROM r GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM (SELECT r.doc_id, h, a, lag(z, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) AS before FROM r JOIN d ON r.doc_id = d.doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN q.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN p ON d.doc_id = p.doc_id
"""
