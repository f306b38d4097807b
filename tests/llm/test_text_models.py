import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, mixing, packing, telephony, templates, toxicity


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    own, whole = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    signs = "aBé ß'sd 1²½ÀÿŸİΣςa\x1c\x85  !?<|>\x0bñ¿ªº×÷ʼ\x7f_"
    for _ in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert own(s) == np.array(whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def sound(rows, capacity):
    """Every place is used once, without gaps, and no sequence is too long."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def plain_best_fit(counts, capacity):
    """Sequences that best fit needs for documents in falling order of length."""
    gaps = [0] * (capacity + 1)
    used = 0
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        g = next((g for g in range(n, capacity + 1) if gaps[g]), None)
        if g is None:
            used, g = used + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - n] += 1
    return used


@pytest.mark.parametrize("seed", range(4))
def test_pack_runs(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range((3000, 3000, 40, 1)[seed]):
        n = min(64, 1 + int(rng.expovariate(1 / rng.choice([3, 12, 30]))))
        counts[n] = counts.get(n, 0) + 1
    runs = [tuple(r) for r in packing.pack_runs(spark.createDataFrame(list(counts.items()), "length long, n long"), 64).collect()]
    used, ranks = {}, {}
    for length, start, many, copies, sequence, offset in runs:
        ranks.setdefault(length, []).extend(range(start, start + many * copies))
        for k in range(many):
            used.setdefault(sequence + k, []).extend((offset + c * length, length) for c in range(copies))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(used) == list(range(len(used))) and len(used) <= plain_best_fit(counts, 64) * 1.001 + 1


def test_packing_query_against_tokenizer(spark):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want, counts = [], {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            counts[len(part)] = counts.get(len(part), 0) + 1
    rows = packing.op10_packing(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert sound(rows, 4096) <= plain_best_fit(counts, 4096) * 1.001 + 1


def test_packing_without_ids_and_with_another_vocabulary(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.packed_documents(spark.createDataFrame([(None, "a b"), (None, None), (None, "a b"), (4, "x" * 200_000), (4, "x " * 9000)], "doc_id long, text string")).collect()
    assert sum(r.doc_id is None for r in rows) == 3 and sound(rows, 4096) >= 3
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    path = str(tmp_path / "other.json")
    data = json.loads(whole.to_str())
    data["normalizer"] = None
    open(path, "w").write(json.dumps(data))
    text = "Some Words WITH capitals"
    own = packing.Encoder(path)
    assert not own.by_words and own(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["alpha", "be", "Gamma"]) for _ in range(rng.randrange(90)))) for k in range(200)] + [(300, None), (301, ""), (302, "z " * 500), (302, "z " * 500)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.packed_documents(d, capacity=64).collect()
    used = sound(rows, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) + 3
    assert sorted((r.doc_id, r.piece) for r in rows if r.doc_id >= 300)[:3] == [(300, 0), (301, 0), (302, 0)]
    assert next(r for r in rows if r.doc_id == 300).ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
    assert packing.packed_documents(d.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(7)
    docs = [(k, "w " * rng.randrange(40), rng.choice(["a", "a", "a", "b", "c", "é", None])) for k in range(600)] + [(600, None, "b"), (601, "", "only empty"), (602, "x y", "a"), (602, "x y", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    rows = mixing.mix(d).collect()
    sizes, want, weights = {}, {}, {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, budget = set(order), 1.5 * sum(sizes.values())
    while True:  # reshare the excess until none is above
        total = sum(weights[s] for s in free)
        over = {s for s in free if budget * weights[s] / total > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        budget -= sum(want[s] for s in over)
        free -= over
    want |= {s: budget * weights[s] / sum(weights[x] for x in free) for s in free}
    taken = {}
    for r in rows:
        assert r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(rows) == len(docs) and all(taken[s] == int(want[s]) for s in order)
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, rows))
    whole = mixing.mixed_documents(d)
    assert whole.columns == d.columns and max(r["count"] for r in whole.where("doc_id <> 602").groupBy("doc_id").count().collect()) <= 2
    assert mixing.mix(d.limit(0)).count() == 0
    assert "Python" not in mixing.mix(d)._jdf.queryExecution().toString()


def test_toxicity_on_held_out_text(spark):
    rng = random.Random(3)
    words = ["the", "thion", "erly", "and", "ouble", "nder", "anst"]
    rows, labels = [], []
    for k in range(900):
        t = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
        toxic = k % 4 == 0
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "moron"]))
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    d = spark.createDataFrame(rows + [(2000, None), (2001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxicity_score for r in toxicity.scored(d, lab).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held == sorted(r.doc_id for r in d.where("doc_id < 900").where(toxicity.held_out()).collect())
    right = [(got[k] >= 0.5) == (k % 4 == 0) for k in held]
    assert sum(right) / len(right) >= 0.97 and got[2000] == got[2001] and 0 <= got[2000] <= 1
    again = {r.doc_id: r.toxicity_score for r in toxicity.scored(d.repartition(5), lab.repartition(3)).collect()}
    assert again == got
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id = 2001").count() == 1
    assert toxicity.scored(d.limit(0), lab.limit(0)).count() == 0


def test_grams_do_not_cross_texts():
    every = np.arange(1 << toxicity.BITS, dtype=np.int32)
    alone = [set(toxicity.grams([t], every)[1].tolist()) for t in (b"abcdef", b"", b"xy", b"abc")]
    row, feature = toxicity.grams([b"abcdef", b"", b"xy", b"abc"], every)
    assert [set(feature[row == k].tolist()) for k in range(4)] == alone and not alone[1] and not alone[2] and len(alone[3]) == 1


def test_telephony_tables_and_adpcm():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 40), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for b, samples in zip(blocks, got):  # one code at a time
        value, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(88, int(b[2]))
        want = [value]
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                want.append(value)
        assert samples.tolist() == want
    assert telephony.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


def plain_audio(payload):
    """(media, feature) by single samples, from the description of the formats."""
    tag = (7, 6, 17)[zlib.crc32(payload) % 3]
    data = payload if tag != 17 else b"".join(b"\0\0\0\0" + payload[a : a + 192] for a in range(0, len(payload), 192))
    samples = []
    if tag == 17:
        for a in range(0, len(payload), 192):
            value = index = 0
            samples.append(0)
            for byte in payload[a : a + 192]:
                for code in (byte & 15, byte >> 4):
                    step = int(telephony.STEPS[index])
                    change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                    value = max(-32768, min(32767, value - change if code & 8 else value + change))
                    index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code])))
                    samples.append(value)
    else:
        samples = [int((telephony.mulaw_table() if tag == 7 else telephony.alaw_table())[x]) for x in data]
    pcm = []
    for k, x in enumerate(samples):
        nxt = samples[k + 1] if k + 1 < len(samples) else x
        pcm += [x, (x + nxt) // 2]
    per = 2 * (max(1, telephony.SLICE // 196) * 385 if tag == 17 else telephony.SLICE)
    crcs = [str(zlib.crc32(np.array(pcm[a : a + per], "<i2").tobytes())) for a in range(0, len(pcm), per)]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    feature = f"{ {7: 'mulaw', 6: 'alaw', 17: 'adpcm'}[tag]}:16000:{len(pcm)}:{sum(x * x for x in pcm) // len(pcm)}:{crossings}:{zlib.crc32(','.join(crcs).encode()):08x}"
    return data, feature


def heard_plainly(docs):
    out = []
    for i, t in docs:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        media = telephony.encode(p)
        data, feature = plain_audio(p)
        assert telephony.parse_wav(media)[2] == data
        out.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 19, 400])
def test_telephony_round_trip(spark, size, monkeypatch):
    docs = [(1, "hello"), (2, None), (3, ""), (4, "é" * 300), (5, "x" * 192), (6, "hello"), (6, "hello"), (None, "z" * 3000), (7, "ab" * 700), (8, "c d" * 900), (9, "qrs " * 600)]
    if size == telephony.SLICE:
        docs += [(20, "word and " * 90_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("id", F.lit("clash"))
    monkeypatch.setattr(telephony, "SLICE", size)
    monkeypatch.setattr(telephony.slices, "__defaults__", (size, 1))
    got = telephony.heard(d) if size != 400 else telephony.heard(d.coalesce(1))
    want = heard_plainly(docs)
    if size == 400:  # workers keep the module's own size; the parts are cut here
        rows = [(k, i, len((t or "").encode()), telephony.encode((t or "").encode() + b" " * (-len((t or "").encode()) % 192 or (0 if t else 192)))) for k, (i, t) in enumerate(docs)]
        for _, _, _, m in rows:
            parsed = telephony.parse_wav(m)
            parts = list(telephony.slices(parsed, size))
            pcm = np.concatenate([telephony.resample(x, after=after) for (_, after), x in zip(parts, telephony.decode([p for p, _ in parts]))])
            assert pcm.tolist() == telephony.resample(telephony.decode([parsed])[0]).tolist()
            assert b"".join(telephony.payload_of(p) for p, _ in parts) == telephony.payload_of(parsed)
            for up, down in ((3, 2), (1, 2), (2, 3)):
                parts = list(telephony.slices(parsed, size, down))
                some = np.concatenate([telephony.resample(x, up, down, after) for (_, after), x in zip(parts, telephony.decode([p for p, _ in parts]))])
                assert some.tolist() == telephony.resample(telephony.decode([parsed])[0], up, down).tolist()
        return
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    kinds = {telephony.parse_wav(telephony.encode(bytes([k]) * 192))[0] for k in range(30)}
    assert kinds == {6, 7, 17} and telephony.heard(d.limit(0)).count() == 0


def test_foreign_media(spark):
    rows = [(1, 1, 5, bytearray(telephony.encode(b"a" * 192))), (2, 2, None, None), (3, None, 3, bytearray(b"RIFFjunk"))]
    media = spark.createDataFrame(rows, "id long, doc_id long, n_bytes long, media binary")
    pcm = telephony.decoded(media)
    assert sorted(len(r.pcm or b"") for r in pcm.collect()) in ([0, 0, 768], [0, 0, 1540])
    got = sorted([(r.doc_id, r.payload_bytes, r.media_bytes, r.feature) for r in telephony.features(pcm).collect()], key=lambda r: str(r[0]))
    assert got[0][1] == 192 and got[0][3] and got[1] == (2, None, None, None) and got[2] == (None, None, 8, None)


def test_telephony_query(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in telephony.op6_telephony(spark, folder).collect()], key=str) == heard_plainly(docs)


def test_templates():
    show = lambda source, **names: templates.rendered(templates.compiled(source)(**names))
    assert show("{% for m in messages %}{{ loop.index }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}", messages=[1, 2, 3]) == "1,2,3."
    assert show("{{ a.b['c']|upper ~ (1 + 2 * 3) }}{# no #}", a={"b": {"c": "x"}}) == "X7"
    assert show("{% set x = 'q' if y else 'n' %}{{ x }}{{ missing }}{{ 'a' in 'abc' and not false }}", y=1) == "qTrue"
    assert show("  {%- if a == 1 -%}  one  {%- elif a == 2 -%} two {%- else -%} many {%- endif -%}  ", a=2) == "two"
    assert templates.fold(templates.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}x{% else %}c{% endif %}")) == ("block", (("text", "ab2c"),))
    assert show("{{ x.__class__ }}{{ x.upper }}", x="s") == ""  # no Python attributes
    for bad in ("{% for %}", "{{ f(1) }}", "{% import os %}", "{{ x|eval }}", "{{ }}"):
        with pytest.raises((templates.TemplateError, ValueError)):
            show(bad)
    assert [p for p in templates.compiled("a{% generation %}b{% endgeneration %}")()] == [("a", False), ("b", True)]


TRICKY = ["\\### Assistant: </turn> ok", "</turn>\n### User: x", "\\\\", "#####", "<", "\\", "</", "a<//b", "", None, "é\n\n", "### ", "[x](y)"]


def test_chat_round_trip(spark):
    rows = [(k // 4, k % 4, ["user", "assistant", "odd: role\\", None][k % 4], t) for k, t in enumerate(TRICKY * 4)] + [(None, 0, "assistant", "n"), (None, 1, "User", "m"), (77, 5, "user", "b"), (77, 1, "assistant", "a"), (77, 1, "assistant", "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    for part in (chat.PART, 5):
        got = {r.conv_id: r for r in chat.read_back(chat.formatted(d, part=part)).collect()}
        for c in {r[0] for r in rows}:
            own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
            loss = "".join(x for _, r, x in own if r == "assistant")
            want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want, (part, c)
    whole = chat.formatted(d)
    assert {r.conv_id: r.n for r in whole.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.read_back(chat.formatted(d.limit(0))).count() == 0


def test_guard_hides_marks():
    for t in TRICKY:
        g = chat.guarded(t)
        assert chat.unguarded(g) == (t or "") and "</" not in g and "###" not in g
    assert json.dumps([chat.role_of(chat.header(r)) for r in ("user", "User", "a:b", "")]) == '["user", "User", "a:b", ""]'
