import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import pii, warc

from . import plain_pii

FOLDER = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def texts(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, schema)).collect()}


CARD, IP, PHONE = "4785380592391139", "67.249.65.250", "+1 (942) 555-3818"


def test_formats_stay_and_validate(spark):
    values = [CARD, "4111 1111 1111 1111", IP, PHONE, "123-45-6789", "DE89370400440532013000", "2020-02-29", "29.02.2020", "12/31/1999", "31/12/1999", "a.b@mail9.example.com"]
    got = texts(spark, list(enumerate(values)))
    for k, v in enumerate(values):
        assert got[k].text != v and got[k].pii_replaced == 1, v
        if k < 10:
            assert re.sub("[0-9]", "9", got[k].text) == re.sub("[0-9]", "9", v) or v == IP
    assert luhn(got[0].text) and luhn(got[1].text.replace(" ", ""))
    iban = got[5].text
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(0 <= int(x) <= 255 for x in got[2].text.split("."))
    assert int(got[9].text[:2]) > 12  # still day first only


def test_equal_values_stay_linked(spark):
    got = texts(spark, [(1, f"x {CARD}, y"), (2, f"{CARD} and {CARD}"), (3, f"call {PHONE}."), (4, f"({PHONE})")])
    card = got[1].text.split()[1].rstrip(",")
    assert got[2].text == f"{card} and {card}" and got[2].pii_replaced == 2
    assert got[3].text[5:-1] == got[4].text[1:-1]


def test_what_is_not_valid_stays(spark):
    rows = ["4785380592391138", "300.1.1.1", "2021-02-30", "666-12-1234", "plain text, 12 3", "1.2.3.4.5", "", None]
    got = texts(spark, list(enumerate(rows)))
    assert [got[k].text for k in range(len(rows))] == rows and all(r.pii_replaced == 0 for r in got.values())


def test_permutation(spark):
    """Different values of a format stay different, and every number of a small domain is reached once."""
    d = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert d.select(pii.permuted_digits("k", F.col("d"), "t").alias("p")).distinct().count() == 100
    days = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2003-12-31')) AS d")
    got = days.select(pii._day("k", F.col("d")).alias("p"))
    assert got.distinct().count() == days.count() and got.where("p < '1800-01-01' OR p > '2199-12-31'").count() == 0


def made(rng):
    """A value of some kind, or something close to one."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    card = d(rng.choice([12, 13, 15, 15, 15, 18]))
    card += str(-plain_pii.luhn(card + "0") % 10)
    bban = rng.choice(["ABCD", ""]) + d(16)
    check = 98 - int("".join(str(int(c, 36)) for c in bban + "GB00")) % 97
    return rng.choice([
        card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:16]}", d(16), f"GB{check:02d}{bban}", "GB00" + bban, f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(300)}", "1.2.3.4",
        f"{d(3)}-{d(2)}-{d(4)}", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{d(4)}", f"+1 {rng.randrange(200, 999)}.{rng.randrange(200, 999)}.{d(4)}", f"+353 {d(3)} {d(4)}", f"+971 {d(2)} {d(3)} {d(4)}", f"+49-{d(3)}-{d(4)}{d(1)}", f"+7 {d(3)} {d(3)} {d(2)}",
        f"{rng.randrange(1700, 2300)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}", f"{rng.randrange(1, 33):02d}.{rng.randrange(1, 14):02d}.{rng.randrange(1800, 2200)}", f"{rng.randrange(1, 33):02d}/{rng.randrange(1, 33):02d}/{rng.randrange(1800, 2200)}",
        f"{h(6)}.x@{h(4)}.Example.com", f'token = "{h(40)}"', f"key={h(32)}", 'token = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6"', "AKIA" + d(8) + "ABCDEFGH", "AKIA" + "A" * 15,
    ])


def test_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", "é ", "a "]).join(rng.choice([made(rng), made(rng), "words, and", "12 3", "("]) + rng.choice([" ", ", ", "\n", "; "]) for _ in range(rng.randrange(12)))) for k in range(500)]
    got = {r.doc_id: (r.text, r.pii_replaced) for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), key="another").collect()}
    assert got == {k: plain_pii.pseudonymised(t, "another") for k, t in rows}
    assert sum(n for _, n in got.values()) > 500 and all(re.search(pii.HINT, m[0]) for _, t in rows for m in plain_pii.MATCH.finditer(t))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_against_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.pii_replaced) for r in pii.op1_pii(spark, FOLDER).collect()}
    assert got == {k: plain_pii.pseudonymised(t) for k, t in docs.items()}


def test_secret_without_digit_pairs(spark):
    got = texts(spark, [(1, 'token = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6"'), (2, "+353 123 4567"), (3, "+971 50 123 4567")])
    assert got[1].pii_replaced == 1 and "a1b2c3d4" not in got[1].text
    assert got[2].text.startswith("+353 ") and got[3].text.startswith("+971 ")


def test_key_is_a_setting(spark):
    d = spark.createDataFrame([(1, CARD)], "doc_id long, text string")
    plain = pii.pseudonymised(d).first().text
    spark.conf.set(pii.KEY_SETTING, "k2")
    try:
        assert pii.pseudonymised(d).first().text == pii.pseudonymised(d, key="k2").first().text != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pii_extra_columns_and_empty(spark):
    d = spark.createDataFrame([(1, CARD, 5, "x", "y", "z")], "doc_id long, text string, pii_replaced int, found string, pii_found string, PII_new string")
    got = pii.pseudonymised(d)
    assert got.columns == [*d.columns, "pii_replaced_"] and tuple(got.first())[2:] == (5, "x", "y", "z", 1) and got.first().text != CARD
    again = spark.createDataFrame([(1, f"{CARD} {CARD}"), (1, f"{CARD} {CARD}")], "doc_id long, text string")
    assert len({r.text for r in pii.pseudonymised(again).collect()}) == 1
    assert pii.pseudonymised(d.limit(0)).count() == 0
    long = "word " * 200_000 + CARD
    assert texts(spark, [(1, long)])[1].pii_replaced == 1


def test_pii_is_native(spark):
    plan = pii.pseudonymised(spark.createDataFrame([(1, CARD)], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(pages):
    first = {}
    for i, _, html in pages:
        if html is not None and len(html.encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    import hashlib

    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        again = len(b) >= 100 and html in first and i != first[html]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def test_captures(spark):
    tricky = "z\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9
    pages = [(1, "u", "x" * 120), (2, "u\r\nX: y", "x" * 120), (2, "u\r\nX: y", "x" * 120), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "q", tricky), (7, "q", tricky), (8, "", "\r\n\r\n"), (9, "é", "é" * 60), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "w" * 3_000_000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(d).collect()], key=str)
    assert got == brute(pages)
    assert warc.captures(d.limit(0)).count() == 0


def test_urls_ids_and_repeats(spark):
    x = "x" * 120
    pages = [(1, "u1", x), (1, "u2", x), (2, "u1", x), (2, "u1", x), (2, None, x), (2, "", x), (None, "n", x), (None, "m", "short")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.captures(d).collect()
    assert sorted([(r.page_id, r.url) for r in got], key=str) == sorted([(i, u) for i, u, _ in pages], key=str)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(pages)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_warc_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc(spark, FOLDER).collect()], key=str) == brute(pages)


def test_damaged_archives(spark, tmp_path):
    import gzip

    d = spark.createDataFrame([(1, "http://a/", "x" * 150)], "page_id long, url string, html string")
    warc.write_archives(d.coalesce(1), f"file://{tmp_path}/w")
    raw = b"".join(zlib.decompress(p.read_bytes(), 31) for p in sorted((tmp_path / "w").glob("part-*.gz")))
    for name, bad in (("cut", raw[:-30]), ("junk", b"oops" + raw), ("between", raw.replace(b"\r\n\r\nWARC/1.1", b"\r\n\r\nstray\r\n\r\nWARC/1.1"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="ends after|should begin"):
            warc.read_records(spark, f"file://{tmp_path}/{name}").collect()
    (tmp_path / "changed").mkdir()
    (tmp_path / "changed" / "a.gz").write_bytes(gzip.compress(raw.replace(b"xxx", b"xyx", 1)))
    assert sorted((r.type, r.intact) for r in warc.read_records(spark, f"file://{tmp_path}/changed").collect()) == [("metadata", True), ("request", True), ("response", False)]


def test_payloads_that_end_in_line_ends(spark):
    ends = ["\r\n", "\r", "\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r\n\r", "\r\n\n"]
    pages = [(k, "u", "<html>" + "x" * n + end) for k, (n, end) in enumerate((n, end) for n in (3, 150) for end in ends)]
    pages += [(i + 50, u, html) for i, u, html in pages] + [(200, "u", "\r\n")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(d.coalesce(1)).collect()], key=str)
    assert got == brute(pages)


def test_archives_are_warc(spark, tmp_path):
    d = spark.createDataFrame([(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150)], "page_id long, url string, html string")
    warc.write_archives(d.coalesce(1), f"file://{tmp_path}/w")
    raw = b"".join(zlib.decompress(p.read_bytes(), 31) for p in sorted((tmp_path / "w").glob("part-*.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 6 and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Concurrent-To: ") == 4 and raw.count(b"WARC-Refers-To: ") == 1
    t = warc.transactions(warc.read_records(spark, f"file://{tmp_path}/w", payloads=True)).collect()
    assert len(t) == 2 and all(r.request.type == "request" and r.metadata.record.type == "metadata" for r in t)
    assert sorted(len(r.response.payload) for r in t) == [0, 150]
