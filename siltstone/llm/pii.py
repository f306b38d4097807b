"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network within their own format:
a payment card stays a number of the same length and grouping that passes its checksum, a
date stays a valid date, an IPv4 address stays one. The permutation depends on the key and
the kind of value alone, so equal values stay equal across documents, and different values
of a format stay different. What fails its validation is left as it is.

Kinds: payment cards (13 to 19 digits with a Luhn check, in one run or in the usual groups),
IBANs (mod 97; their digits are permuted, letters stay, check digits are computed anew),
North American phone numbers, other international phone numbers (country code kept),
US social security numbers, IPv4 addresses, dates (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, or
dd/mm/yyyy where that alone is valid; years 1800 to 2199). E-mail addresses and secrets
(assigned hex tokens, AKIA access keys) are no numbers; they get keyed-hash pseudonyms of
the same shape.

The key comes from the session's spark.siltstone.pii.key or is given; KEY is a public one for
tests, and whoever knows a key can undo the permutation.

Defined cases: a null text stays null, an empty one empty, with 0 replacements; ties and
repeated rows are treated alike; all other columns pass through, whatever their names: if one
has the name of the count, the count gets an underscore behind its own; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: For tests; a cluster sets its own in KEY_SETTING.
KEY = "siltstone-pseudonyms-1"
KEY_SETTING = "spark.siltstone.pii.key"
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind and pattern, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?<=[\"'=: ])[0-9a-f]{40}|(?<=[\"'=: ])[0-9a-f]{32})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])(?!\.[0-9])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(KINDS.values())
#: What every match of every kind holds: rows without it aren't searched.
HINT = r"@|[0-9][0-9]|\.[0-9]|AKIA|[0-9a-f]{32}"
# The international calling codes of one and two digits; all others have three.
CALLING_CODES = r"1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
DAY0, DAYS = "1800-01-01", (189, 773)  # 146,097 days: 400 years of the calendar


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), computing value once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hash(*parts: Column | str) -> Column:
    """A hash of strings, the key among them, as 60 bits."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, left: Column, right: Column, mod_left: Column | int, mod_right: Column | int, tweak: str, extra: Column | None = None) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (mod_left, mod_right)."""
    a, b = (m if isinstance(m, Column) else F.lit(m).cast("bigint") for m in (mod_left, mod_right))
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    more = [extra] if extra is not None else []

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        new_l = F.pmod(l + _hash(key, tweak, *more, i.cast("string"), r.cast("string")) % a, a)
        new_r = F.pmod(r + _hash(key, tweak, *more, i.cast("string"), l.cast("string")) % b, b)
        even = i % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(l).alias("l"), F.when(even, r).otherwise(new_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permuted_digits(key: str, digits: Column, tweak: str) -> Column:
    """A permutation of the digit strings of one length, up to 36 digits; shorter than 2: as they are."""

    def run(d: Column) -> Column:
        n, half = F.length(d), F.floor(F.length(d) / 2).cast("int")
        rest = n - half
        made = feistel(key, F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest), _pow10(half), _pow10(rest), tweak, n.cast("string"))
        return let(made, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), rest, "0")))

    return let(digits, lambda d: F.when(F.length(d) < 2, d).otherwise(run(d)))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""

    def term(i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + term(i)) % 10


def mod97(text: Column) -> Column:
    """ISO 7064 remainder of letters and digits."""

    def step(r: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.between("0", "9"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of `digits`."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))

    def step(s: Column, i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        digit = c.between("0", "9")
        return F.struct(F.concat(s["t"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("t"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, step, lambda s: s["t"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(key: str, m: Column) -> Column:
    def run(d: Column) -> Column:
        body = permuted_digits(key, F.substring(d, F.lit(1), F.length(d) - 1), "card")
        full = let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn(d) == 0, _refill(m, full))

    return let(_digits(m), run)


def _iban(key: str, m: Column) -> Column:
    def run(b: Column) -> Column:
        check = let(b, lambda x: 98 - mod97(F.concat(x, F.substring(m, 1, 2), F.lit("00"))))
        return F.concat(F.substring(m, 1, 2), _pad(check, 2), b)

    bban = F.substring(m, F.lit(5), F.length(m))
    valid = mod97(F.concat(bban, F.substring(m, 1, 4))) == 1
    return F.when(valid, let(_refill(bban, permuted_digits(key, _digits(bban), "iban")), run))


def _day(key: str, date: Column) -> Column:
    """Pseudonym of a date as a date; null if there is none or it is out of range."""
    a, b = DAYS

    def run(n: Column) -> Column:
        made = feistel(key, F.floor(n / b), n % b, a, b, "date")
        return F.when((n >= 0) & (n < a * b), F.date_add(F.lit(DAY0).cast("date"), let(made, lambda x: x["l"] * b + x["r"]).cast("int")))

    return let(F.datediff(date, F.lit(DAY0).cast("date")), run)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """The date of three digit strings, null if there is none: digits are checked before the cast."""
    return F.concat_ws("-", y, m, d).try_cast("date")


def _parts(m: Column, y: int, mo: int, d: int) -> Column:
    return _ymd(F.substring(m, y, 4), F.substring(m, mo, 2), F.substring(m, d, 2))


def _slash(key: str, m: Column) -> Column:
    us, eu = _parts(m, 7, 1, 4), _parts(m, 7, 4, 1)
    # Only days over 12 are dd/mm alone: the permutation is walked until it comes back to one.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), _day(key, eu), lambda x, _: F.when(F.dayofmonth(x) > 12, x).otherwise(_day(key, x)))
    return F.when(us.isNotNull(), F.date_format(_day(key, us), "MM/dd/yyyy")).otherwise(F.date_format(walk, "dd/MM/yyyy"))


def _ip(key: str, m: Column) -> Column:
    def run(p: Column) -> Column:
        n = [F.element_at(p, k).cast("bigint") for k in (1, 2, 3, 4)]
        made = feistel(key, n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip")
        return let(made, lambda x: F.concat_ws(".", *[v.cast("string") for h in (x["l"], x["r"]) for v in (F.floor(h / 256).cast("int"), (h % 256).cast("int"))]))

    return let(F.split(m, r"\."), run)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    made = feistel(key, (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")

    def show(x: Column) -> Column:
        a = F.floor(x["l"] / 99) + 1
        return F.concat_ws("-", _pad(F.when(a >= 666, a + 1).otherwise(a), 3), _pad(x["l"] % 99 + 1, 2), _pad(x["r"] + 1, 4))

    return F.when(valid, let(made, show))


def _phone(key: str, m: Column) -> Column:
    def run(d: Column) -> Column:
        n = F.substring(d, F.length(d) - 9, F.lit(10))  # the national number: area and exchange from 200 on
        left = (F.substring(n, 1, 3).cast("bigint") - 200) * 100 + F.substring(n, 7, 2).cast("bigint")
        right = (F.substring(n, 4, 3).cast("bigint") - 200) * 100 + F.substring(n, 9, 2).cast("bigint")
        made = feistel(key, left, right, 80_000, 80_000, "phone")
        national = let(made, lambda x: F.concat(_pad(F.floor(x["l"] / 100) + 200, 3), _pad(F.floor(x["r"] / 100) + 200, 3), _pad(x["l"] % 100, 2), _pad(x["r"] % 100, 2)))
        return _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), national))

    return let(_digits(m), run)


def _abroad(key: str, m: Column) -> Column:
    def run(d: Column) -> Column:
        code = F.regexp_extract(d, f"^(?:{CALLING_CODES}|[0-9]{{3}})", 0)
        return _refill(m, F.concat(code, permuted_digits(key, F.substring(d, F.length(code) + 1, F.length(d)), "abroad")))

    return let(_digits(m), run)


def _email(key: str, m: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 15), F.lit("@d"), F.substring(h, 17, 7), F.lit(".example"))


def _secret(key: str, m: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256)
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))).otherwise(F.substring(h, F.lit(1), F.length(m)))


_MAKE = {
    "email": _email, "secret": _secret, "iban": _iban, "iso_date": lambda k, m: F.date_format(_day(k, _parts(m, 1, 6, 9)), "yyyy-MM-dd"),
    "dot_date": lambda k, m: F.date_format(_day(k, _parts(m, 7, 4, 1)), "dd.MM.yyyy"), "slash_date": _slash, "ip": _ip, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card,
}


def _kind(m: Column) -> Column:
    """The kind of a matched string, by its own shape."""
    shapes = [("email", "@"), ("secret", "^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{32})$"), ("iban", "^[A-Z]"), ("iso_date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("dot_date", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), ("slash_date", "/"), ("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("phone", KINDS["phone"].replace("(?<![0-9+])", "^").replace("(?![0-9])", "$")), ("abroad", r"^\+")]
    kind = F.lit("card")
    for name, pattern in reversed(shapes):
        kind = F.when(m.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one matched value, null if it fails its validation."""

    def choose(kind: Column) -> Column:
        made = F.lit(None).cast("string")
        for name, make in reversed(_MAKE.items()):
            made = F.when(kind == name, make(key, m)).otherwise(made)
        return made

    return let(_kind(m), choose)


def pseudonymised(docs: DataFrame, key: str | None = None, count: str = "pii_replaced") -> DataFrame:
    """docs with its text pseudonymised, and `count`, the number of values that were."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text, count = F.col("text"), fresh(docs, count)
    found, new = fresh(docs, "pii_found"), fresh(docs, "pii_new")
    hit = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = docs.withColumn(found, hit)
    # One pseudonym per value; null where the value stays.
    d = d.withColumn(new, F.transform(found, lambda m: pseudonym(key, m)))
    between = F.split(text, ANY, -1)
    filled = F.zip_with(between, F.zip_with(new, found, lambda n, o: F.coalesce(n, o)), lambda b, v: F.concat(b, F.coalesce(v, F.lit(""))))
    d = d.withColumn("text", F.when(F.size(found) > 0, F.array_join(filled, "")).otherwise(text))
    return d.withColumn(count, F.size(F.filter(new, lambda x: x.isNotNull())).cast("bigint")).drop(found, new)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
