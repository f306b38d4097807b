"""Pseudonyms one value at a time in plain Python, written from the description of the formats."""

import datetime
import hashlib
import re

from siltstone.llm import pii

MATCH = re.compile(pii.ANY)
DAY0 = datetime.date(1800, 1, 1)


def keyed(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def feistel(key, l, r, a, b, *tweak):
    for i in range(1, 9):
        if i % 2:
            r = (r + keyed(key, *tweak, i, l) % b) % b
        else:
            l = (l + keyed(key, *tweak, i, r) % a) % a
    return l, r


def digits(key, d, tweak):
    n = len(d)
    if n < 2:
        return d
    h = n // 2
    l, r = feistel(key, int(d[:h]), int(d[h:]), 10**h, 10 ** (n - h), tweak, n)
    return f"{l:0{h}d}{r:0{n - h}d}"


def refill(shape, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10


def day(key, y, m, d):
    try:
        n = (datetime.date(int(y), int(m), int(d)) - DAY0).days
    except ValueError:
        return None
    if not 0 <= n < 189 * 773:
        return None
    l, r = feistel(key, n // 773, n % 773, 189, 773, "date")
    return DAY0 + datetime.timedelta(l * 773 + r)


def pseudonym(key, m):
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        h = hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()
        return f"u{h[:15]}@d{h[16:23]}.example"
    if re.fullmatch("AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{32}", m):
        h = hashlib.sha256(f"{key}|secret|{m}".encode()).hexdigest()
        return "AKIA" + h[:16].upper() if m.startswith("AKIA") else h[: len(m)]
    if m[0].isalpha():
        mod = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if mod(m[4:] + m[:4]) != 1:
            return None
        body = refill(m[4:], digits(key, re.sub("[^0-9]", "", m[4:]), "iban"))
        return f"{m[:2]}{98 - mod(body + m[:2] + '00'):02d}{body}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        x = day(key, *m.split("-"))
        return x and x.strftime("%Y-%m-%d")
    if re.fullmatch(r"\d\d\.\d\d\.\d{4}", m):
        x = day(key, m[6:], m[3:5], m[:2])
        return x and x.strftime("%d.%m.%Y")
    if "/" in m:
        a, b, y = m.split("/")
        try:
            datetime.date(int(y), int(a), int(b))
            x = day(key, y, a, b)
            return x and x.strftime("%m/%d/%Y")
        except ValueError:
            x = day(key, y, b, a)
            while x and x.day <= 12:
                x = day(key, x.year, x.month, x.day)
            return x and x.strftime("%d/%m/%Y")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        p = [int(x) for x in m.split(".")]
        l, r = feistel(key, p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        l, r = feistel(key, (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        a = l // 99 + 1
        return f"{a + (a >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if re.fullmatch(r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}", m):
        n = d[-10:]
        l, r = feistel(key, (int(n[:3]) - 200) * 100 + int(n[6:8]), (int(n[3:6]) - 200) * 100 + int(n[8:]), 80_000, 80_000, "phone")
        return refill(m, d[:-10] + f"{l // 100 + 200:03d}{r // 100 + 200:03d}{l % 100:02d}{r % 100:02d}")
    if m[0] == "+":
        one = 1 if d[0] in "17" else 2 if d[:2] in pii.CALLING_CODES.split("|") else 3
        return refill(m, d[:one] + digits(key, d[one:], "abroad"))
    if luhn(d):
        return None
    body = digits(key, d[:-1], "card")
    return refill(m, body + str(-luhn(body + "0") % 10))


def pseudonymised(text, key=pii.KEY):
    """(text, values replaced)."""
    if text is None:
        return None, 0
    n = 0

    def put(m):
        nonlocal n
        new = pseudonym(key, m[0])
        n += new is not None
        return m[0] if new is None else new

    return MATCH.sub(put, text), n
