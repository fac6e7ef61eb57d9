"""PII: validated numbers, dates and addresses become pseudonyms of the same format by a keyed permutation.

A value is read as an integer below the number of values of its format, permuted by a Feistel network with a
keyed hash as round function (walking along the cycle until the result is in the format again), and written back
in the places where the digits or letters stood. So a card number stays a valid card number and a date a date,
equal values stay equal in all documents and spellings, and whoever holds the key can undo it.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import itertools
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "date")
ROUNDS = 8

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)")
SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{9,14}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d]|[.-]\d)")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
DATE = re.compile(r"(?<![\d/.-])(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?![\d/-]|\.\d)")
#: The length of an IBAN by its country.
IBAN_LENGTH = {k[:2]: int(k[2:]) for k in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22
DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30
KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29
PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}  # fmt: skip
#: Letters and digits that are permuted as one number: half of its bits fit in one hash.
AT_ONCE = 160
YEARS = range(1900, 2100)
#: The days of each month beyond the twelfth, added up: those that no order of day and month mistakes for another.
LATE = list(itertools.accumulate((calendar.monthrange(y, m)[1] - 12 for y in YEARS for m in range(1, 13)), initial=0))


class Permutation:
    """Keyed permutations of range(size), one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _half(self, value: int, bits: int, r: int, tweak: bytes) -> int:
        data = b"%d:%d:" % (r, bits) + tweak + b":" + value.to_bytes((bits + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, (bits + 7) // 8 + 8)).digest(), "big") & ((1 << bits) - 1)

    def _once(self, value: int, bits: int, tweak: bytes, rounds) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for r in rounds:
            left, right = right, left ^ self._half(right, bits, r, tweak)
        return left << bits | right

    def _walk(self, value: int, size: int, tweak: bytes, back: bool) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            if back:  # the same network with halves swapped and rounds reversed
                value = self._once((value & mask) << bits | value >> bits, bits, tweak, range(ROUNDS - 1, -1, -1))
                value = (value & mask) << bits | value >> bits
            else:
                value = self._once(value, bits, tweak, range(ROUNDS))
            if value < size:
                return value

    def apply(self, value: int, size: int, tweak: bytes) -> int:
        return self._walk(value, size, tweak, False)

    def undo(self, value: int, size: int, tweak: bytes) -> int:
        return self._walk(value, size, tweak, True)


def luhn_digit(digits: str) -> int:
    """The check digit that follows digits."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def into(pattern: str, characters: str, where: str) -> str:
    """pattern with the characters in the places of those for which where is true, in order."""
    it = iter(characters)
    return "".join(next(it) if c in where else c for c in pattern)


DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Pseudonyms:
    """The pseudonym of a value of each kind; undo=True gives the value back."""

    def __init__(self, key: bytes, undo: bool = False):
        p = Permutation(key)
        self.move = p.undo if undo else p.apply

    def digits(self, digits: str, tweak: bytes) -> str:
        return str(self.move(int(digits), 10 ** len(digits), tweak + b"%d" % len(digits))).zfill(len(digits)) if digits else ""

    def letters(self, text: str, tweak: bytes) -> str:
        """Each letter and digit by another of its class; all others stay."""
        if len(text) > AT_ONCE:
            return "".join(self.letters(text[i : i + AT_ONCE], tweak + b"%d:" % i) for i in range(0, len(text), AT_ONCE))
        value, size, classes = 0, 1, []
        for c in text:
            if own := next((k for k in (DIGITS, LOW, UP) if c in k), None):
                value, size = value * len(own) + own.index(c), size * len(own)
            classes.append(own)
        value = self.move(value, size, tweak + b"".join(b"." if k is None else b"%d" % (k == DIGITS) for k in classes))
        out = []
        for c, own in zip(reversed(text), reversed(classes)):
            if own:
                value, k = divmod(value, len(own))
                c = own[k]
            out.append(c)
        return "".join(reversed(out))

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        if sum(c.isalnum() for c in local) >= 4:
            return f"{self.letters(local, b'email')}@{domain}"
        head, dot, top = domain.rpartition(".")
        return self.letters(f"{local}@{head}", b"email") + dot + top

    def card(self, text: str) -> str:
        own = re.sub(r"\D", "", text)
        head = self.digits(own[:-1], b"card")
        return into(text, head + str(luhn_digit(head)), DIGITS)

    def iban(self, text: str) -> str:
        own = text.replace(" ", "")
        body = into(own[4:], self.digits("".join(c for c in own[4:] if c in DIGITS), b"iban" + own[:2].encode()), DIGITS)
        check = 98 - iban_number(own[:2] + "00" + body) % 97
        new = iter(f"{own[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def ssn(self, text: str) -> str:
        value = text
        while True:
            value = into(text, self.digits(value.replace("-", ""), b"ssn"), DIGITS)
            if SSN.fullmatch(value):
                return value

    def phone(self, text: str) -> str:
        lead = re.match(r"\+(?:1|7|\d{1,3}(?=[ .(-])|\d\d)", text)
        code = lead[0] if lead else ""
        rest = text[len(code) :]
        return code + into(rest, self.digits("".join(c for c in rest if c in DIGITS), b"phone" + code.encode()), DIGITS)

    def ip(self, text: str) -> str:
        value = 0
        for part in text.split("."):
            value = value << 8 | int(part)
        value = self.move(value, 1 << 32, b"ip")
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def date(self, text: str) -> str:
        """A day up to the twelfth goes to another such day and a later one to a later one, in every format alike: so a
        date has one pseudonym, and one that is written month first is still read so."""
        day, (order, sep, padded) = read_date(text)
        month = (day.year - YEARS[0]) * 12 + day.month - 1
        if day.day <= 12:
            month, d = divmod(self.move(month * 12 + day.day - 1, len(YEARS) * 144, b"early"), 12)
        else:
            at = self.move(LATE[month] + day.day - 13, LATE[-1], b"late")
            month = bisect_right(LATE, at) - 1
            d = at - LATE[month] + 12
        new = {"y": f"{YEARS[0] + month // 12:04d}", "month": month % 12 + 1, "day": d + 1}
        return sep.join(new[k] if k == "y" else f"{new[k]:02d}" if padded else str(new[k]) for k in order)


def read_date(text: str) -> tuple[datetime.date, tuple] | None:
    """The date and its format: order of parts, separator, whether padded. Day before month, unless that is no date."""
    m = DATE.fullmatch(text)
    if not m:
        return None
    if m[1]:
        tries, sep, padded = [(m[1], m[3], m[4], ("y", "month", "day"))], m[2], len(m[3]) == len(m[4]) == 2
    else:
        tries, sep, padded = [(m[8], m[7], m[5], ("day", "month", "y")), (m[8], m[5], m[7], ("month", "day", "y"))], m[6], len(m[5]) == len(m[7]) == 2
    for y, mo, d, order in tries:
        try:
            day = datetime.date(int(y), int(mo), int(d))
        except ValueError:
            continue
        if day.year in YEARS:
            return day, (order, sep, padded)
    return None


def ibans(text: str):
    """(start, end) of the valid IBANs. What follows one may look like more groups of it, so it ends at the length of
    its country; with an unknown code, at the end of the match. Behind one that isn't valid, the search goes on at the
    next character, as the match may hold the start of another."""
    at = 0
    while m := IBAN.search(text, at):
        own = IBAN_LENGTH.get(m[0][:2], len(m[0].replace(" ", "")))
        end, n = m.start(), 0
        while n < own and end < m.end():
            n += text[end] != " "
            end += 1
        at = m.start() + 1
        if n == own and 15 <= n <= 34 and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and iban_number(text[m.start() : end].replace(" ", "")) % 97 == 1:
            yield m.start(), end
            at = end


def find_pii(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the validated values, leftmost first and not overlapping; earlier kinds win."""
    found = []
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
    if re.search(r"\d", text):
        found += [("iban", a, b) for a, b in ibans(text)]
        found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if luhn_digit((own := re.sub(r"\D", "", m[0]))[:-1]) == int(own[-1])]
        found += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text)]
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 7 <= sum(c in DIGITS for c in m[0]) <= 15]
        found += [("date", m.start(), m.end()) for m in DATE.finditer(text) if read_date(m[0])]
    out: list[tuple[int, int, str]] = []
    for _, own in itertools.groupby(found, key=lambda s: s[0]):  # in the order of KINDS, each by its places
        out = merged(out, own)
    return [(kind, a, b) for a, b, kind in out]


def merged(taken: list[tuple[int, int, str]], own) -> list[tuple[int, int, str]]:
    """taken with those of own (kind, start, end) that overlap nothing, by start: one sweep over both."""
    out, i, last = [], 0, 0
    for kind, a, b in own:
        while i < len(taken) and taken[i][0] < b:
            last = max(last, taken[i][1])
            out.append(taken[i])
            i += 1
        if a >= last:
            at = len(out)  # what was taken and starts before b ends before a
            out.insert(at, (a, b, kind))
            last = b
    return out + taken[i:]


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """docs with the personal values in text replaced by pseudonyms, and pii: array<struct<kind, start, end>> of
    their places in the old text (code points, end exclusive). All other columns stay.

    Null stays null and empty stays empty, with no places. Equal values of a kind get equal pseudonyms in all rows
    of all tables with the same key. undo: the way back, from pseudonyms to values."""

    def start():
        names = Pseudonyms(key.encode(), undo)

        def compute(texts):
            new, places = [], []
            for t in texts:
                found = find_pii(t) if t else []
                parts, last = [], 0
                for kind, a, b in found:
                    parts += [t[last:a], getattr(names, kind)(t[a:b])]
                    last = b
                new.append("".join([*parts, t[last:]]) if found else t)
                places.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            return [new, places]

        return compute

    return map_texts(docs, [("text", "string"), ("pii", "array<struct<kind:string,start:bigint,end:bigint>>")], start)
