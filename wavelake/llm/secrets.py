"""Secret scans: fixed patterns, and values in a credential context that are costly to guess.

The guess cost of a value is the least sum of log10 guesses over all ways to cut it into words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming from left to right. A value in a credential
context that costs at least ``least_cost`` is a secret; "password: summer2019" is not, a random token is.
"""

from __future__ import annotations

import bisect
import datetime
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Credential contexts beyond the base pattern: a keyword, which may go on as an identifier (password_hash, secretKey), then
#: a separator behind the identifier's end, and a value, before which an auth scheme may stand.
KEYWORD = re.compile(
    r"""((?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|(?:private|access|encryption|signing|[_-])[_-]?key|bearer))"""
    r"""(?=[_-]|(?<=[a-z])[A-Z]|\d|(?i:s)?(?:->|(?![A-Za-z0-9_-])))""",
    re.A,
)
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]*", re.A)
VALUE = re.compile(r"""["']?\s*(?:[:=]{1,2}>?|->|\sis\s)\s*["']?(?:(?i:bearer|basic|token)\s+["']?)?([^\s"'<>,;]{6,})""", re.A)
#: An auth scheme with no separator: the value is what follows, unless it's a plain word.
SCHEME = re.compile(r"""(?<![A-Za-z0-9])((?i:bearer|basic|token))\s+["']?([^\s"'<>,;]{6,})""", re.A)
PLAIN = re.compile(r"[^A-Za-z0-9]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[^A-Za-z0-9]+(?:[A-Z]?[a-z]+|[A-Z]+))*[^A-Za-z0-9]*")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "basic")

# Common words of passwords, most frequent first.
WORDS = """password secret admin welcome login letmein dragon master monkey shadow sunshine princess football baseball
superman batman iloveyou trustno hello freedom whatever love money summer winter spring autumn january february march
april june july august september october november december monday friday sunday test guest root user default change
changeme temp token example sample demo company server database system manager office computer internet service
public private key pass access super secure dallas london paris berlin madrid michael jennifer jordan thomas robert
charlie andrew daniel jessica ashley matthew george green black white blue red orange silver golden flower tiger lion
star angel happy lucky hunter soccer hockey ranger""".split()  # fmt: skip
# The rows of a keyboard, and orders that people type.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol")
STEPS = {a + b for row in WALKS for a, b in zip(row, row[1:])} | {b + a for row in WALKS for a, b in zip(row, row[1:])}
LEET = str.maketrans("0134@5$7!", "oieaassti")


def pool(ch: str) -> float:
    """log10 of the characters one must try for ch."""
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isascii() and ch.isalpha() else math.log10(33) if ch.isascii() else 3.0


def date_cost(digits: str) -> float | None:
    """log10 guesses of six or eight digits that are a date; None if they aren't."""
    for form in ("%Y%m%d", "%d%m%Y", "%m%d%Y") if len(digits) == 8 else ("%y%m%d", "%d%m%y", "%m%d%y"):
        try:
            year = datetime.datetime.strptime(digits, form).year
        except ValueError:
            continue
        if 1900 <= year <= 2099:
            return math.log10(366 * max(20, abs(year - 2025)))
    return None


def is_pattern(word: str) -> bool:
    """Whether a word is one repeat or one keyboard walk: those have costs of their own and are no dictionary words."""
    return len(set(word)) == 1 or all(word[i : i + 2] in STEPS for i in range(len(word) - 1))


class Dictionary:
    """Ranked words: the fixed ones first, then those given, by rank."""

    def __init__(self, more: list[str] = ()):
        words = list(dict.fromkeys(w for w in (*WORDS, *more) if len(w) >= 3 and not is_pattern(w)))
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        self.longest = max(map(len, words))

    def cost(self, value: str, low: str, plain: str) -> float | None:
        """log10 guesses of a piece of a value as one word; low and plain are the piece in lower case and without leet."""
        rank = self.rank.get(low) or self.rank.get(plain)
        if not rank:
            return None
        case = 0.0 if value.islower() else math.log10(2) if value.isupper() or value.istitle() else len(value) * math.log10(2)
        return math.log10(rank + 1) + case + (0.0 if low in self.rank else math.log10(4))


FIXED = Dictionary()


def guess_cost(value: str, words: Dictionary = FIXED) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs.

    A repeat or walk that ends here may start at any place of its stretch. But from the first cut inside a stretch, one
    repeat or walk to its end costs no more than what could stand before a later one (characters cost 10 guesses each,
    and lengths multiply where they'd add); and a segment that comes into the stretch from outside ends within the
    longest word. So only starts that far into a stretch are tried, and time grows in proportion to the length."""
    n = len(value)
    low = value.lower()
    low = low if len(low) == n else value  # a few letters change their length
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    reach = max(words.longest, 8)
    run = walk = 0  # where the stretches that hold the last character start
    for j in range(1, n + 1):
        here = best[j - 1] + pool(value[j - 1])  # brute force, a character more
        if j > 1 and value[j - 1] != value[j - 2]:
            run = j - 1
        if j > 1 and low[j - 2 : j] not in STEPS:
            walk = j - 1
        for i in range(run, min(j - 3, run + reach) + 1):
            here = min(here, best[i] + pool(value[j - 1]) + math.log10(j - i))
        for i in range(walk, min(j - 3, walk + reach) + 1):
            here = min(here, best[i] + math.log10(2 * 47 * (j - i)))
        for i in range(max(0, j - words.longest), j - 2):
            if (cost := words.cost(value[i:j], low[i:j], plain[i:j])) is not None:
                here = min(here, best[i] + cost)
        for k in (8, 6):
            if j >= k and (digits := value[j - k : j]).isdigit() and digits.isascii() and (cost := date_cost(digits)) is not None:
                here = min(here, best[j - k] + cost)
        if j >= 4 and (digits := value[j - 4 : j]).isdigit() and digits.isascii() and 1900 <= int(digits) <= 2099:
            here = min(here, best[j - 4] + math.log10(200))
        best[j] = here
    return best[n]


def contexts(text: str, accept) -> list[tuple[int, int]]:
    """Places of the values behind a keyword's identifier that accept() takes. All keywords of an identifier have the same
    value, so an identifier is looked at once, however many it holds. Behind a value that isn't taken, the search goes on
    at the identifier's end, as the value may hold a keyword of its own."""
    out, at = [], 0
    while m := KEYWORD.search(text, at):
        at = IDENTIFIER.match(text, m.end()).end()
        arrow = text[at - 1 : at + 1] == "->"  # its dash has the look of an identifier's
        found = VALUE.match(text, at - 1 if arrow else at)
        if found and accept(found[1]):
            out.append(found.span(1))
            at = found.end()
    return out


def costly(text: str, least_cost: float, words: Dictionary = FIXED) -> dict[tuple[int, int], float]:
    """Places and costs of the values in a credential context that cost enough, in time that grows with the text. Of a
    context and an auth scheme whose values overlap, the context counts."""
    out: dict[tuple[int, int], float] = {}

    costs: dict[str, float] = {}

    def enough(value: str) -> bool:
        if value not in costs:
            costs[value] = guess_cost(value, words)
        return costs[value] >= least_cost

    taken = contexts(text, enough)
    starts = [a for a, _ in taken]
    for span in taken:
        out[span] = round(costs[text[slice(*span)]], 3)
    at = 0
    while m := SCHEME.search(text, at):
        at = m.end(1)
        if PLAIN.fullmatch(m[2]) or not enough(m[2]):
            continue
        at = m.end()
        k = bisect.bisect_left(starts, m.end(2))  # values before this one start before the match ends; the last ends last
        if not (k and taken[k - 1][1] > m.start(2)):
            out[m.span(2)] = round(costs[m[2]], 3)
    return out


def spans_of(text: str | None, least_cost: float, words: Dictionary = FIXED) -> list[dict]:
    """All spans of a text, by start and kind; the base kinds first at equal starts."""
    text = text or ""
    found = [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [("guess", a, b, c) for (a, b), c in costly(text, least_cost, words).items()]
    order = {k: i for i, k in enumerate((*KINDS, "guess"))}
    found.sort(key=lambda s: (s[1], order[s[0]]))
    return [{"kind": k, "start": a, "end": b, "log10_guesses": c} for k, a, b, c in found]


def ranked_words(docs: DataFrame, most: int = 20_000) -> list[str]:
    """The words of 3 to 20 letters that most rows of docs hold, most frequent first, equal ones in order of the
    alphabet: at most ``most``, which is the size of a guesser's dictionary. All rows are counted."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0)))
    counted = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    return [r.w for r in counted.orderBy(F.desc("n"), "w").limit(most).collect()]


def find_secrets(docs: DataFrame, least_cost: float = 9.0, words: list[str] = ()) -> DataFrame:
    """docs with secrets: array<struct<kind, start, end, log10_guesses>>, offsets in code points, end exclusive. A
    column of that name is replaced, all others stay.

    Kinds assign, access and hex are fixed patterns over the whole text; guess is a value in a credential context
    of at least 10 ** least_cost guesses (just so many count). words: the guesser's dictionary beside the fixed words,
    by rank. Null and empty texts have none. Each row stands for itself, also where rows repeat."""
    dictionary = Dictionary(words)

    def start():
        return lambda texts: [[spans_of(t, least_cost, dictionary) for t in texts]]

    return map_texts(docs, [("secrets", "array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")], start)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
