"""Credential contexts in one pass: the places that one pattern over the whole text gives, in time that grows with it."""

import random
import re
import time

from wavelake.llm import secrets

#: Keyword, identifier, separator and value as one pattern, searched anew at the end of each keyword.
CONTEXT = re.compile(
    r"""((?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|(?:private|access|encryption|signing|[_-])[_-]?key|bearer))"""
    r"""(?:[_-][A-Za-z0-9_-]*|(?:(?<=[a-z])[A-Z]|\d)[A-Za-z0-9_-]*|(?i:s))?["']?\s*(?:[:=]{1,2}>?|->|\sis\s)\s*["']?(?:(?i:bearer|basic|token)\s+["']?)?([^\s"'<>,;]{6,})""",
    re.A,
)


def slow(text, accept):
    out, at = [], 0
    while m := CONTEXT.search(text, at):
        at = m.end(1)
        if accept(m[2]):
            at = m.end()
            out.append(m.span(2))
    return out


def test_same_places_as_one_pattern(spark):
    r = random.Random(11)
    parts = ["token", "Token", "password", "pass", "secret", "api_key", "API-KEY", "_key", "auth", "bearer", "x", "s", "S", "A", "9", "-", "_", "->", ":", "=", "==>", " is ", " ", "\n", '"', "'", "abc123", "hunter2hunter", "Zq9!kd", ",", "é", "credentials", "private-key"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(6000)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if x.text]
    found = 0
    for accept in (lambda v: True, lambda v: len(v) > 9, lambda v: "9" in v):
        for t in texts:
            want = slow(t, accept)
            assert secrets.contexts(t, accept) == want, t
            found += len(want)
    assert found > 1000


def test_a_megabyte_of_keywords_or_secrets_takes_seconds():
    r = random.Random(2)
    value = lambda: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789!%") for _ in range(16))
    texts = ["token-" * 170_000, "token_" * 170_000 + ": x", "password " * 110_000, "secret=" * 140_000, "key" * 330_000, "token" + " " * 1_000_000 + "x"]
    for t in texts:
        began = time.process_time()
        secrets.spans_of(t, 10.0)
        assert time.process_time() - began < 60
    many = "".join(f"password = {value()}\nbearer {value()}\n" for _ in range(18_000))
    began = time.process_time()
    found = [s for s in secrets.spans_of(many, 10.0) if s["kind"] == "guess"]
    assert 35_900 < len(found) <= 36_000  # a few values behind "bearer" look like plain words
    assert time.process_time() - began < 90
