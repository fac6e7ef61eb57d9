import datetime
import random
import re
import time

from wavelake.llm import pii, queries

VALUES = {
    "phone": ["+1 (743) 555-3824", "415-555-2671", "+14155552671", "+44 20 7946 0958"],
    "email": ["thon.54@mail3.example.com", "a@b.com"],
    "card": ["4465758382889437", "4465 7583 8288 9437"],
    "ip": ["172.242.194.228", "2.195.74.112"],
    "date": ["2021-03-04", "31/12/1999", "12/31/1999"],
    "ssn": ["078-05-1120"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
}


def test_values_stay_in_format_and_come_back():
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for kind, values in VALUES.items():
        for v in values:
            assert pii.find_pii(f"x {v} y") == [(kind, 2, 2 + len(v))]
            new = getattr(there, kind)(v)
            assert new != v and getattr(back, kind)(new) == v
            assert [k for k, a, b in pii.find_pii(new)] == [kind]


def test_invalid_numbers_are_left_alone():
    for v in ["4785380592391138", "300.1.1.1", "2021-02-30", "666-05-1120", "GB82 WEST 1234 5698 7654 33", "version 1.2.3", "year 2021"]:
        assert pii.find_pii(v) == []


def test_permutation_is_one():
    p = pii.Permutation(b"key")
    for size in (1, 2, 10, 100, 731):
        assert sorted(p.apply(i, size, b"t") for i in range(size)) == list(range(size))
        assert all(p.undo(p.apply(i, size, b"t"), size, b"t") == i for i in range(size))
    r = random.Random(1)
    for _ in range(50):
        size = r.randrange(2, 10**30)
        v = r.randrange(size)
        assert p.undo(p.apply(v, size, b"t"), size, b"t") == v


def test_documents(spark):
    text = "call +1 (743) 555-3824 or 4465 7583 8288 9437 now, mail thon.54@mail3.example.com"
    rows = [(1, text, "a"), (1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "4465758382889437 " * 5000, "d"), (None, "on 2021-03-04", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = pii.pseudonymise(docs, "k")
    got = out.orderBy("doc_id").collect()
    assert set(out.columns) == {"doc_id", "text", "pii"} and len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[2].text is None and by[2].pii == [] and by[3].text == ""
    assert len(by[4].pii) == 5000 and len(set(by[4].text.split())) == 1
    card = by[4].text.split()[0]
    assert card[:4] + " " + card[4:8] + " " + card[8:12] + " " + card[12:] in by[1].text  # linked across spellings
    for value in ("555-3824", "8288 9437", "thon.54"):
        assert value not in by[1].text
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, "k", undo=True).collect()}
    assert back[1] == text and back[4] == rows[4][1]


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_ibans_before_capitals_and_digits():
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    values = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "GB82 WEST 1234 5698 7654 32"]
    for v in values:
        for before in ("", "x ", "NO12 "):
            for after in ("", " BIC", " EUR", " 2024", " BANK CODE", " 12 EUR", " EUROPE", "."):
                text = before + v + after
                a = len(before)
                assert [(s, e) for s, e in pii.ibans(text)] == [(a, a + len(v))]
                new = before + there.iban(v) + after
                assert v not in new and list(pii.ibans(new)) == [(a, a + len(v))] and back.iban(there.iban(v)) == v
    assert list(pii.ibans(" ".join(values))) and len(list(pii.ibans(" ".join(values)))) == len(values)


def test_long_local_parts():
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for n in (160, 161, 400, 5000):
        v = "secretname" * (n // 10) + "a" * (n % 10) + "@example.com"
        assert pii.find_pii("to " + v) == [("email", 3, 3 + len(v))]
        new = there.email(v)
        assert back.email(new) == v and not any(v[i : i + 10] == new[i : i + 10] for i in range(0, n - 9, 10))


def slow_finder(text):
    """Every kind in order; a match counts if it overlaps nothing that counts."""
    by_kind = []
    for kind in pii.KINDS:
        whole = [s for s in CANDIDATES[kind](text)]
        by_kind += [(kind, a, b) for a, b in whole]
    out = []
    for kind, a, b in by_kind:
        if all(b <= c or d <= a for _, c, d in out):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: s[1])


def emails(text):
    for m in pii.DOMAIN.finditer(text):
        a = m.start()
        while a and text[a - 1] in pii.LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()


def digits_of(text):
    return re.sub(r"\D", "", text)


CANDIDATES = {
    "email": emails,
    "iban": pii.ibans,
    "card": lambda t: [m.span() for m in pii.CARD.finditer(t) if sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits_of(m[0])))) % 10 == 0],
    "ssn": lambda t: [m.span() for m in pii.SSN.finditer(t)],
    "ip": lambda t: [m.span() for m in pii.IP.finditer(t)],
    "phone": lambda t: [m.span() for m in pii.PHONE.finditer(t) if 7 <= len(digits_of(m[0])) <= 15],
    "date": lambda t: [m.span() for m in pii.DATE.finditer(t) if pii.read_date(m[0])],
}


def test_query_matches_plain_python(spark):
    """Each text of the table: values found by trying every match against all others, and replaced one by one."""
    got = {r.doc_id: r for r in queries.op7_pii(spark, "/root/testdata/sf0.001").collect()}
    names = pii.Pseudonyms(queries.PII_KEY.encode())
    docs = queries.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        found = slow_finder(r.text) if r.text else []
        text = r.text
        for kind, a, b in reversed(found):
            text = text[:a] + getattr(names, kind)(text[a:b]) + text[b:]
        assert got[r.doc_id].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in found) and got[r.doc_id].text == text


def test_finder_matches_the_slow_one_on_mixed_texts():
    r = random.Random(8)
    parts = [v for vs in VALUES.values() for v in vs] + ["@", "@c.com", ".", "-", " ", " ", "12", "2021-01-01-02", "555-", "a.b@c.de@f.gh", "/"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert pii.find_pii(text) == slow_finder(text), text


def test_a_long_text_takes_seconds():
    text = "".join(f"u{i}@ex.org 10.0.{i % 250}.7 " for i in range(40_000))
    began = time.perf_counter()
    assert len(pii.find_pii(text)) == 80_000
    assert time.perf_counter() - began < 10


def test_a_date_has_one_pseudonym_in_every_form():
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    day, seen = datetime.date(1900, 1, 1), set()
    while day.year < 2100:
        y, m, d = day.year, day.month, day.day
        forms = [f"{y:04d}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y:04d}", f"{d}.{m}.{y}"] + ([f"{m:02d}/{d:02d}/{y:04d}"] if d > 12 else [])
        new = {pii.read_date(there.date(f))[0] for f in forms}
        assert len(new) == 1, forms
        assert all(pii.read_date(back.date(there.date(f)))[0] == day for f in forms)
        seen |= new
        day += datetime.timedelta(days=17)
    assert len(seen) == -(-(datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days // 17)
