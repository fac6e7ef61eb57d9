import random

import pytest
from pyspark.sql import functions as F

from wavelake.llm import near_dedup


def brute(rows, percent):
    """Components by comparing all pairs of shingle sets of word tuples."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return {(d, len(sets[i]), low[top(i)]) for i, (d, _) in enumerate(rows)}


def star_group(n, seed=3):
    """A text and copies of it, each with its own edits: many are linked only through the original."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(150)] = f"e{i}x{r.randrange(1000)}"
        rows.append((501 + i if i % 2 else i, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, percent):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(10_000 + d, t) for d, t in table] + star_group(60)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b", 5), (4, "A\tb", 6), (5, " \n ", 6), (6, "a b c", 7), (7, "word " * 20000, 7), (7, "word " * 20000, 7), (None, "a b", 8), (None, "lone text", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, 3, False), (None, 1, None, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 7, None], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_sketch_fills_every_bin_and_estimates():
    import numpy as np

    from wavelake.llm.shingles import fast_sketch

    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = np.sort(x[:900]), np.sort(x[100:])
    s = fast_sketch(np.concatenate([a, b, x[:1]]), np.repeat([0, 1, 2], [900, 900, 1]), 3, 100)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


@pytest.mark.parametrize("percent", [80, 85])
def test_hidden_pairs_match_brute_force(spark, monkeypatch, percent):
    """Every similar pair of different labels is found once, with one label on most sets and shingles cut into slices."""
    monkeypatch.setattr(near_dedup, "PAIRS_A_SLICE", 3)
    r = random.Random(percent)
    base = r.sample(range(10**6), 40)
    sets = {}
    for i in range(50):
        own = set(base[: r.randrange(28, 41)])
        own = own - set(r.sample(sorted(own), r.randrange(4))) | {10**6 + 100 * i + k for k in range(r.randrange(4))}
        sets[i] = (sorted(own), "main" if i % 3 else f"l{i % 5}")
    key = {i: b"%03d" % i for i in sets}
    table = spark.createDataFrame([(key[i], s) for i, (s, _) in sets.items()], "digest binary, shingles array<bigint>")
    labels = spark.createDataFrame([(key[i], label.encode()) for i, (_, label) in sets.items()], "digest binary, label binary")
    got = [(bytes(p.a), bytes(p.b)) for p in near_dedup._hidden_pairs(table, labels, percent).collect()]

    def similar(x, y):
        common = len(set(x) & set(y))
        return 100 * common >= percent * (len(x) + len(y) - common)

    want = {(key[i], key[j]) for i in sets for j in sets if i < j and sets[i][1] != sets[j][1] and similar(sets[i][0], sets[j][0])}
    assert len(want) > 20 and len(got) == len(set(got)) and want <= set(got)
    of = {key[i]: label for i, (_, label) in sets.items()}
    assert all(of[a] != of[b] for a, b in got)
