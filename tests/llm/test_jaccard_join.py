import random

import numpy as np
import pytest

from wavelake.llm import jaccard_join

from .test_near_dedup import star_group


def brute(rows, percent, width=4):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
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
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), low[top(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, percent, more=""):
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, digest binary, n int")
    return sorted((tuple(r) for r in jaccard_join.similar_texts(docs, percent).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_same_as_all_pairs(spark, percent):
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(10_000 + d, t) for d, t in table] + star_group(60)
    assert found(spark, rows, percent) == brute(rows, percent)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_chains_with_hot_slices(spark, monkeypatch, percent):
    """Chains of edits, whose ends are not similar, in small slices; every shingle counts as hot."""
    for name, value in (("HOT", 3), ("SLICE", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(percent)
    rows = []
    for g in range(4):
        w = [f"g{g}w{r.randrange(10**6)}" for _ in range(r.randrange(6, 80))]
        for _ in range(25):
            w = list(w)
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, "one common line of words " * r.randrange(1, 4) + "x" * (i % 3)) for i in range(30)]
    assert found(spark, rows, percent) == brute(rows, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A\tb"), (5, " \n "), (6, "a b c"), (7, "word " * 20000), (7, "word " * 20000), (None, "a b"), (None, "lone text"), (8, "word word word word"), (None, "lone other"), (9, "ü Ü ü Ü ü"), (10, "ü Ü ü Ü ü")]
    assert found(spark, rows, 85) == brute(rows, 85)
    assert found(spark, [], 85) == []


def test_prefixes_of_similar_sets_share_enough():
    """For any order and any l, two sets above the similarity share the smaller l within their prefixes."""
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, jaccard_join.BUCKETS)
    for _ in range(60):
        n = int(r.integers(1, 60))
        base = r.integers(0, 2**63, n + 12, dtype=np.uint64)
        a, b = base[: n + int(r.integers(0, 3))], np.concatenate([base[int(r.integers(0, 3)) : n], base[n + 4 : n + 4 + int(r.integers(0, 3))]])
        both = len(np.intersect1d(a, b))
        for percent in (50, 80, 85):
            if len(b) == 0 or 100 * both < percent * (len(a) + len(b) - both):
                continue
            x, owner = np.concatenate([np.unique(a), np.unique(b)]), np.repeat([0, 1], [len(a), len(b)])
            t, of, at, wanted = jaccard_join.prefixes(x, owner, 2, percent, counts)
            assert len(np.intersect1d(t[of == 0], t[of == 1])) >= min(wanted)
            spare = int(min(wanted)) - -(-(len(a) + len(b)) * percent // (100 + percent))
            early = [t[(of == k) & (at < n + spare)] for k, n in ((0, len(a)), (1, len(b)))]
            assert len(np.intersect1d(*early)) >= min(wanted)


def test_longer_prefixes_where_many_would_be_compared():
    need, n = np.array([80, 80, 2]), np.array([100, 100, 2])
    dear = np.array([[1000.0, 1010, 1020, 1030], [1.0, 900, 2000, 4000], [1000.0, 1010, 1020, 1030]])
    assert list(jaccard_join.matches_wanted(need, dear, n)) == [4, 1, 2]


@pytest.mark.parametrize("heavy", [2, 200])
def test_sets_that_share_few_heavy_shingles_do_not_meet(spark, monkeypatch, heavy):
    """Of 60 sets of one component and 30 outsiders, most share three heavy shingles of the four they need. The pairs are
    those that share enough in all, whatever counts as heavy; where these are, the others make no row."""
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    rows, has = [], {}
    for k in range(90):
        own = [0, 1, 2] + ([3] if k % 30 == 7 else []) + ([100 + k % 3] if k % 10 == 4 else []) + ([200 + k % 2] if k % 30 in (4, 5) else [])
        key, label = k.to_bytes(2, "big"), b"main" if k < 60 else k.to_bytes(2, "big")
        has[key] = label, set(own)
        rows += [(t, key, 100, 4, at, label) for at, t in enumerate(sorted(own, reverse=True))]
    all_ = spark.createDataFrame(rows, "t bigint, digest binary, n bigint, l bigint, at int, label binary")
    open_, labels = all_.drop("label"), all_.select("digest", "label").where("label = X'6D61696E'").distinct()
    rows_made, meet = [], jaccard_join.meetings

    def counted(*args):
        met = meet(*args)
        rows_made.append(met.count())
        return met

    monkeypatch.setattr(jaccard_join, "meetings", counted)
    got = {(bytes(r.a), bytes(r.b)) for r in jaccard_join.crossing_pairs(open_, labels, 85).collect()}
    want = {(a, b) for a in has for b in has if a < b and has[a][0] != has[b][0] and len(has[a][1] & has[b][1]) >= 4}
    assert got == want and want
    if heavy == 2:
        assert sum(rows_made) < 300
    else:
        assert sum(rows_made) > 3 * 60 * 30
