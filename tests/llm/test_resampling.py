import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from wavelake.llm import resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


def brute(rows, target, percent=25, least_words=20, seed=7, buckets=10_000):
    """(doc_id, n_features, weight, score) of each row and the ids drawn in order, feature by feature."""
    each = [features(t) for _, t in rows]
    s = Counter(bucket(f, buckets) for _, fs in each for f in fs)
    t = Counter(bucket(f, buckets) for text in target for f in features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + buckets) / ((s[b] + 1.0) * (nt + buckets)))) for b in s}
    out = []
    for (d, _), (n, fs) in zip(rows, each):
        weight = sum(gain[bucket(f, buckets)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least_words))
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, [r[0] for r in ranked[: percent * len(ranked) // 100]]


def check(spark, rows, target, **options):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, weight int, row string")
    items = spark.createDataFrame([(i, t, 7) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resample(docs, items, **options).collect()
    want, drawn = brute(rows, target, **options)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))
    kept = resampling.drawn(docs, items, **options)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=key) == sorted(drawn, key=key)


def test_same_as_feature_by_feature(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect()]
    check(spark, rows, target)
    check(spark, rows, target, percent=60, least_words=200, seed=3, buckets=97)


def test_odd_rows(spark):
    long = "w" * 200 + " " + "x" * 64 + " " + "y" * 63 + " É" * 30
    rows = [(1, None), (2, ""), (3, "..."), (4, "One"), (5, "a\x00b\x7fC_d-e9 " * 9), (6, long), (7, "ab " * 20_000), (8, "same words " * 12), (8, "same words " * 12), (8, "same words " * 12), (None, "no id here " * 9), (None, None), (9, "ſ İ   x " * 8)]
    rows += [(20 + i, f"text number {i} of twenty words or more " * 3) for i in range(40)]
    for percent in (0, 10, 50, 99, 100):
        check(spark, rows, ["same words in the target", None, ""], percent=percent)
    check(spark, rows, [])


def test_empty_table(spark):
    check(spark, [], ["a b c"])


@pytest.mark.parametrize("text", ["", "a", "a b", "b " * 100, "x" * 500 + " " + "y" * 500 + " é" * 3])
def test_joined_checksums(text):
    import numpy as np

    n, indptr, b, count = resampling.counted([text, None, text], resampling.WordCrcs(), resampling.Shifts(), 1000)
    want = Counter(bucket(f, 1000) for f in features(text)[1])
    assert dict(zip(b[: indptr[1]].tolist(), count[: indptr[1]].tolist())) == want == dict(zip(b[indptr[2] :].tolist(), count[indptr[2] :].tolist()))
    assert n.tolist() == [features(text)[0], 0, features(text)[0]] and np.all(np.diff(indptr) >= 0)
