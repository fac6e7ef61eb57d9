import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, dist string, score int, pivot int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """Every anchor against every row, in Python's whole numbers."""
    own = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in own:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in own if j != i)
        hard = [(s, j) for s, j, z in sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in own) if z != y]
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fits = [(-t, k) for t, k in hard if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(dim)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_same_as_all_products(spark, monkeypatch, spread):
    """Small blocks, so that several rounds of several blocks are needed; few dimensions, so that bounds do cut."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rows = vectors(600, 4, int(spread * 10), spread)
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, positives=2, negatives=3, low=50, high=99) == brute(rows, lambda i: i % 10 == 0, 2, 3, 50, 99)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 3, 1)
    rows += [(50, None, 1), (60, [1.0, None, 0.5], 1), (70, [nan, 0.0, 0.0], 1), (80, [1.0, -inf, 0.0], 2), (90, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (100, [1.0], 1), (110, [], 2)]
    rows += [rows[0], rows[7], (20, [0.5, 0.5, 0.5], 0), (120, [0.0, 0.0, 0.0], 1), (121, [0.0, 0.0, 0.0], 2), (122, [0.0, 0.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_ties_and_one_vector_of_many(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(200)] + [(200 + i, [0.25, 0.25], 1 - i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rows = [(i, [1e5 * (i % 13) + i, 3e5 * (i % 7)], i % 3) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_anchorless(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == []
    assert found(spark, [(10, [1.0, 2.0], 1)]) == []


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """Far clusters of few dimensions: most pairs of blocks are certified away, not scanned."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    r = random.Random(5)
    rows = [(i, [float(np.float32(20 * math.cos(i % 12) + r.random())), float(np.float32(20 * math.sin(i % 12) + r.random()))], r.randrange(3)) for i in range(1200)]
    seen = []
    real = hard_negatives._scanned
    counts = spark.sparkContext.accumulator(0)

    def counting(*a):
        run = real(*a)

        def each(batches):
            for b in batches:
                counts.add(b.num_rows)
                yield from run(iter([b]))

        seen.append(1)
        return each

    monkeypatch.setattr(hard_negatives, "_scanned", counting)
    assert found(spark, rows, low=95, high=100) == brute(rows, lambda i: i % 10 == 0, low=95, high=100)
    assert counts.value < 0.6 * 2 * (120 / 8) * (1200 / 20)
