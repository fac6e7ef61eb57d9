"""Signals, the hearing scale, excess frames and observable step entries against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wavelake.functions import signals
from wavelake.functions.lookups import IMA_MOVES
from wavelake.operators import adpcm


def test_signals(spark):
    for kind in signals.KINDS:
        rows = signals.signals(spark, kind, 400, 8000, channels=2).orderBy("frame", "ch").collect()
        assert [(r.frame, r.ch) for r in rows] == [(f, c) for f in range(400) for c in (0, 1)]
        assert all(abs(r.v) <= 1.05 for r in rows)
        again = signals.signals(spark, kind, 400, 8000, channels=2).repartition(3).orderBy("frame", "ch").collect()
        assert rows == again
    get = lambda kind: [r.v for r in signals.signals(spark, kind, 400, 8000).orderBy("frame").collect()]
    assert set(get("silence")) == {0.0} and set(get("square")) == {-0.7, 0.7}
    assert all(math.isclose(v, 2 * (k / 8000 * 20 % 1) - 1, abs_tol=1e-9) for k, v in enumerate(get("ramp")))
    assert all(math.isclose(v, 0.6 * math.sin(2 * math.pi * 440 * k / 8000) + 0.25 * math.sin(2 * math.pi * 660 * k / 8000), abs_tol=1e-9) for k, v in enumerate(get("tone")))
    assert all((v * 32768) % 256 == 0 for v in get("wasted"))
    assert abs(sum(get("noise"))) / 400 < 0.2 and max(map(abs, get("tiny"))) <= 0.004
    assert signals.signals(spark, "tone", 0, 8000).count() == 0
    with pytest.raises(ValueError):
        signals.signal("other", F.lit(0), F.lit(0), 8000)


def test_hearing_scale(spark):
    got = spark.range(1).select(signals.erb_centres(32, F.lit(50.0), F.lit(16000.0)).alias("c"), signals.erb(F.lit(1000.0)).alias("e")).first()
    place = [21.4 * math.log10(0.00437 * f + 1) for f in got.c]
    steps = [b - a for a, b in zip(place, place[1:])]
    assert len(got.c) == 32 and math.isclose(got.c[0], 50) and math.isclose(got.c[-1], 16000)
    assert max(steps) - min(steps) < 1e-9 and math.isclose(got.e, 24.7 * 5.37)


def test_excess(spark):
    rows = [("pcm", 0, 1, "OK"), ("pcm", 3, 64, "NO_PADDING"), ("ima-wav", -1, 64, "FEWER"), ("ima-wav", 63, 64, "OK"), ("ima-wav", 64, 64, "BLOCK"), ("new", 1, None, "BLOCK"), ("pcm", None, 1, None)]
    df = spark.createDataFrame(rows, "coding string, more long, frames long, want string")
    assert all(r.got == r.want for r in df.select("want", signals.excess(F.col("coding"), F.col("more"), F.col("frames")).alias("got")).collect())


def test_observable_entries(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(89), [r.randrange(16) for _ in range(n)]) for k, n in enumerate((0, 1, 5, 64, 64, 200))] + [(9, 3, [0, 8]), (10, 3, None)]
    df = spark.createDataFrame(rows, "k int, i int, nibbles array<int>")
    got = {x.k: x.e for x in df.select("k", adpcm.observable_entries(F.col("nibbles"), F.col("i")).alias("e")).collect()}
    for k, i, nibbles in rows:
        want = set()
        for n in nibbles or []:
            want |= {i} if n & 7 else set()
            i = max(0, min(88, i + IMA_MOVES[n & 7]))
        assert got[k] == (sorted(want) if nibbles is not None else None)
