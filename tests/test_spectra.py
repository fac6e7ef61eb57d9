"""Lags, spectrograms and similarities in ranges against plain numpy on whole tracks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import spectra
from wavelake.plans import hearing

from .conftest import SF


def frame(spark, tracks, kind="int"):
    rows = [(k, f, float(v)) for k, x in tracks.items() for f, v in enumerate(x)]
    return spark.createDataFrame(rows, f"track {kind}, frame bigint, v double")


def plain_lag(ref, test):
    """The first of the lags 0, 1, ..., and then the negative ones from the lowest, with the largest sum of products."""
    n = 1 << (len(ref) + len(test) - 1).bit_length()
    order = [*range(n // 2 + 1), *range(n // 2 + 1 - n, 0)]
    sums = [sum(ref[i] * test[i + lag] for i in range(max(0, -lag), min(len(ref), len(test) - lag))) for lag in order]
    return order[int(np.argmax(sums))]


def plain_spectrogram(x, rate, nfft, hop, bands=32, low=50.0):
    weights = spectra.band_weights(rate, nfft, bands, low)
    out = []
    for at in range(0, len(x) - nfft + 1, hop):
        power = np.abs(np.fft.rfft(x[at : at + nfft] * np.hanning(nfft))) ** 2 / (nfft * 0.375)
        out.append([10 * np.log10(sum(power * weights[:, b]) + 1e-3) for b in range(bands)])
    return np.array(out)


def plain_similarity(ref, test, patch=32, k=3):
    ref, test, scores = np.maximum(ref, 0), np.maximum(test, 0), []
    for top in range(0, len(ref) - patch + 1, patch // 2):
        cells = []
        for t in range(top, top + patch - k + 1):
            for b in range(ref.shape[1] - k + 1):
                r, d = ref[t : t + k, b : b + k], test[t : t + k, b : b + k]
                light = (2 * r.mean() * d.mean() + 1) / (r.mean() ** 2 + d.mean() ** 2 + 1)
                cells.append(light * (((r - r.mean()) * (d - d.mean())).mean() + 4.5) / (r.std() * d.std() + 4.5))
        scores.append(np.mean(cells))
    return np.mean(scores) if scores else None


@pytest.mark.parametrize("span", [8, 64, 65_536])
def test_lags(spark, span):
    r = np.random.default_rng(3)
    ref = {k: r.integers(-90, 90, n) for k, n in enumerate((200, 200, 333, 1, 40, 5))}
    test = {0: np.r_[np.zeros(17), ref[0]], 1: ref[1][31:], 2: np.r_[r.integers(-9, 9, 7), ref[2][:300]], 3: [5], 4: np.zeros(9), 5: r.integers(-90, 90, 60)}
    got = {x.track: x for x in spectra.lags(frame(spark, ref), frame(spark, test), span=span).collect()}
    assert {k: x.lag for k, x in got.items()} == {k: plain_lag(ref[k], test[k]) for k in ref}
    assert (got[0].lag, got[1].lag, got[2].lag, got[4].lag, got[4].correlation) == (17, -31, 7, 0, 0.0)
    assert got[0].correlation == 1.0


def test_lags_edges(spark):
    ref = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 1, None, 1), ("a", 2, 1.0, 1), ("a", None, 9.0, 1), (None, 0, 1.0, 1), ("b", 0, 1.0, 1)], "track string, frame bigint, v double, lag int")
    test = ref.withColumn("v", F.col("v") * 2).where("track IS NULL OR track = 'a'")
    got = {x.track: (x.lag, x.correlation) for x in spectra.lags(ref, test).collect()}
    assert got == {"a": (0, 1.0), "b": (0, 0.0)}
    ties = spectra.lags(frame(spark, {0: [1, 1]}), frame(spark, {0: [0, 1, 0, 1, 0]})).first()
    assert ties.lag == plain_lag([1, 1], [0, 1, 0, 1, 0]) == 0
    assert spectra.lags(ref.limit(0), test.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spectra.lags(ref, test, span=3)


@pytest.mark.parametrize("span", [1, 300, 65_536])
def test_spectrogram(spark, span):
    r = np.random.default_rng(5)
    tracks = {1: r.normal(0, 3000, 2000), 2: np.zeros(700), 3: r.normal(0, 1, 255), 4: r.normal(0, 1, 256)}
    got = spectra.spectrogram(frame(spark, tracks), 22_050, nfft=256, hop=96, span=span).orderBy("track", "t").collect()
    for k, x in tracks.items():
        want = plain_spectrogram(x, 22_050, 256, 96)
        rows = [row for row in got if row.track == k]
        assert [row.t for row in rows] == list(range(len(want)))
        assert not len(want) or np.allclose([row.v for row in rows], want, atol=1e-9)
    assert all(abs(v + 30) < 1e-9 for row in got if row.track == 2 for v in row.v)


@pytest.mark.parametrize("span", [2, 16, 1024])
def test_similarity(spark, span):
    r = np.random.default_rng(7)
    levels = {1: r.uniform(-20, 80, (100, 9)), 2: np.full((33, 9), 5.0), 3: r.uniform(0, 9, (31, 9)), 4: r.uniform(0, 9, (32, 9))}
    noisy = {k: x + r.normal(0, 2, x.shape) if k != 2 else x for k, x in levels.items()}
    rows = [(k, t, a, b) for k in levels for t, (a, b) in enumerate(zip(levels[k].tolist(), noisy[k].tolist()))]
    df = spark.createDataFrame(rows + [(9, 0, None, [1.0] * 9), (None, 0, [1.0] * 9, [1.0] * 9)], "track int, t bigint, ref array<double>, test array<double>")
    got = {x.track: x for x in spectra.similarity(df, bands=9, span=span).collect()}
    assert sorted(got) == [1, 2, 4] and got[1].patches == 5 and got[2].similarity == pytest.approx(1)
    for k in got:
        assert got[k].similarity == pytest.approx(plain_similarity(levels[k], noisy[k]), abs=1e-9)


def plain_score(ref, test, rate, nfft):
    lag = plain_fft_lag(ref[0], test[0])
    out = []
    for a, b in zip(ref, test):
        a, b = a[max(0, -lag) :], b[max(0, lag) :]
        n, edge = min(len(a), len(b)), rate // 50
        out.append(plain_similarity(*[plain_spectrogram(x[edge : n - edge], rate, nfft, nfft // 2) for x in (a, b)]))
    return lag, np.mean(out)


def plain_fft_lag(ref, test):
    c = np.correlate(test, ref, "full")
    return int(np.argmax(c)) - (len(ref) - 1)


def test_score_of_a_late_copy(spark):
    r = np.random.default_rng(1)
    ref = r.normal(0, 2000, (2, 11_000))
    test = np.concatenate([np.zeros((2, 250)), ref + r.normal(0, 300, ref.shape)], 1)
    rows = lambda x: spark.createDataFrame([(5, c, f, float(v)) for c in (0, 1) for f, v in enumerate(x[c])], "track int, ch int, frame bigint, v double")
    got = spectra.score(rows(ref), rows(test), 8000, span=4096).first()
    lag, like = plain_score(ref, test, 8000, 512)
    assert got.lag == lag == 250 and got.similarity == pytest.approx(like, abs=1e-9)
    same = spectra.score(rows(ref), rows(ref), 8000).first()
    assert same.lag == 0 and same.similarity == pytest.approx(1) and got.similarity < same.similarity
    short = spectra.score(rows(ref[:, :900]), rows(ref[:, :900]), 8000).first()
    assert short.similarity is None


def test_score_query(spark):
    folder = SF.replace("sf0.001", "sf0.01")  # the smallest table that is long enough for a patch
    got = hearing.track_score(spark, folder).first()
    ref, test = hearing.long_track(spark, folder)
    whole = lambda df, c: df.where(F.col("ch") == c).select("frame", "v").toPandas().set_index("frame").v
    fill = lambda v: v.reindex(range(int(v.index.max()) + 1), fill_value=0).to_numpy(float)
    lag, like = plain_score([fill(whole(ref, c)) for c in (0, 1)], [fill(whole(test, c)) for c in (0, 1)], 8000, 512)
    assert got.lag == lag == 37 and got.similarity == pytest.approx(like, abs=1e-6)
