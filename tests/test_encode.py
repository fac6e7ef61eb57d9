"""Coded blocks against plain Python, one sample after the other, and decoded again."""

import random

import pytest
from pyspark.sql import functions as F

from wavelake.functions.lookups import IMA_MOVES, IMA_STEPS, MS_FACTORS
from wavelake.operators import adpcm, encode

DECODERS = {"ima-wav": adpcm.ima_wav_block, "ima-qt": adpcm.ima_qt_block, "ms-adpcm": adpcm.ms_block}


def clip(v):
    return max(-32768, min(32767, v))


def mean_move(xs):
    return sum(abs(b - a) for a, b in zip(xs, xs[1:])) // (len(xs) - 1) if len(xs) > 1 else 0


def nibble_run(xs, p, i, n):
    """IMA: the nibble whose steps come nearest from below, then what a decoder makes of it."""
    out = []
    for f in range(n):
        gap, step = (xs[f] if f < len(xs) else p) - p, IMA_STEPS[i]
        nib, left = (8 if gap < 0 else 0), abs(gap)
        for bit, part in ((4, step), (2, step // 2), (1, step // 4)):
            if left >= part:
                nib, left = nib | bit, left - part
        d = step // 8 + (step if nib & 4 else 0) + (step // 2 if nib & 2 else 0) + (step // 4 if nib & 1 else 0)
        p, i = clip(p - d if nib & 8 else p + d), max(0, min(88, i + IMA_MOVES[nib & 7]))
        out.append(nib)
    return out


def start_index(xs):
    return min(range(89), key=lambda i: (abs(IMA_STEPS[i] - mean_move(xs)), i)) if len(xs) > 1 else 0


def plain(coding, chans, size, frames):
    n = len(chans)
    if coding == "ima-wav":
        head = b"".join((xs[0] & 0xFFFF).to_bytes(2, "little") + bytes([start_index(xs), 0]) for xs in chans)
        runs = [nibble_run(xs[1:], xs[0], start_index(xs), frames - 1) for xs in chans]
        return head + bytes(runs[c][8 * g + 2 * k] | runs[c][8 * g + 2 * k + 1] << 4 for g in range((frames - 1) // 8) for c in range(n) for k in range(4))
    if coding == "ima-qt":
        out = b""
        for xs in chans:
            p, i = xs[0] // 128 * 128, start_index(xs)
            run = nibble_run(xs, p, i, 64)
            out += ((p & 0xFF80) | i).to_bytes(2, "big") + bytes(run[k] | run[k + 1] << 4 for k in range(0, 64, 2))
        return out
    step = [max(16, min(32767, mean_move(xs) // 4)) for xs in chans]
    last, half = [xs[1] if len(xs) > 1 else xs[0] for xs in chans], lambda v: (v & 0xFFFF).to_bytes(2, "little")
    out, nibbles = bytes(n) + b"".join(map(half, step)) + b"".join(map(half, last)) + b"".join(half(xs[0]) for xs in chans), []
    for f in range(2, frames):
        for c, xs in enumerate(chans):
            gap = (xs[f] if f < len(xs) else last[c]) - last[c]
            told = max(-8, min(7, int((gap + (step[c] // 2 if gap >= 0 else -(step[c] // 2))) / step[c])))
            last[c] = clip(last[c] + told * step[c])
            step[c] = max(16, MS_FACTORS[told & 15] * step[c] // 256)
            nibbles.append(told & 15)
    return out + bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))


def tracks(seed):
    r = random.Random(seed)
    kinds = [lambda f: r.randint(-32768, 32767), lambda f: (f * 37) % 900 - 450, lambda f: 0, lambda f: (-32768, 32767)[f // 9 % 2]]
    return {k: [[kinds[(k + c) % 4](f) for f in range(n)] for c in (0, 1)] for k, n in enumerate((1, 2, 63, 64, 65, 130, 500))}


@pytest.mark.parametrize("coding,size,channels", [("ima-wav", 36, 1), ("ima-wav", None, 2), ("ima-qt", None, 1), ("ima-qt", None, 2), ("ms-adpcm", 47, 1), ("ms-adpcm", 94, 2)])
def test_blocks(spark, coding, size, channels):
    own = tracks(len(coding) + channels)
    rows = [(k, f, c, x) for k, chans in own.items() for c in range(channels) for f, x in enumerate(chans[c])]
    samples = spark.createDataFrame(rows, "track int, frame bigint, ch int, x int").repartition(5)
    size, frames = encode.geometry(coding, channels, size)
    blocks = encode.encode_blocks(samples, coding, channels, size).cache()
    got = {(r.track, r.block): r for r in blocks.collect()}
    assert len(got) == sum(-(-len(c[0]) // frames) for c in own.values())
    for (k, b), r in got.items():
        part = [xs[b * frames : (b + 1) * frames] for xs in own[k][:channels]]
        assert r.frames == len(part[0]) and len(r.data) == size
        assert bytes(r.data) == plain(coding, part, size, frames)
    back = DECODERS[coding](blocks.withColumn("channels", F.lit(channels)), block="data").where("frame < frames")
    smooth = {(r.block * frames + r.frame, r.ch): r.x for r in back.where("track = 5").collect()}
    assert len(smooth) == 130 * channels


@pytest.mark.parametrize("coding", ["ulaw", "alaw"])
def test_straight_codings(spark, coding):
    rows = [("a", f, c, (f * 997 + c) % 65_536 - 32_768) for f in range(2100) for c in (0, 1)]
    got = encode.encode_blocks(spark.createDataFrame(rows, "track string, frame bigint, ch int, x int"), coding, 2).orderBy("block").collect()
    assert [(r.frames, len(r.data)) for r in got] == [(2048, 4096), (52, 104)]
    law = encode.fn.ulaw_encode if coding == "ulaw" else encode.fn.alaw_encode
    want = spark.createDataFrame(rows, "track string, frame bigint, ch int, x int").orderBy("frame", "ch").select(law(F.col("x")).alias("b")).collect()
    assert b"".join(bytes(r.data) for r in got) == bytes(int(r.b) for r in want)


def test_edges(spark):
    rows = [("a", 0, 0, 99_999, 1), ("a", 1, 0, None, 1), ("a", 2, 7, 5, 1), (None, 0, 0, 1, 1), ("a", None, 0, 1, 1), ("a", 3, 0, -99_999, 1)]
    df = spark.createDataFrame(rows, "track string, frame bigint, ch int, x int, block int")
    got = encode.encode_blocks(df, "ima-qt").collect()
    assert [(r.track, r.block, r.frames) for r in got] == [("a", 0, 4)]
    assert bytes(got[0].data) == plain("ima-qt", [[32767, 0, 0, -32768]], 34, 64)
    assert encode.encode_blocks(df.limit(0), "ms-adpcm").collect() == []
    for bad in (("ima-wav", 1, 37), ("ima-qt", 1, 35), ("other", 1, None), ("ulaw", 0, None)):
        with pytest.raises(ValueError):
            encode.geometry(*bad)
    whole = encode.coded_data(encode.encode_blocks(df.withColumn("frame", F.col("frame") + 62), "ima-qt")).first()
    assert whole.frames == 66 and len(whole.data) == 68
