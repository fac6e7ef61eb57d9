"""Test signals, the hearing scale, and what a longer reading of a track means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The partials of the "rich" signal.
PARTIALS = (110, 113, 220, 227, 331, 337, 447)
KINDS = ("silence", "tone", "noise", "noisestereo", "tiny", "transient", "sideright", "wasted", "square", "ramp", "rich")


def noise(seed: int, *keys: Column) -> Column:
    """A number of [-1, 1) that hangs on seed and keys alone, so that rows have theirs in whatever task they are made."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(2.0**52) - 1


def signal(kind: str, frame: Column, ch: Column, rate: int, tone: int = 440, seed: int = 0) -> Column:
    """The sample of a kind of signal at a frame of a channel. Both channels of "noisestereo" and "transient" have one
    noise under envelopes of their own; "wasted" leaves its low bits empty at 16 bits."""
    if kind not in KINDS:
        raise ValueError(f"no such signal: {kind}")
    t = frame / F.lit(float(rate))
    wave = lambda f: F.sin(2 * F.pi() * f * t)
    turn = lambda f, shift=F.lit(0.0): f * t + shift - F.floor(f * t + shift)
    own, shared = noise(seed, frame, ch), noise(seed, frame)
    return {
        "silence": lambda: F.lit(0.0),
        "tone": lambda: 0.6 * wave(tone) + 0.25 * wave(tone * 3 / 2),
        "noise": lambda: 0.98 * own,
        "noisestereo": lambda: 0.98 * shared * (0.6 + 0.4 * F.sin(2 * F.pi() * 220 * t + F.pi() * ch)),
        "tiny": lambda: 0.004 * own,
        "transient": lambda: 0.9 * shared * F.pow(turn(8, 0.08 * ch), F.lit(16.0)),
        "sideright": lambda: 0.5 * wave(220) + F.when(ch == 0, 0.02 * shared).otherwise(0.0),
        "wasted": lambda: F.floor(128 * wave(tone)) / 128,
        "square": lambda: 0.7 * (2 * F.floor(2 * turn(50)) - 1),
        "ramp": lambda: 2 * turn(20) - 1,
        "rich": lambda: 0.15 * sum((wave(f) for f in PARTIALS[1:]), wave(PARTIALS[0])),
    }[kind]().cast("double")


def signals(spark: SparkSession, kind: str, frames: int, rate: int, channels: int = 1, tone: int = 440, seed: int = 0) -> DataFrame:
    """(frame, ch, v) of a signal; no frames give an empty table. Each task makes a range of frames."""
    own = F.explode(F.array(*[F.lit(c).cast("bigint") for c in range(channels)]))
    each = spark.range(frames).select(F.col("id").alias("frame"), own.alias("ch"))
    return each.select("frame", "ch", signal(kind, F.col("frame"), F.col("ch"), rate, tone, seed).alias("v"))


def erb(frequency: Column) -> Column:
    """Width in hertz of the hearing filter around a frequency."""
    return 24.7 * (4.37 * frequency / 1000 + 1)


def erb_centres(count: int, low: Column, high: Column) -> Column:
    """count frequencies (two at least) from low to high, at equal distances on the scale of these widths."""
    if count < 2:
        raise ValueError("centres need both ends")
    place = lambda f: F.log10(4.37 * f / 1000 + 1)
    step = (place(high) - place(low)) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (F.pow(F.lit(10.0), place(low) + step * k) - 1) * 1000 / 4.37)


def excess(coding: Column, more: Column, block_frames: Column) -> Column:
    """What it means that another reader found ``more`` frames than the track has: OK (none, or the padding of its last
    block), NO_PADDING (PCM has none), FEWER, or BLOCK (a whole block or more, or blocks of unknown size). Null if more is."""
    return (
        F.when(more == 0, "OK").when(more.isNull(), None).when(coding == "pcm", "NO_PADDING").when(more < 0, "FEWER").when(more >= F.coalesce(block_frames, F.lit(0)), "BLOCK").otherwise("OK")
    )
