"""IMA ADPCM: the starting index of a track and the decoding of nibbles, a fold over each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import le, signed, u8
from ..functions.lookups import IMA_MOVES, IMA_STEPS, MS_FACTORS, MS_PAIRS
from .ranges import with_previous


#: The largest MS step whose product with the largest factor 32 bits hold.
MOST_DELTA = ((1 << 31) - 1) // max(MS_FACTORS)


def initial_index(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """(track, mean, index): the step nearest the mean absolute difference of neighbours, the lowest of equal ones.
    The step table has 89 rows and is joined to one row a track."""
    near = with_previous(samples, "track", "frame", "x", 1)
    d = near.select("track", F.when(F.col("frame") > 0, F.abs(F.col("x") - F.col("__p1"))).alias("d"))
    mean = d.groupBy("track").agg(F.coalesce(F.floor(F.sum("d") / F.count("d")), F.lit(0)).cast("bigint").alias("mean"), F.count("d").alias("n"))
    steps = F.array(*[F.struct(F.abs(F.col("mean") - s).alias("e"), F.lit(i).cast("bigint").alias("i")) for i, s in enumerate(IMA_STEPS)])
    return mean.select("track", "mean", F.when(F.col("n") == 0, 0).otherwise(F.array_min(steps)["i"]).cast("bigint").alias("index"))


def decode(nibbles: DataFrame, block: int = 64) -> DataFrame:
    """(track, frame, x) from (track, frame, nibble): each block of ``block`` nibbles starts at predictor 0 and index
    0, so blocks decode apart from each other, and a block is the most that is gathered in one row."""
    blocks = nibbles.groupBy("track", F.floor(F.col("frame") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "nibble"))).alias("ns"))
    done = blocks.select("track", "ns", ima_run(F.transform("ns", lambda n: n["nibble"].cast("int")), F.lit(0), F.lit(0)).alias("out"))
    return done.select("track", F.explode(F.arrays_zip("ns", "out")).alias("z")).select("track", F.col("z.ns.frame").alias("frame"), F.col("z.out").cast("bigint").alias("x"))


def ima_run(nibbles: Column, predictor: Column, index: Column) -> Column:
    """The samples of an array of nibbles, one by one from the predictor and step index given."""
    steps, moves = F.array(*map(F.lit, IMA_STEPS)), F.array(*map(F.lit, IMA_MOVES))
    zero = F.struct(predictor.cast("int").alias("p"), index.cast("int").alias("i"), F.array().cast("array<int>").alias("out"))

    def step(s, nib):
        size = F.element_at(steps, s["i"] + 1)
        bit = lambda k: nib.bitwiseAND(k) != 0
        d = F.shiftright(size, 3) + F.when(bit(4), size).otherwise(0) + F.when(bit(2), F.shiftright(size, 1)).otherwise(0) + F.when(bit(1), F.shiftright(size, 2)).otherwise(0)
        p = F.least(F.greatest(F.when(bit(8), s["p"] - d).otherwise(s["p"] + d), F.lit(-32768)), F.lit(32767))
        i = F.least(F.greatest(s["i"] + F.element_at(moves, nib.bitwiseAND(7) + 1), F.lit(0)), F.lit(88))
        return F.struct(p.alias("p"), i.alias("i"), F.concat(s["out"], F.array(p)).alias("out"))

    return F.aggregate(nibbles, zero, step)["out"]


def observable_entries(nibbles: Column, index: Column) -> Column:
    """The step indices, in order, that an array of nibbles meets with a magnitude other than 0, where a wrong step would
    be heard in full. Null nibbles give null."""
    moves = F.array(*map(F.lit, IMA_MOVES))
    zero = F.struct(index.cast("int").alias("i"), F.array().cast("array<int>").alias("seen"))

    def step(s, nib):
        size = nib.bitwiseAND(7)
        i = F.least(F.greatest(s["i"] + F.element_at(moves, size + 1), F.lit(0)), F.lit(88))
        return F.struct(i.alias("i"), F.when(size > 0, F.array_union(s["seen"], F.array(s["i"]))).otherwise(s["seen"]).alias("seen"))

    return F.array_sort(F.aggregate(nibbles, zero, step)["seen"])


def _low_first(data: Column, at: Column) -> Column:
    """The two nibbles of the byte at a place, low one first."""
    b = u8(data, at).cast("int")
    return F.array(b.bitwiseAND(15), F.shiftright(b, 4))


def ima_wav_block(blocks: DataFrame, block: str = "block", channels: str = "channels") -> DataFrame:
    """blocks (one row each, with the bytes) with frame, ch and x: a channel's preamble is its first sample, and groups
    of four bytes go to the channels in turn. Only whole turns count; a block shorter than its preambles gives none."""
    data, c = F.col(block), F.col(channels)
    each = blocks.where(F.length(data) >= 4 * c).withColumn("ch", F.explode(F.sequence(F.lit(0), (c - 1).cast("int"))))
    ch = F.col("ch")
    groups = F.floor((F.length(data) - 4 * c) / (4 * c)).cast("int")
    places = F.when(groups > 0, F.flatten(F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: 4 * c + (g * c + ch) * 4 + k)))).otherwise(F.array().cast("array<int>"))
    nibbles = F.flatten(F.transform(places, lambda at: _low_first(data, at)))
    first = signed(le(data, 4 * ch, 2), 16).cast("int")
    out = F.concat(F.array(first), ima_run(nibbles, first, F.least(u8(data, 4 * ch + 2), F.lit(88))))
    return _samples(each, out, blocks.columns)


def ima_qt_block(blocks: DataFrame, block: str = "block", channels: str = "channels") -> DataFrame:
    """The same for packets of 34 bytes a channel: nine bits of predictor, which is no sample, and seven of index. A
    block without all channels' packets gives none."""
    data, c = F.col(block), F.col(channels)
    each = blocks.where(F.length(data) >= 34 * c).withColumn("ch", F.explode(F.sequence(F.lit(0), (c - 1).cast("int"))))
    at = 34 * F.col("ch")
    word = u8(data, at) * 256 + u8(data, at + 1)
    nibbles = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: _low_first(data, at + 2 + k)))
    out = ima_run(nibbles, signed(word.bitwiseAND(0xFF80), 16), F.least(word.bitwiseAND(127), F.lit(88)))
    return _samples(each, out, blocks.columns)


def ms_pairs(fmt: Column) -> Column:
    """The predictor pairs that a WAV format chunk of MS ADPCM states, as ms_block() takes them."""
    value = lambda i, k: signed(le(fmt, 22 + 4 * i + k, 2), 16)
    n = le(fmt, 20, 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(value(i, 0).alias("a"), value(i, 2).alias("b"))))


def ms_block(blocks: DataFrame, block: str = "block", channels: str = "channels", pairs: str | None = None) -> DataFrame:
    """MS ADPCM: the second stored sample comes first in time, then the first; nibbles are the interleaved samples, high
    one first. A step size stays where 32 bits hold its product with any factor. A predictor number past the pairs, or a block shorter than its preambles, gives none. pairs: a column
    of the file's own pairs (ms_pairs()); where there is none, the usual seven."""
    data, c = F.col(block), F.col(channels)
    each = blocks.where(F.length(data) >= 7 * c).withColumn("ch", F.explode(F.sequence(F.lit(0), (c - 1).cast("int"))))
    ch = F.col("ch")
    usual = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in MS_PAIRS])
    every_pair = F.coalesce(F.col(pairs), usual) if pairs else usual
    factors = F.array(*map(F.lit, MS_FACTORS))
    every = F.transform(F.sequence(F.lit(0), (c - 1).cast("int")), lambda k: u8(data, k))
    each = each.where(F.forall(every, lambda w: w < F.size(every_pair)))
    half = lambda k: signed(le(data, c + (2 * k) * c + 2 * ch, 2), 16)
    frames = F.floor((F.length(data) - 7 * c) * 2 / c).cast("int")
    nibble = lambda f: F.when((f * c + ch) % 2 == 0, F.shiftright(u8(data, 7 * c + F.floor((f * c + ch) / 2)).cast("int"), 4)).otherwise(u8(data, 7 * c + F.floor((f * c + ch) / 2)).cast("int").bitwiseAND(15))
    nibbles = F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), nibble)).otherwise(F.array().cast("array<int>"))
    pair = F.element_at(every_pair, u8(data, ch).cast("int") + 1)
    zero = F.struct(half(0).alias("d"), half(1).alias("s1"), half(2).alias("s2"), F.array(half(2), half(1)).alias("out"))

    def step(s, n):
        told = F.when(n >= 8, n - 16).otherwise(n)
        total = s["s1"] * pair["a"] + s["s2"] * pair["b"]
        guess = F.when(total < 0, F.ceil(total / 256)).otherwise(F.floor(total / 256))  # towards zero
        x = F.least(F.greatest(guess + told * s["d"], F.lit(-32768)), F.lit(32767)).cast("bigint")
        d = F.least(F.greatest(F.floor(F.element_at(factors, n + 1) * s["d"] / 256), F.lit(16)), F.lit(MOST_DELTA)).cast("bigint")
        return F.struct(d.alias("d"), x.alias("s1"), s["s1"].alias("s2"), F.concat(s["out"], F.array(x)).alias("out"))

    return _samples(each, F.aggregate(nibbles, zero, step)["out"], blocks.columns)


def _samples(each: DataFrame, out: Column, kept: list[str]) -> DataFrame:
    got = each.withColumn("__out", out).select(*[F.col(f"`{k}`") for k in kept], F.col("ch").cast("bigint").alias("ch"), F.posexplode("__out").alias("frame", "x"))
    return got.withColumn("frame", F.col("frame").cast("bigint")).withColumn("x", F.col("x").cast("bigint"))
