"""Comparing tracks by ear: the lag between two of them, spectrograms on the hearing scale, and their similarity.

Tracks of any length are worked in pieces. Spectrograms and similarities need a halo from the next range alone. The lag
comes from a transform in four steps: a track of N samples is a matrix of about the square root of N rows and columns,
whose columns and then rows are transformed by groups, so that each step is one shuffle and no task holds a track."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ranges import SPAN

#: Lengths of a track are sent to this many parts of it, so that no long track's samples meet in one task.
PARTS = 32
#: About as many bytes of results go back to Spark at once.
PACK = 4 << 20


def _items(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.StructArray]]:
    """(row, its items) of a column of lists of structs."""
    lists = batch.column(column)
    starts = lists.offsets.to_numpy()
    for k in range(batch.num_rows):
        yield k, lists.values.slice(starts[k], starts[k + 1] - starts[k])


def _numbers(items: pa.StructArray, field: str) -> np.ndarray:
    return pc.struct_field(items, field).to_numpy(zero_copy_only=False)


def _mapped(df: DataFrame, key: str, own: list[str], fields: list[tuple[str, str]], rows) -> DataFrame:
    """For each row of df, its key and the rows that rows(its columns own, its items) gives, with these fields."""
    key_type = df.schema[key].dataType
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}

    arrow = to_arrow_type(key_type)
    names = [key, *[name for name, _ in fields]]

    def packed(keys: list, got: list[tuple]) -> pa.RecordBatch:
        cells = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*got), fields)]
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), *cells], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in [key, *own]]
            keys, got, size = [], [], 0
            for k, items in _items(batch, "items"):
                for row in rows(*[v[k] for v in values[1:]], items):
                    keys.append(values[0][k])
                    got.append(row)
                    size += sum(len(c) for c in row if isinstance(c, (bytes, list))) + 8 * len(row)
                    if size > PACK:
                        yield packed(keys, got)
                        keys, got, size = [], [], 0
            if got:
                yield packed(keys, got)

    schema = f"`{key}` {key_type.simpleString()}, " + ", ".join(f"{name} {kind}" for name, kind in fields)
    return df.select(key, *own, "items").mapInArrow(run, schema)


def _ranges(df: DataFrame, key: str, at: str, values: list[Column], span: int, halo: int) -> DataFrame:
    """(key, __range, items): the positions of each range and the halo behind it, in no order."""
    place, own = F.col(at), F.floor(F.col(at) / span)
    to = F.when((place % span < halo) & (place >= span), F.array(own, own - 1)).otherwise(F.array(own))
    item = F.struct(place.cast("bigint").alias("at"), *values).alias("item")
    return df.select(key, F.explode(to).alias("__range"), item).groupBy(key, "__range").agg(F.collect_list("item").alias("items"))


# Lag


def _columns(n1: int, n2: int, column: int, items: pa.StructArray) -> Iterator[tuple]:
    """A column's transform, turned to its place, in slices: (block of rows, column, slices of both tracks)."""
    place = _numbers(items, "row")
    turn = np.exp(-2j * np.pi / (n1 * n2) * (np.arange(n1) * column % (n1 * n2)))
    width = max(1, n1 // n2)
    both = []
    for field in ("ref", "test"):
        x = np.zeros(n1)
        np.add.at(x, place, _numbers(items, field))
        both.append(np.fft.fft(x) * turn)
    for block in range(n1 // width):
        yield (block, n1, n2, column, *[x[block * width : (block + 1) * width].tobytes() for x in both])


def _rows(block: int, n1: int, n2: int, items: pa.StructArray) -> Iterator[tuple]:
    """The transform of a block of rows, both tracks multiplied, and turned back, in slices for each column."""
    width = max(1, n1 // n2)
    of = _numbers(items, "column")
    both = []
    for field in ("ref", "test"):
        x = np.zeros((n2, width), complex)  # columns without samples are all zero and were not sent
        for column, data in zip(of, pc.struct_field(items, field)):
            x[column] = np.frombuffer(data.as_buffer(), complex)
        both.append(np.fft.fft(x, axis=0))
    product = np.fft.ifft(np.conj(both[0]) * both[1], axis=0)
    rows = block * width + np.arange(width)
    for column in range(n2):
        turn = np.exp(2j * np.pi / (n1 * n2) * (rows * column % (n1 * n2)))
        yield column, n1, n2, block, (product[column] * turn).tobytes()


def _best(n1: int, n2: int, column: int, norm: float, items: pa.StructArray) -> Iterator[tuple]:
    """The largest correlation of a column's places, and the first place that has it."""
    width = max(1, n1 // n2)
    x = np.zeros(n1, complex)
    for block, data in zip(_numbers(items, "block"), pc.struct_field(items, "data")):
        x[block * width : (block + 1) * width] = np.frombuffer(data.as_buffer(), complex)
    found = np.round(np.fft.ifft(x).real / norm, 9) if norm > 0 else np.zeros(n1)
    first = int(found.argmax())
    yield float(found[first]) + 0.0, n2 * first + column


def lags(ref: DataFrame, test: DataFrame, key: str = "track", at: str = "frame", v: str = "v", span: int = SPAN) -> DataFrame:
    """(key, lag, correlation): how many frames later test has what ref has, where the sum of products over all lags is
    largest, and that sum as a share of what equal tracks would have (nine digits). Ties, which are equal in these digits,
    go to the smallest lag from 0 up, and only then to negative ones from the lowest up.

    All lags of the whole tracks count, at N log N time: no pairs of ranges are made. N is the power of two that both
    lengths fit into; lags up to N / 2 at which the tracks don't meet have a sum of 0. Positions count from 0; null samples
    are 0, repeated positions add up, and rows with a null position or key take no part. A silent or missing track gives
    lag 0 and correlation 0. Other columns go. span, a power of two, is the size of the groups as long as N is below its
    square; beyond that they grow with the square root of N."""
    if span < 2 or span & (span - 1):
        raise ValueError("span must be a power of two")
    pair = lambda df, r, t: df.select(F.col(key), F.col(at).cast("bigint").alias("__at"), F.coalesce(r, F.lit(0.0)).cast("double").alias("ref"), F.coalesce(t, F.lit(0.0)).cast("double").alias("test"))
    both = pair(ref, F.col(v), F.lit(0.0)).withColumn("__test", F.lit(0)).unionByName(pair(test, F.lit(0.0), F.col(v)).withColumn("__test", F.lit(1))).where(F.col(key).isNotNull() & (F.col("__at") >= 0))
    length = lambda side: F.coalesce(F.max(F.when(F.col("__test") == side, F.col("__at") + 1)), F.lit(0))
    sizes = both.groupBy(key).agg((length(0) + length(1)).alias("__n"), F.sqrt(F.sum(F.col("ref") * F.col("ref")) * F.sum(F.col("test") * F.col("test"))).alias("norm"))
    bits = F.length(F.bin(F.greatest(F.col("__n") - 1, F.lit(1).cast("bigint"))))
    log = span.bit_length() - 1
    first = F.when(bits <= log, bits).otherwise(F.greatest(F.lit(log), F.ceil(bits / 2).cast("int")))
    power = lambda n: F.pow(F.lit(2.0), n).cast("bigint")
    sizes = sizes.select(key, "norm", power(first).alias("n1"), power(bits - first).alias("n2"))

    part = F.pmod(F.floor(F.col("__at") / span), F.lit(PARTS)).cast("int")
    spread = sizes.select(key, "n1", "n2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    dealt = both.withColumn("__part", part).join(spread, [key, "__part"])
    item = F.struct(F.floor(F.col("__at") / F.col("n2")).alias("row"), "ref", "test")
    columns = dealt.select(key, "n1", "n2", (F.col("__at") % F.col("n2")).alias("column"), item.alias("item")).groupBy(key, "n1", "n2", "column").agg(F.collect_list("item").alias("items"))
    whole = [("n1", "bigint"), ("n2", "bigint")]
    turned = _mapped(columns, key, ["n1", "n2", "column"], [("block", "bigint"), *whole, ("column", "bigint"), ("ref", "binary"), ("test", "binary")], _columns)

    blocks = turned.groupBy(key, "block", "n1", "n2").agg(F.collect_list(F.struct("column", "ref", "test")).alias("items"))
    back = _mapped(blocks, key, ["block", "n1", "n2"], [("column", "bigint"), *whole, ("block", "bigint"), ("data", "binary")], _rows)

    each = back.groupBy(key, "n1", "n2", "column").agg(F.collect_list(F.struct("block", "data")).alias("items"))
    # the norm meets one row a column, not the samples; a track's columns are the parts that a hot one is dealt to
    norms = sizes.select(key, "norm", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    each = each.withColumn("__part", (F.col("column") % PARTS).cast("int")).join(norms, [key, "__part"])
    found = _mapped(each, key, ["n1", "n2", "column", "norm"], [("c", "double"), ("place", "bigint")], _best)
    best = found.groupBy(key).agg(F.max(F.struct("c", (-F.col("place")).alias("p"))).alias("b")).join(sizes.select(key, (F.col("n1") * F.col("n2")).alias("n")), key)
    place = -F.col("b.p")
    return best.select(key, F.when(place > F.col("n") / 2, place - F.col("n")).otherwise(place).alias("lag"), F.col("b.c").alias("correlation"))


def aligned(ref: DataFrame, test: DataFrame, lags: DataFrame, key: str = "track", at: str = "frame", v: str = "v") -> DataFrame:
    """(key, at, ref, test): both tracks from where both have begun, counted from 0, as far as both go. lags has a row a
    key, as lags() gives it; keys without one go. Lags meet the samples by parts of a track."""
    part = F.pmod(F.floor(F.col(at) / SPAN), F.lit(PARTS)).cast("int").alias("__part")
    spread = lags.select(key, "lag", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    zero = F.lit(0).cast("bigint")
    r = ref.select(key, at, F.col(v).alias("ref"), part).join(spread, [key, "__part"]).select(key, (F.col(at) - F.greatest(-F.col("lag"), zero)).alias(at), "ref")
    t = test.select(key, at, F.col(v).alias("test"), part).join(spread, [key, "__part"]).select(key, (F.col(at) - F.greatest(F.col("lag"), zero)).alias(at), "test")
    return r.where(F.col(at) >= 0).join(t.where(F.col(at) >= 0), [key, at])


# Spectrogram


def band_weights(rate: int, nfft: int, bands: int, low: float) -> np.ndarray:
    """What each band (column) takes of each line (row) of a spectrum; a band's weights sum up to 1. Bands have the shape
    of a hearing filter of order 4, at equal distances on the hearing scale from low to 16 kHz or 95 % of half the rate."""
    scale = lambda f: np.log10(1 + 4.37e-3 * f)
    centre = (10 ** np.linspace(scale(low), scale(min(16000.0, 0.475 * rate)), bands) - 1) / 4.37e-3
    width = 1.019 * 24.7 * (1 + 4.37e-3 * centre)
    line = np.arange(nfft // 2 + 1)[:, None] * (rate / nfft)
    shape = (1 + ((line - centre) / width) ** 2) ** -4.0
    return shape / shape.sum(0)


def _spectra(number: int, items: pa.StructArray, nfft: int, hop: int, span: int, names: list[str], weights: np.ndarray) -> Iterator[tuple]:
    at = _numbers(items, "at") - number * span
    length = int(at.max()) + 1
    count = min(span // hop, (length - nfft) // hop + 1)
    if count < 1:
        return
    window = np.hanning(nfft)
    levels = []
    for name in names:
        x = np.zeros(length)
        x[at] = _numbers(items, name)
        frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[::hop][:count]
        power = np.abs(np.fft.rfft(frames * window)) ** 2 / (0.375 * nfft)
        levels.append(10 * np.log10(power @ weights + 1e-3))
    for t in range(count):
        yield (number * (span // hop) + t, *[x[t].tolist() for x in levels])


def spectrogram(samples: DataFrame, rate: int, nfft: int = 1024, hop: int | None = None, values: tuple[str, ...] = ("v",), key: str = "track", at: str = "frame", bands: int = 32, low: float = 50.0, span: int = SPAN) -> DataFrame:
    """(key, t, and for each of values an array of the levels of its bands in decibels): Hann windows of nfft samples, one
    each hop (half of nfft), as far as they lie whole in the track. Levels are the same for any span: a range takes the
    start of the next one along. 1e-3 is added to each power, so silence has -30.

    Positions count up by one from 0 and are unique; null samples and missing positions are silence. Tracks shorter than a
    window, null keys and empty tables give no rows. Other columns go."""
    hop = hop or nfft // 2
    span = max(span, nfft) // hop * hop
    span += hop if span < nfft else 0
    cells = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in values]
    cut = _ranges(samples.where(F.col(key).isNotNull() & (F.col(at) >= 0)), key, at, cells, span, nfft - hop)
    rows = partial(_spectra, nfft=nfft, hop=hop, span=span, names=list(values), weights=band_weights(rate, nfft, bands, low))
    return _mapped(cut, key, ["__range"], [("t", "bigint"), *[(c, "array<double>") for c in values]], rows)


# Similarity


def _likeness(number: int, items: pa.StructArray, span: int, k: int) -> Iterator[tuple]:
    """Row by row: the sum over bands of how alike both are in the k x k cells that start there."""
    order = _numbers(items, "at").argsort()
    at = _numbers(items, "at")[order]
    levels = [np.maximum(np.array(pc.struct_field(items, f).to_pylist(), float)[order], 0.0) for f in ("ref", "test")]
    if len(at) < k or levels[0].shape[1] < k:
        return
    mean = lambda a: np.lib.stride_tricks.sliding_window_view(a, (k, k)).mean((2, 3))
    r, d = levels
    mr, md = mean(r), mean(d)
    vr, vd = (np.maximum(mean(x * x) - m * m, 0.0) for x, m in ((r, mr), (d, md)))
    light, contrast = 1.0, 4.5  # (0.01 * 100)^2 and (0.03 * 100)^2 / 2: fixed values
    alike = (2 * mr * md + light) / (mr * mr + md * md + light) * (mean(r * d) - mr * md + contrast) / (np.sqrt(vr * vd) + contrast)
    whole = at[k - 1 :] - at[: len(at) - k + 1] == k - 1
    for t, s, ok in zip(at, alike.sum(1), whole):
        if ok and t < (number + 1) * span:
            yield int(t), float(s)


def similarity(levels: DataFrame, key: str = "track", at: str = "t", ref: str = "ref", test: str = "test", bands: int = 32, patch: int = 32, k: int = 3, span: int = 1024) -> DataFrame:
    """(key, similarity, patches): the mean structural similarity of two spectrograms over patches of patch rows, one each
    half patch, as far as they lie whole in the track. Levels below 0 count as 0.

    How alike the k x k cells around a place are hangs on no patch, so it is found once a row, in ranges with a halo of
    k - 1 rows; patches are sums of such rows and never put together themselves. Rows are unique; keys without a whole
    patch of rows next to each other, null keys, and null levels (such rows count as missing) give none."""
    rows = levels.where(F.col(key).isNotNull() & F.col(ref).isNotNull() & F.col(test).isNotNull())
    cut = _ranges(rows, key, at, [F.col(ref).alias("ref"), F.col(test).alias("test")], span, k - 1)
    alike = _mapped(cut, key, ["__range"], [("t", "bigint"), ("s", "double")], partial(_likeness, span=span, k=k))
    step, inner = patch // 2, patch - k + 1
    first = F.greatest(F.ceil((F.col("t") - (inner - 1)) / step), F.lit(0).cast("bigint"))
    of = F.explode(F.sequence(first, F.floor(F.col("t") / step)))
    patches = alike.where(first <= F.floor(F.col("t") / step)).select(key, of.alias("p"), "s").groupBy(key, "p").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    return patches.where(F.col("n") == inner).groupBy(key).agg((F.avg("s") / (inner * (bands - k + 1))).alias("similarity"), F.count("*").alias("patches"))


def score(ref: DataFrame, test: DataFrame, rate: int, key: str = "track", channel: str = "ch", at: str = "frame", v: str = "v", span: int = SPAN) -> DataFrame:
    """(key, lag, similarity): how like test sounds to ref, the mean over their channels. The lag is that of channel 0;
    20 ms at each end of what both have in common are left out. Keys without a whole patch have a null similarity."""
    first = lambda df: df.where(F.col(channel) == 0)
    found = lags(first(ref), first(test), key, at, v, span)
    both = F.struct(F.col(key).alias("key"), F.col(channel).alias("ch"))
    one = lambda df: df.select(both.alias("__track"), at, v, key)
    channels = ref.select(key, channel).distinct().join(found, key).select(both.alias("__track"), "lag")
    met = aligned(one(ref), one(test), channels, "__track", at, v)
    edge = rate // 50
    ends = met.groupBy("__track").agg((F.max(at) - edge).alias("__end"))
    part = F.pmod(F.floor(F.col(at) / SPAN), F.lit(PARTS)).cast("int")
    ends = ends.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    inner = met.withColumn("__part", part).join(ends, ["__track", "__part"]).where((F.col(at) >= edge) & (F.col(at) <= F.col("__end")))
    nfft = 1024 if rate >= 32000 else 512
    levels = spectrogram(inner.withColumn(at, F.col(at) - edge), rate, nfft, values=("ref", "test"), key="__track", at=at, span=span)
    alike = similarity(levels, "__track").groupBy(F.col("__track.key").alias(key)).agg(F.avg("similarity").alias("similarity"))
    return found.select(key, "lag").join(alike, key, "left")
