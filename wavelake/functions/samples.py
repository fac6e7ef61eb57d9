"""Sample arithmetic as Columns: formats, companding, and the integer transforms of lossless coding."""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full scale of the integer formats.
SCALE = {"u8": 1 << 7, "s8": 1 << 7, "s16": 1 << 15, "s24": 1 << 23, "s32": 1 << 31}


def to_integer(v: Column, fmt: str) -> Column:
    """A fraction of full scale as fmt: rounded half away from zero, then always clamped."""
    scale = SCALE[fmt]
    x = v * float(scale)
    rounded = F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))
    clamped = F.least(F.greatest(rounded, F.lit(-scale)), F.lit(scale - 1)).cast("bigint")
    return clamped + 128 if fmt == "u8" else clamped


def to_fraction(x: Column, fmt: str) -> Column:
    """A sample of fmt as the fraction of full scale."""
    return ((x - 128) if fmt == "u8" else x).cast("double") / float(SCALE[fmt])


def _above(m: Column, thresholds: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [(m > t).cast("int") for t in thresholds])


def ulaw_encode(x: Column) -> Column:
    """16-bit sample to mu-law byte: sign and magnitude, clipped at 32635, bias 132, complemented."""
    m = F.least(F.abs(x), F.lit(32635)).cast("int") + 132
    seg = _above(m, [(256 << k) - 1 for k in range(7)])
    mantissa = F.floor(m / F.pow(F.lit(2.0), seg + 3)).cast("int").bitwiseAND(15)
    return (255 - (F.when(x < 0, 128).otherwise(0) + seg * 16 + mantissa)).cast("bigint")


def ulaw_decode(b: Column) -> Column:
    c = (255 - b).cast("int")
    t = (c.bitwiseAND(15) * 8 + 132) * F.pow(F.lit(2.0), F.shiftright(c, 4).bitwiseAND(7)) - 132
    return F.when(c.bitwiseAND(128) != 0, -t).otherwise(t).cast("bigint")


def alaw_encode(x: Column) -> Column:
    """16-bit sample to A-law byte: shifted before the magnitude is taken, every other bit inverted."""
    v = F.shiftright(x.cast("int"), 3)
    mask = F.when(v >= 0, 0xD5).otherwise(0x55)
    m = F.when(v >= 0, v).otherwise(-v - 1)
    seg = _above(m, [(32 << k) - 1 for k in range(7)])
    mantissa = F.floor(m / F.pow(F.lit(2.0), F.greatest(seg, F.lit(1)))).cast("int").bitwiseAND(15)
    return (seg * 16 + mantissa).bitwiseXOR(mask).cast("bigint")


def alaw_decode(b: Column) -> Column:
    a = b.cast("int").bitwiseXOR(0x55)
    seg = F.shiftright(a, 4).bitwiseAND(7)
    t = a.bitwiseAND(15) * 16
    m = F.when(seg == 0, (t + 8).cast("double")).otherwise((t + 0x108) * F.pow(F.lit(2.0), seg - 1))
    return F.when(a.bitwiseAND(128) != 0, m).otherwise(-m).cast("bigint")


def zigzag(r: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 to 0, 1, 2, 3."""
    return F.when(r >= 0, 2 * r).otherwise(-2 * r - 1).cast("bigint")


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.expr("0") + F.shiftright(z, 1)).otherwise(-F.shiftright(z, 1) - 1).cast("bigint")


MASK64 = (1 << 64) - 1


def _next(v: np.ndarray) -> np.ndarray:
    """The generator's step, of all states at once."""
    v = v ^ (v >> np.uint64(12))
    v = v ^ (v << np.uint64(25))
    return v ^ (v >> np.uint64(27))


def _jump(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.uint64)
    for b in range(8):
        out ^= tables[b][(v >> np.uint64(8 * b)).astype(np.int64) & 255]
    return out


@cache
def _tables(j: int) -> np.ndarray:
    """What 2 ** j steps make of each value of each byte of a state: steps are linear over bits, so bytes are XORed."""
    units = np.uint64(1) << np.arange(64, dtype=np.uint64)
    images = _jump(_tables(j - 1), _jump(_tables(j - 1), units)) if j else _next(units)
    bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bit == 1, images[8 * b : 8 * b + 8], np.uint64(0)), axis=1) for b in range(8)])


def draws(seed: int, first: int, n: int) -> np.ndarray:
    """n draws of -0.5 up to 0.5 behind the first ones of a seed (0: a fixed one): the state jumps over those, and then each
    stretch of states gives the next one of the same length."""
    state = np.array([(seed & MASK64) or 0x9E3779B97F4A7C15], np.uint64)
    for j in range(first.bit_length()):
        if first >> j & 1:
            state = _jump(_tables(j), state)
    out = np.empty(n, np.uint64)
    out[:1] = _next(state)[:n]
    done, j = 1, 0
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _jump(_tables(j), out[:more])
        done, j = done + more, j + 1
    return ((out * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5


def dithered(buffers: DataFrame, values: str, fmt: str, seed: Column, kind: str = "triangular", first: Column | None = None) -> DataFrame:
    """buffers, one a row, with their fractions as whole numbers of fmt: a draw (rectangular) or the sum of two
    (triangular) is added to each value before it is rounded, half away from zero, and clamped; none adds nothing. The
    draws of a buffer come one after the other from its seed (0: a fixed one). first: how many values of the buffer come
    before a row's own, so that a long buffer may be rows of ranges, which give the same numbers in any tasks. Null and
    NaN values take their draws and give null; a null array gives an empty one."""
    scale, each = SCALE[fmt], {"none": 0, "rectangular": 1, "triangular": 2}[kind]
    schema = buffers.withColumn(values, F.array().cast("array<bigint>")).schema

    def run(batches):
        for batch in batches:
            out = []
            for i, (start, before) in enumerate(zip(batch.column("__seed").to_pylist(), batch.column("__first").to_pylist())):
                own = batch.column(values)[i].values
                v = np.zeros(0) if own is None else own.cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = v * scale
                u = draws(start or 0, each * (before or 0), each * len(v)).reshape(len(v), each)
                for k in range(each):
                    x = x + u[:, k]
                x = np.clip(np.where(x >= 0, np.floor(x + 0.5), np.ceil(x - 0.5)), -scale, scale - 1)
                none = np.isnan(x)
                out.append(pa.array(np.where(none, 0, x).astype(np.int64) + (128 if fmt == "u8" else 0), mask=none))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32), pa.concat_arrays(out or [pa.array([], pa.int64())]))
            yield pa.RecordBatch.from_arrays([lists if c == values else batch.column(c) for c in schema.names], schema.names)

    return buffers.withColumns({"__seed": seed.cast("bigint"), "__first": (F.lit(0) if first is None else first).cast("bigint")}).mapInArrow(run, schema)
