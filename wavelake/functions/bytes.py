"""Numbers and texts in bytes, as Columns. Places count from 0; where the bytes end before the number does, it is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def part(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from a place on; fewer where the data end."""
    lit = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x)
    return F.substring(data, lit(at) + 1, lit(n))


def be(data: Column, at: Column | int, n: int) -> Column:
    """An unsigned big-endian number of up to seven bytes."""
    own = part(data, at, n)
    return F.when(F.length(own) == n, F.conv(F.hex(own), 16, 10).cast("bigint"))


def le(data: Column, at: Column | int, n: int) -> Column:
    """An unsigned little-endian number of up to seven bytes."""
    h = F.hex(part(data, at, n))
    turned = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("bigint"))


def u8(data: Column, at: Column | int) -> Column:
    return be(data, at, 1)


def le64(data: Column, at: int) -> Column:
    """A little-endian number of eight bytes, as a signed long."""
    return F.shiftleft(le(data, at + 4, 4), 32).bitwiseOR(le(data, at, 4))


def signed(value: Column, bits: int) -> Column:
    """An unsigned number read as two's complement."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def syncsafe(data: Column, at: int) -> Column:
    """Four bytes of seven bits each; null if one has its top bit set."""
    b = [u8(data, at + k) for k in range(4)]
    return F.when((b[0] < 128) & (b[1] < 128) & (b[2] < 128) & (b[3] < 128), b[0] * (1 << 21) + b[1] * (1 << 14) + b[2] * 128 + b[3])


def real(value: Column, exponent_bits: int, fraction_bits: int) -> Column:
    """An IEEE number from its bits (32 or 64, the latter as a signed long); NaN and the infinities are null."""
    top = (1 << exponent_bits) - 1
    sign = F.when(F.shiftrightunsigned(value, exponent_bits + fraction_bits).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    e = F.shiftrightunsigned(value, fraction_bits).bitwiseAND(top)
    m = value.bitwiseAND((1 << fraction_bits) - 1) / F.lit(float(1 << fraction_bits))
    bias = top // 2
    return F.when(e == top, None).when(e == 0, sign * m * F.pow(F.lit(2.0), F.lit(1 - bias))).otherwise(sign * (1 + m) * F.pow(F.lit(2.0), e - bias))


def extended(data: Column, at: int) -> Column:
    """A big-endian 80-bit number; 0 for NaN and the infinities."""
    e = be(data, at, 2)
    power = e.bitwiseAND(0x7FFF) - 16383
    size = be(data, at + 2, 4) * F.pow(F.lit(2.0), power - 31) + be(data, at + 6, 4) * F.pow(F.lit(2.0), power - 63)
    return F.when(e.bitwiseAND(0x7FFF) == 0x7FFF, 0.0).when(e >= 0x8000, -size).otherwise(size)


def le_bytes(value: Column, n: int) -> Column:
    """A number as n little-endian bytes, negative ones as two's complement."""
    h = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(n)]))


def be_bytes(value: Column, n: int) -> Column:
    """A number as n big-endian bytes, negative ones as two's complement."""
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * n, 2 * n))


def extended_bytes(rate: Column) -> Column:
    """A whole number of 1 to 2**32 - 1 as a big-endian 80-bit number."""
    e = F.floor(F.log2(rate.cast("double")) + 1e-12).cast("bigint")
    return F.concat(be_bytes(e + 16383, 2), be_bytes(F.floor(rate * F.pow(F.lit(2.0), 31 - e)), 4), F.unhex(F.lit("00000000")))


def joined(pieces: Column) -> Column:
    """The bytes of an array of byte strings, one after the other."""
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


def latin1(data: Column) -> Column:
    """Text up to the first NUL, a byte a character."""
    return F.substring_index(F.decode(data, "ISO-8859-1"), "\x00", 1)


def latin1_or_utf8(data: Column) -> Column:
    """UTF-8 where the bytes are that, else a byte a character."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


def crc(data: Column, bits: int, polynomial: int) -> Column:
    """The checksum of few bytes from 0, most significant bit first, a bit at a time; 0 for none."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1

    def step(c: Column, at: Column) -> Column:
        own = F.conv(F.hex(F.substring(data, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.floor(own / F.pow(F.lit(2.0), 7 - at % 8)).cast("int") % 2
        odd = (c >= top).cast("int") != bit
        moved = (c * 2).bitwiseAND(mask)
        return F.when(odd, moved.bitwiseXOR(F.lit(polynomial))).otherwise(moved).cast("int")

    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) * 8 - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), step)
