"""Where FLAC frames may start, found in byte ranges that know nothing of each other.

A frame ends in a CRC-16 that makes the checksum of the whole frame 0. x can be inverted modulo its polynomial, so a
prefix checksum times x ** (-8 * place), called the mark of a place, is equal at both ends of just those stretches whose
checksum is 0. Marks are XORs of what each byte adds; those of ranges are added up elsewhere. x has order 32767, so ranges
of a multiple of 32767 bytes need no correction for where they start."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import xor

import numpy as np

ORDER = 32_767
POLYNOMIAL = 0x8005
#: Bytes that a frame header may take behind the end of a range.
HALO = 16
ROW = 64
FIELDS = "place bigint, mark int, variable boolean, number bigint, block_size int, sample_rate int, assignment int, depth int, header int"

# fixed values of the format: rates by code 1 to 11, depths by code 1 to 7 (3 is reserved)
RATES = [88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
DEPTHS = [8, 12, None, 16, 20, 24, 32]


def _powers() -> np.ndarray:
    """x ** j modulo the polynomial, for every j below the order."""
    out, v = np.empty(ORDER, np.uint16), 1
    for j in range(ORDER):
        out[j] = v
        v = (v << 1 & 0xFFFF) ^ (POLYNOMIAL if v & 0x8000 else 0)
    return out


POWERS = _powers()
#: What a byte b that leaves the register does: b * x ** 16.
LEAVING = np.array([reduce(xor, [int(POWERS[16 + i]) for i in range(8) if b >> i & 1], 0) for b in range(256)], np.uint16)

# the same as plain numbers, for bytes that are few
_POWERS, _LEAVING = POWERS.tolist(), LEAVING.tolist()
CRC8 = [reduce(lambda c, _: (c << 1 & 0xFF) ^ (7 if c & 0x80 else 0), range(8), b) for b in range(256)]
#: Up to how many bytes going through them one by one is faster than row by row.
SHORT = 1024


def moved_one(value: int, place: int) -> int:
    """value times x ** (-8 * place)."""
    at, out = -8 * place, 0
    while value:
        if value & 1:
            out ^= _POWERS[at % ORDER]
        value, at = value >> 1, at + 1
    return out


def moved(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each value times x ** (-8 * its place)."""
    at = -8 * places.astype(np.int64) % ORDER
    out = np.zeros(len(values), np.uint16)
    for i in range(16):
        out ^= np.where(values >> i & 1, POWERS[(at + i) % ORDER], 0).astype(np.uint16)
    return out


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _LEAVING[c >> 8 ^ b]
    return c


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def header(b: bytes) -> tuple | None:
    """(variable, number, block_size, sample_rate, assignment, depth, header bytes) if a frame header starts here: all its
    reserved values are unused and its CRC-8 is right. Rate and depth are None where STREAMINFO has them."""
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8:
        return None
    size, rate, assignment, depth = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
    if size == 0 or rate == 15 or assignment > 10 or depth == 3 or b[3] & 1:
        return None
    more = max(8 - (b[4] ^ 0xFF).bit_length(), 0)  # leading ones
    if more == 1 or more == 8 or len(b) < 4 + max(more, 1):
        return None
    number = b[4] & (0x7F >> more)
    for x in b[5 : 4 + more]:
        if x & 0xC0 != 0x80:
            return None
        number = number << 6 | x & 0x3F
    at = 4 + max(more, 1)
    extra = {6: 1, 7: 2}.get(size, 0)
    rated = {12: 1, 13: 2, 14: 2}.get(rate, 0)
    end = at + extra + rated
    if len(b) <= end or crc8(b[:end]) != b[end]:
        return None
    own = int.from_bytes(b[at : at + extra], "big") + 1 if extra else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    hertz = int.from_bytes(b[at + extra : end], "big") * {12: 1000, 13: 1, 14: 10}[rate] if rated else RATES[rate - 1] if rate else None
    return bool(b[1] & 1), number, own, hertz, assignment, DEPTHS[depth - 1] if depth else None, end + 1


def marks(own: bytes, places: list[int]) -> list[int]:
    """What the bytes before each place add to its mark. Places ascend."""
    if len(own) <= SHORT:
        c, at, out = 0, 0, []
        for p in places:
            for b in own[at:p]:
                c = (c << 8 & 0xFFFF) ^ _LEAVING[c >> 8 ^ b]
            at = p
            out.append(moved_one(c, p))
        return out
    whole = len(own) // ROW
    grid = np.frombuffer(own, np.uint8, whole * ROW).reshape(whole, ROW)
    state = np.zeros(whole, np.uint16)
    for i in range(ROW):  # all rows side by side
        state = (state << 8) ^ LEAVING[(state >> 8) ^ grid[:, i]]
    upto = np.concatenate([np.zeros(1, np.uint16), np.bitwise_xor.accumulate(moved(state, np.arange(1, whole + 1) * ROW))])
    out = []
    for p in places:
        row = min(p // ROW, whole)
        out.append(int(upto[row]) ^ moved_one(crc16(own[row * ROW : p]), p))
    return out


def candidates(data: bytes, span: int) -> Iterator[tuple]:
    """Rows of FIELDS for the headers that start in the first span bytes of data, and one without a header for its end.
    Places count from the start of data."""
    own = data[:span]
    b = np.frombuffer(data, np.uint8)
    places, found = [], []
    for p in np.flatnonzero((b[:-1] == 0xFF) & (b[1:] & 0xFE == 0xF8)).tolist() if len(b) > 1 else ():
        if p < len(own) and (h := header(data[p : p + HALO])):
            places.append(p)
            found.append(h)
    got = marks(own, [*places, len(own)])
    for p, m, h in zip(places, got, found):
        yield p, m, *h
    yield len(own), got[-1], *[None] * 7
