"""The subframes of one FLAC frame: how each channel is predicted, and what the prediction leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FIELDS = (
    "channel int, result string, kind string, order int, wasted int, shift int, coefficients array<bigint>, warm array<bigint>, "
    "partitions array<struct<k:int,width:int,count:int>>, residuals array<bigint>"
)


class Broken(Exception):
    """Holds the result of a frame that can't be read."""


class Bits:
    """A frame's bits, with the place of the next 1 from every place on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        places = np.where(self.bits == 1, np.arange(self.end), self.end)
        self.one = [*np.minimum.accumulate(places[::-1])[::-1].tolist(), self.end]

    def take(self, n: int) -> int:
        first, self.at = self.at, self.at + n
        if self.at > self.end:
            raise Broken("CORRUPT")
        own = int.from_bytes(self.data[first >> 3 : self.at + 7 >> 3], "big")
        return own >> (-self.at & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        """How many 0s come before the next 1, which is passed."""
        one = self.one[min(self.at, self.end)]
        if one >= self.end:
            raise Broken("CORRUPT")
        n, self.at = one - self.at, one + 1
        return n

    def block(self, first: np.ndarray, n: int) -> np.ndarray:
        """The numbers of n bits that start at the places first."""
        if not n:
            return np.zeros(len(first), np.int64)
        own = self.bits[first[:, None] + np.arange(n)].astype(np.int64)
        return own @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))

    def row(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits, one behind the other."""
        if count <= 16:
            return np.array([self.signed(n) for _ in range(count)], np.int64)
        first = self.at + n * np.arange(count)
        self.at += n * count
        if self.at > self.end:
            raise Broken("CORRUPT")
        v = self.block(first, n)
        return np.where(v >> (n - 1) & 1, v - (1 << n), v) if n else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """count numbers of a Rice code: a chain over the places of the 1s, then all low bits at once."""
        if count > self.end - self.at:
            raise Broken("CORRUPT")
        ends, at, one, end = [0] * count, self.at, self.one, self.end
        tops = [0] * count
        for i in range(count):
            stop = one[at]
            tops[i] = stop - at
            at = stop + 1 + k
            if at > end:
                raise Broken("CORRUPT")
            ends[i] = at
        self.at = at
        value = np.array(tops, np.int64) << k
        if k:
            value |= self.block(np.array(ends, np.int64) - k, k)
        return value >> 1 ^ -(value & 1)


def residual(bits: Bits, block: int, order: int) -> tuple[list[tuple], np.ndarray]:
    """The partitions (k, or None and the width of plain numbers, and how many) and all their residuals."""
    method, split = bits.take(2), bits.take(4)
    if method > 1:
        raise Broken("UNSUPPORTED")
    each = block >> split
    if each << split != block or each < order:
        raise Broken("CORRUPT")
    size, plans, out = 4 + method, [], []
    for p in range(1 << split):
        count, k = each - order * (p == 0), bits.take(size)
        if k == (1 << size) - 1:
            width = bits.take(5)
            plans.append((None, width, count))
            out.append(bits.row(count, width))
        else:
            plans.append((k, None, count))
            out.append(bits.rice(count, k))
    return plans, np.concatenate(out) if len(out) > 1 else out[0]


def one(bits: Bits, block: int, depth: int) -> tuple:
    """kind to residuals of FIELDS for the next subframe."""
    if bits.take(1):
        raise Broken("CORRUPT")
    kind = bits.take(6)
    wasted = bits.zeros() + 1 if bits.take(1) else 0
    width = depth - wasted
    if width <= 0:
        raise Broken("CORRUPT")
    if kind < 2:
        return ("constant", "verbatim")[kind], 0, wasted, None, None, bits.row(block if kind else 1, width).tolist(), None, None
    lpc = kind >= 32
    if not lpc and not 8 <= kind <= 12:
        raise Broken("UNSUPPORTED")
    order = kind - 31 if lpc else kind - 8
    if order > block:
        raise Broken("CORRUPT")
    warm, shift, own = bits.row(order, width).tolist(), None, None
    if lpc:
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Broken("CORRUPT")
        own = bits.row(order, precision).tolist()
    plans, left = residual(bits, block, order)
    return "lpc" if lpc else "fixed", order, wasted, shift, own, warm, plans, left.tolist()


def subframes(data: bytes, block: int, assignment: int, depth: int, header: int) -> Iterator[tuple]:
    """Rows of FIELDS of a frame; one of the channel that can't be read, without fields, ends them."""
    bits = Bits(data[header : len(data) - 2])
    side = {8: 1, 9: 0, 10: 1}.get(assignment)
    channels = assignment + 1 if assignment < 8 else 2
    for channel in range(channels):
        try:
            got = one(bits, block, depth + (channel == side))
            if channel + 1 == channels and bits.at + 7 >> 3 != len(bits.data):
                raise Broken("CORRUPT")
        except Broken as broken:
            yield channel, str(broken), *[None] * 8
            return
        yield channel, "OK", *got


def rebuilt(kind: str, block: int, order: int, wasted: int, shift: int | None, coefficients, warm, residuals) -> np.ndarray:
    """A channel's samples: fixed predictors are sums of sums, others a recurrence over the frame."""
    if kind == "constant":
        out = np.full(block, warm[0], np.int64)
    elif kind == "verbatim":
        out = np.array(warm, np.int64)
    elif kind == "fixed":
        out = np.array(residuals, np.int64)
        for n in range(order, 0, -1):  # the difference of order n - 1 that the warm-up ends in, then its running sum
            start = np.diff(np.array(warm, np.int64), n - 1)[-1] if n > 1 else warm[-1]
            out = start + np.cumsum(out)
        out = np.concatenate([np.array(warm, np.int64), out])
    else:
        out = np.zeros(block, np.int64)
        out[:order] = warm
        turned = np.array(coefficients[::-1], np.int64)
        for i, r in enumerate(residuals, order):
            out[i] = (int(turned @ out[i - order : i]) >> shift) + r
    return out << wasted


def channels(data: bytes, block: int, assignment: int, depth: int, header: int) -> Iterator[tuple]:
    """One row of the samples of each channel of a frame, as it carries them; none if a channel can't be read."""
    out = []
    for _, result, kind, order, wasted, shift, coefficients, warm, _, residuals in subframes(data, block, assignment, depth, header):
        if result != "OK":
            return
        out.append(rebuilt(kind, block, order, wasted, shift, coefficients, warm, residuals).tolist())
    yield (out,)
