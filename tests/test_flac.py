"""The frame index against frames written here bit by bit, in ranges of several sizes."""

import numpy as np
import pytest

from wavelake.operators import flac
from wavelake.sources import flac_frames as src
from wavelake.sources import flac_subframes as sub


def slow_crc(data, bits, poly):
    c = 0
    for b in data:
        for i in range(7, -1, -1):
            odd = (c >> (bits - 1) & 1) != (b >> i & 1)
            c = (c << 1 & (1 << bits) - 1) ^ (poly if odd else 0)
    return c


def coded(n):
    if n < 128:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([0xFF << (7 - len(tail)) & 0xFF | n, *reversed(tail)])


def frame(number, size, body, variable=False, rate=b""):
    head = bytes([0xFF, 0xF8 | variable, 0x70 | (13 if rate else 0), 0x08]) + coded(number) + (size - 1).to_bytes(2, "big") + rate
    head += bytes([slow_crc(head, 8, 7)])
    return head + body + slow_crc(head + body, 16, 0x8005).to_bytes(2, "big")


def sound(seed, n, variable=False):
    """n frames of noise, each holding a header that isn't one, and where they start."""
    rng = np.random.default_rng(seed)
    out, places, at = b"fLaC" + bytes(70), [], 0
    for i in range(n):
        size = int(rng.integers(1000, 9000)) if variable else 4000 if i + 1 < n else 77
        trap = frame(i + 1, size, b"", variable)[:-2]
        f = frame(at if variable else i, size, rng.bytes(int(rng.integers(0, 9000))) + trap + rng.bytes(int(rng.integers(0, 9000))), variable, b"\x2b\x11" if i % 2 else b"")
        places.append((len(out), len(f), at, size))
        out += f
        at += size
    return out, places


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["k"], []).append((r["offset"], r["length"], r["first_sample"], r["block_size"]))
    return {k: sorted(v) for k, v in got.items()}


def test_checksums():
    data = np.random.default_rng(1).bytes(300)
    assert src.crc16(data) == slow_crc(data, 16, 0x8005) and src.crc8(data) == slow_crc(data, 8, 7)
    first, last, all_ = (src.marks(data, [p])[0] for p in (17, 299, 300))
    assert src.moved(np.array([src.crc16(data)], np.uint16), np.array([300]))[0] == all_
    whole = data[:17] + frame(3, 9, b"x" * 70)
    assert src.marks(whole, [17])[0] == src.marks(whole, [len(whole)])[0] and first != last


@pytest.mark.parametrize("number", [0, 127, 128, 2047, 2048, 65_535, 65_536, 1 << 26, (1 << 31) - 1, 1 << 31, (1 << 36) - 1])
def test_coded_numbers(number):
    assert src.header(frame(number, 5, b"", True)[:-2]) == (True, number, 5, None, 0, 16, len(frame(number, 5, b"")) - 2)


def test_reserved_values_are_no_header():
    good = frame(1, 5, b"")[:-2]
    for at, bits in ((0, 1), (1, 2), (2, 0x70), (2, 15), (3, 0xB0), (3, 1), (3, 0x0E), (4, 0x80)):
        bad = bytearray(good)
        bad[at] = bad[at] ^ bits if at != 3 or bits == 1 else bits if bits != 0x0E else 0x06
        bad[-1] = slow_crc(bytes(bad[:-1]), 8, 7)
        assert src.header(bytes(bad)) is None, (at, bits)
    assert src.header(good[:-1]) is None and src.header(b"") is None


def test_same_frames_in_all_ranges(spark, tmp_path):
    fixed, a = sound(2, 12)
    variable, b = sound(3, 12, True)
    hurt = bytearray(fixed)
    hurt[a[4][0] + 40] ^= 1
    rows = [("fixed", fixed), ("variable", variable), ("hurt", bytes(hurt)), ("cut", fixed[:-5]), ("none", None), ("empty", b""), ("text", b"no sound")]
    want = {"fixed": a, "variable": b, "hurt": a[:4] + a[5:], "cut": a[:-1]}
    files = spark.createDataFrame(rows, "k string, content binary")
    for span in (src.ORDER, 2 * src.ORDER, flac.SPAN):
        assert found(flac.frame_index(files, "k", span=span)) == want
    for k, v in rows[:4]:
        (tmp_path / k).write_bytes(v)
    paths = spark.createDataFrame([(k, str(tmp_path / k), len(v)) for k, v in rows[:4]], "k string, path string, length bigint")
    assert found(flac.frame_index(paths, "k", None, span=src.ORDER)) == want
    with pytest.raises(ValueError):
        flac.frame_index(files, "k", span=65_536)


def test_seek_lands_on_the_frame(spark):
    data, places = sound(4, 6, True)
    frames = flac.frame_index(spark.createDataFrame([("x", data)], "k string, content binary"), "k")
    samples = [0, 1, *[p[2] - 1 for p in places[1:]], *[p[2] for p in places[1:]], places[-1][2] + places[-1][3] - 1, places[-1][2] + places[-1][3]]
    got = flac.seek_frame(spark.createDataFrame([("x", s) for s in samples], "k string, sample bigint"), frames, "k").collect()
    assert len(got) == len(samples)
    for r in got:
        offset, _, first, size = max(p for p in places if p[2] <= r["sample"])
        assert (r["offset"], r["skip"], r["found"]) == (offset, r["sample"] - first, r["sample"] < first + size)


def rice(values, split, plan, order, method=0):
    """The bits of a residual; plan: for each partition k, or (width,) of plain numbers."""
    out, each = f"{method:02b}{split:04b}", (len(values) + order) >> split
    cuts = [0, *[each * (p + 1) - order for p in range(1 << split)]]
    for p, k in enumerate(plan):
        own = values[cuts[p] : cuts[p + 1]]
        if isinstance(k, tuple):
            out += "1" * (4 + method) + f"{k[0]:05b}" + "".join(f"{v % (1 << k[0]):0{k[0]}b}" for v in own if k[0])
        else:
            out += f"{k:0{4 + method}b}"
            for v in own:
                z = 2 * v if v >= 0 else -2 * v - 1
                out += "0" * (z >> k) + "1" + (f"{z % (1 << k):0{k}b}" if k else "")
    return out


def predicted(x, order, coefficients, shift):
    return [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, len(x))]


FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def subframe(x, depth, kind, split=0, plan=None, wasted=0, coefficients=None, shift=0, method=0):
    x, width = [v >> wasted for v in x], depth - wasted
    plain = lambda vs, n: "".join(f"{v % (1 << n):0{n}b}" for v in vs)
    head = lambda code: f"0{code:06b}" + (f"1{'0' * (wasted - 1)}1" if wasted else "0")
    if kind == "constant":
        return head(0) + plain(x[:1], width)
    if kind == "verbatim":
        return head(1) + plain(x, width)
    lpc = coefficients is not None
    own = coefficients if lpc else FIXED[kind]
    n = len(own)
    middle = f"{11:04b}{shift:05b}" + plain(own, 12) if lpc else ""
    left = predicted(x, n, own, shift)
    return head(31 + n if lpc else 8 + n) + plain(x[:n], width) + middle + rice(left, split, plan or [6] * (1 << split), n, method)


def packed(bits):
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def cases():
    rng = np.random.default_rng(7)
    wave = [int(v) for v in 900 * np.sin(np.arange(512) / 9) + rng.integers(-20, 20, 512)]
    other = [int(v) for v in 700 * np.cos(np.arange(512) / 7) + rng.integers(-20, 20, 512)]
    for order in range(5):
        yield 0, [wave], [subframe(wave, 16, order, split=order, plan=[5 + p % 3 for p in range(1 << order)])]
    for split in range(9):
        yield 0, [wave], [subframe(wave, 16, 1, split=split, method=split % 2)]
    for n in (1, 2, 8, 12, 13, 32):
        own = [int(v) for v in rng.integers(-300, 300, n)]
        yield 0, [wave], [subframe(wave, 16, None, coefficients=own, shift=9, plan=[9])]
    flat = [-32768] * 512
    yield 0, [flat], [subframe(flat, 16, "constant")]
    yield 0, [flat], [subframe(flat, 16, 1, plan=[(0,)])]
    yield 0, [wave], [subframe(wave, 16, "verbatim")]
    yield 0, [wave], [subframe(wave, 16, 2, split=2, plan=[4, (13,), 0, (14,)])]
    coarse = [v << 3 for v in wave]
    yield 0, [coarse], [subframe(coarse, 16, 2, wasted=3)]
    yield 0, [coarse], [subframe(coarse, 16, "verbatim", wasted=3)]
    yield 2, [wave, other, flat], [subframe(wave, 16, 2), subframe(other, 16, 3), subframe(flat, 16, "constant")]
    side = [a - b for a, b in zip(wave, other)]
    mid = [(a + b) >> 1 for a, b in zip(wave, other)]
    yield 8, [wave, other], [subframe(wave, 16, 2), subframe(side, 17, 2)]
    yield 9, [wave, other], [subframe(side, 17, 2), subframe(other, 16, "verbatim")]
    yield 10, [wave, other], [subframe(mid, 16, 4), subframe(side, 17, "verbatim")]


def test_subframes_come_back(spark):
    rows, want = [], {}
    for i, (assignment, channels, bits) in enumerate(cases()):
        head = bytes([0xFF, 0xF8, 0x70, assignment << 4 | 8, 0]) + (511).to_bytes(2, "big")
        head += bytes([slow_crc(head, 8, 7)])
        f = head + packed("".join(bits))
        rows.append((i, b"fLaC" + f + slow_crc(f, 16, 0x8005).to_bytes(2, "big")))
        want |= {(i, n, ch): v for ch, x in enumerate(channels) for n, v in enumerate(x)}
    files = spark.createDataFrame(rows, "k int, content binary")
    frames = flac.frame_data(files, flac.frame_index(files, "k"), "k")
    parts = flac.subframes(frames, "k").cache()
    assert parts.where("result <> 'OK'").count() == 0
    assert {len(r.partitions) for r in parts.where("partitions IS NOT NULL").collect()} == {1 << n for n in range(9)}
    got = {(r.k, r.frame, r.ch): r.v for r in flac.frame_samples(flac.channel_samples(parts), "k").collect()}
    assert got == want


def test_broken_frames_say_so():
    results = lambda bits, **more: [r[1] for r in sub.subframes(packed(bits) + bytes(2), **{"block": 16, "assignment": 0, "depth": 16, "header": 0, **more})]
    good = subframe(list(range(16)), 16, 1)
    assert results(good) == ["OK"] and results("1" + good[1:]) == ["CORRUPT"]
    assert results("0" + f"{2:06b}" + good[7:]) == ["UNSUPPORTED"] and results("0" + f"{13:06b}" + good[7:]) == ["UNSUPPORTED"]
    assert results(good[:40]) == ["CORRUPT"] and results(good + "0" * 16) == ["CORRUPT"] and results("") == ["CORRUPT"]
    assert results(good[:24] + "10" + good[26:]) == ["UNSUPPORTED"]  # a coding of the residual to come
    assert results(good[:26] + "0101" + good[30:]) == ["CORRUPT"]  # 16 samples are not 32 partitions
    assert results("0" * 7 + "1" + "0" * 15 + "1" + "1") == ["CORRUPT"]  # all bits wasted
    assert results(good, assignment=1) == ["OK", "CORRUPT"]


def slow_plan(r, order, most=8):
    """The bits, order, method and partitions of a block by the rule said partition by partition."""
    best, n = None, len(r)
    for o in range(most + 1):
        each = n >> o
        if n % (1 << o) or each <= order:
            continue
        for method, (size, limit) in enumerate(((4, 14), (5, 30))):
            bits, own = 6, []
            for p in range(1 << o):
                part = r[max(p * each, order) : (p + 1) * each]
                z = [2 * v if v >= 0 else -2 * v - 1 for v in part]
                guess = min((sum(z) // len(z)).bit_length(), limit)
                cost, k = min((sum((v >> k) + 1 + k for v in z), k) for k in range(max(guess - 2, 0), min(guess + 2, limit) + 1))
                width = 1 + max(v >> 1 for v in z).bit_length() if any(z) else 0
                plain = 5 + len(z) * width
                own.append((None, width) if width <= 32 and plain < cost else (k, None))
                bits += size + min(cost, plain if width <= 32 else cost)
            if best is None or bits < best[0]:
                best = (bits, o, method, own)
    return best


def test_residual_plans_are_the_cheapest(spark):
    from wavelake.operators import predict

    rng = np.random.default_rng(11)
    kinds = [
        [int(v) for v in rng.integers(-40, 40, 700)],
        [0] * 300,
        [int(v) << int(s) for v, s in zip(rng.integers(-3, 4, 1024), np.repeat([0, 6, 2, 20], 256))],
        [(-1) ** i * (1 << 33) for i in range(64)],
        [1, 2],
        [7],
        [-1] * 512,
    ]
    rows = [(t, i, v) for t, r in enumerate(kinds) for i, v in enumerate(r)]
    got = predict.residual_plan(spark.createDataFrame(rows, "track int, frame bigint, r bigint"), 2, 512).collect()
    want = {(t, b): slow_plan(r[b * 512 : b * 512 + 512], 2) for t, r in enumerate(kinds) for b in range(-(-len(r) // 512))}
    assert {(g.track, g.block): (g.bits, g.partition_order, g.method, [tuple(p) for p in g.partitions]) for g in got} == {k: v for k, v in want.items() if v}
