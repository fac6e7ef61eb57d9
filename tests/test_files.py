"""Files built byte by byte, and decoders in plain Python, against the readers; odd rows of the core operators."""

import io
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import bytes as by
from wavelake.functions import headers, samples
from wavelake.functions.lookups import IMA_MOVES, IMA_STEPS, MS_FACTORS, MS_PAIRS
from wavelake.operators import adpcm, containers, predict, probe, ranges, seek, tagbytes
from wavelake.sources import files as src


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def chunk(name, data, order="<"):
    return name + struct.pack(order + "I", len(data)) + data + b"\0" * (len(data) % 2)


def wav(fmt, data, *more):
    body = b"WAVE" + chunk(b"fmt ", fmt) + b"".join(more) + chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_scan_and_open(spark, tmp_path):
    fmt = lambda tag, c, rate, align, bits: struct.pack("<HHIIHH", tag, c, rate, rate * align, align, bits)
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setparams((2, 2, 22050, 0, "NONE", ""))
        w.writeframes(struct.pack("<6h", 1, -1, 2, -2, 32767, -32768))
    ima = struct.pack("<HH", 2, 505)
    cases = {
        "a": (buffer.getvalue(), ("OK", "s16", "pcm", 2, 22050, 3)),
        "b": (wav(fmt(3, 1, 8000, 4, 32), b"\0" * 10), ("OK", "f32", "pcm", 1, 8000, 2)),
        "c": (wav(fmt(1, 1, 8000, 2, 12), b"\0" * 10), ("UNSUPPORTED", None, None, None, None, None)),
        "d": (wav(fmt(1, 0, 8000, 2, 16), b""), ("CORRUPT", None, None, None, None, None)),
        "e": (wav(fmt(17, 1, 8000, 256, 4) + ima, b"\0" * 600, chunk(b"fact", struct.pack("<I", 1100))), ("OK", "s16", "ima-wav", 1, 8000, 1100)),
        "f": (wav(fmt(17, 1, 8000, 256, 4) + struct.pack("<HH", 2, 500), b"\0" * 600), ("CORRUPT", None, None, None, None, None)),
        "g": (wav(fmt(7, 2, 8000, 2, 8), b"\0" * 9), ("OK", "s16", "ulaw", 2, 8000, 4)),
        "h": (b"RIFF\0\0\0\0WAVE", ("CORRUPT", None, None, None, None, None)),
        "i": (None, None),
        "j": (b"", None),
    }
    files = frame(spark, [(k, v[0]) for k, v in cases.items()], "name string, content binary")
    got = {r.name: (r.result, r.format, r.coding, r.channels, r.sample_rate, r.frames) for r in containers.wav_scan(files, ["name"]).collect()}
    assert got == {k: want for k, (_, want) in cases.items() if want}
    for k in "ab":
        (tmp_path / f"{k}.wav").write_bytes(cases[k][0])
    opened = src.open_files(spark, f"file://{tmp_path}/*.wav")
    assert opened.count() == 2 and {r.frames for r in containers.wav_scan(opened, ["path"]).collect()} == {3, 2}
    assert containers.wav_scan(files.limit(0), ["name"]).count() == 0


def test_written_wav_is_read_by_another_reader(spark):
    row = frame(spark, [([1, -2, 300, -32768],)], "x array<long>")
    data = row.select(containers.wav_bytes("s16", F.lit(2), F.lit(44100), containers.sample_bytes(F.col("x"), 2)).alias("b"), containers.wav_bytes("s8", F.lit(1), F.lit(1), F.lit(b"")).alias("no")).first()
    with wave.open(io.BytesIO(bytes(data.b))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (2, 2, 44100, 2)
        assert struct.unpack("<4h", w.readframes(2)) == (1, -2, 300, -32768)
    assert data.no is None


def test_floats_and_extended_numbers(spark):
    values = [0.0, 1.0, -1.5, 1e-40, 3.25e20, 44100.0]
    d = frame(spark, [(struct.pack("<6f", *values), struct.pack(">6d", *values))], "f binary, d binary")
    got = [r.v for r in containers.pcm_samples(d.select("f"), "f", "f32", F.lit(1)).orderBy("frame").collect()]
    assert all(math.isclose(g, struct.unpack("<f", struct.pack("<f", v))[0], rel_tol=1e-12) for g, v in zip(got, values))
    assert [r.v for r in containers.pcm_samples(d.select("d"), "d", "f64", F.lit(2), big=True).orderBy("frame", "ch").collect()] == values
    ext = frame(spark, [(bytes.fromhex("400EAC44000000000000"),), (bytes.fromhex("7FFF0000000000000000"),)], "b binary")
    assert [r[0] for r in ext.select(by.extended(F.col("b"), 0)).collect()] == [44100.0, 0.0]
    assert bytes(spark.range(1).select(by.extended_bytes(F.lit(44100)).alias("b")).first().b).hex().upper() == "400EAC44000000000000"


def ima(nibbles, p, i):
    out = []
    for n in nibbles:
        s = IMA_STEPS[i]
        d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
        p = max(-32768, min(32767, p - d if n & 8 else p + d))
        i = max(0, min(88, i + IMA_MOVES[n & 7]))
        out.append(p)
    return out


def test_coded_blocks_match_plain_python(spark):
    r = random.Random(9)
    for c in (1, 2):
        block = bytes(r.randrange(256) for _ in range(70 * c - 3))
        df = frame(spark, [(1, block, c), (2, b"", c), (3, block[:3], c), (4, None, c)], "id int, block binary, channels int")
        turns = (len(block) - 4 * c) // (4 * c)
        got = {(x.ch, x.frame): x.x for x in adpcm.ima_wav_block(df).where("id = 1").collect()}
        for ch in range(c):
            p = struct.unpack_from("<h", block, 4 * ch)[0]
            own = [b for g in range(turns) for b in block[4 * c + (g * c + ch) * 4 :][:4]]
            want = [p, *ima([n for b in own for n in (b & 15, b >> 4)], p, min(block[4 * ch + 2], 88))]
            assert [got[ch, k] for k in range(len(want))] == want and len(got) == c * len(want)
        got = {(x.ch, x.frame): x.x for x in adpcm.ima_qt_block(df).where("id = 1").collect()}
        for ch in range(c):
            w = block[34 * ch] << 8 | block[34 * ch + 1]
            p = (w & 0xFF80) - (65536 if w & 0x8000 else 0)
            want = ima([n for b in block[34 * ch + 2 : 34 * ch + 34] for n in (b & 15, b >> 4)], p, min(w & 127, 88))
            assert [got[ch, k] for k in range(64)] == want
        ms = bytes([*[k % 7 for k in range(c)], *block[c:]])
        got = {(x.ch, x.frame): x.x for x in adpcm.ms_block(df.where("id = 1").withColumn("block", F.lit(ms))).collect()}
        h = struct.unpack_from(f"<{3 * c}h", ms, c)
        state = [[MS_PAIRS[ms[k]], h[k], h[c + k], h[2 * c + k], [h[2 * c + k], h[c + k]]] for k in range(c)]
        nibbles = [n for b in ms[7 * c :] for n in (b >> 4, b & 15)]
        for k, n in enumerate(nibbles[: len(nibbles) // c * c]):
            s = state[k % c]
            (a, b_), d, s1, s2, out = s
            x = max(-32768, min(32767, int((s1 * a + s2 * b_) / 256) + (n - 16 if n > 7 else n) * d))
            s[1:4] = min(adpcm.MOST_DELTA, max(16, int(MS_FACTORS[n] * d / 256))), x, s1
            out.append(x)
        for ch in range(c):
            assert [got[ch, k] for k in range(len(state[ch][4]))] == state[ch][4]
        assert adpcm.ms_block(df.where("id = 1").withColumn("block", F.lit(b"\x07" * 70))).count() == 0  # no such pair


def test_dither_matches_plain_python(spark):
    values, m = [0.1, -0.7, 0.0, 0.99999, -1.0], (1 << 64) - 1
    df = frame(spark, [(7, values), (0, values), (1, []), (2, None)], "seed long, v array<double>")
    got = {r.seed: r.v for r in samples.dithered(df, "v", "s16", F.col("seed")).collect()}
    for seed in (7, 0):
        s, want = seed or 0x9E3779B97F4A7C15, []
        for v in values:
            x = v * 32768
            for _ in range(2):
                s ^= s >> 12
                s ^= (s << 25) & m
                s ^= s >> 27
                x += ((s * 0x2545F4914F6CDD1D & m) >> 11) / 2.0**53 - 0.5
            want.append(min(32767, max(-32768, math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5))))
        assert got[seed] == want
    assert got[1] == got[2] == []


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
    return c


def test_ogg_pages_and_packets(spark):
    r = random.Random(3)
    assert all(src.ogg_crc(d) == slow_crc(d) for d in (bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 27, 300)))
    packets = [(bytes(r.randrange(256) for _ in range(n)), k * 10) for k, n in enumerate((30, 0, 255, 255 * 255, 70_000, 12))]
    one, two = src.ogg_stream(5, packets), src.ogg_stream(9, [(b"x" * 600, 3)])
    broken = bytearray(one)
    broken[40] ^= 1  # the first page's checksum no longer holds
    files = frame(spark, [("a", b"OggS junk" + one + two), ("b", bytes(broken)), ("c", None), ("d", b"OggS")], "name string, content binary")
    got = src.ogg_packet_rows(files).collect()
    own = sorted([(x.packet, bytes(x.data)) for x in got if x.name == "a" and x.serial == 5])
    assert own == [(k, p) for k, (p, _) in enumerate(packets)]
    assert [bytes(x.data) for x in got if x.name == "a" and x.serial == 9] == [b"x" * 600]
    assert len([x for x in got if x.name == "b"]) == len(packets) - 1
    pages = src.ogg_page_rows(files).where("name = 'a'")
    assert [(x.serial, x.offset) for x in containers.logical_streams(pages, ["name"]).collect()] == [(5, 9)]


def test_mpeg_search(spark):
    f = b"\xff\xfb\x90\x00" + bytes(413)
    tag = b"ID3\x04\0\0\0\0\0\x05hello"
    assert src.mpeg_confidence(f * 4) == src.mpeg_confidence(tag + f * 3) == 100
    assert src.mpeg_confidence(b"junk" + f * 3) == 75 and src.mpeg_confidence(f * 2) == 25 and src.mpeg_confidence(b"junk" + f * 2) == 0
    assert src.mpeg_confidence(b"\xff\xfb\x00\x00" + bytes(100)) == 75 and src.mpeg_confidence(None) == src.mpeg_confidence(b"") == 0
    assert src.mpeg_frame(bytes.fromhex("FFE5EA00"), 0) is None  # longer than a frame may be
    xing = b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">III", 3, 5, 9999) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    xing += bytes(417 - len(xing))
    rows = containers.mpeg_scan(frame(spark, [("a", xing + f * 5), ("b", f * 3), ("c", b"none")], "name string, content binary"), ["name"])
    got = {r.name: (r.source, r.frames, r.delay, r.padding) for r in rows.collect()}
    assert got == {"a": ("stated", 5 * 1152, 1105, 471), "b": ("counted", 3456, None, None)}
    kinds = {r.name: (r.codec, r.confidence) for r in probe.identify(frame(spark, [("m", f * 6), ("n", None), ("o", b"")], "name string, content binary")).collect()}
    assert kinds == {"m": ("mp3", 100), "n": (None, 0), "o": (None, 0)}


def test_id3_tags(spark):
    def f23(name, data):
        return name + struct.pack(">IH", len(data), 0) + data

    body = f23(b"TIT2", b"\x01\xff\xfe" + "Tïtle".encode("utf-16-le")) + f23(b"TCON", b"\0(17)(4)Own") + f23(b"TRCK", b"\x004/12") + f23(b"COMM", b"\0engwhat\0said") + f23(b"TXXX", b"\x03MOOD\0calm")
    body += f23(b"APIC", b"\0image/png\0\x03front\0" + b"PNGDATA") + f23(b"PRIV", b"raw") + bytes(20)
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body
    files = frame(spark, [("a", tag), ("b", b"ID3\x03\0\0\xff\0\0\0"), ("c", None)], "name string, content binary")
    got = {(r.tag or r.key, r.value) for r in tagbytes.id3v2(spark, files).collect()}
    assert got == {("title", "Tïtle"), ("genre", "Own"), ("tracknumber", "4"), ("tracktotal", "12"), ("comment", "said"), ("TXXX", "calm")}
    p = tagbytes.pictures(files).first()
    assert (p.mime, p.kind, p.description, bytes(p.data)) == ("image/png", 3, "front", b"PNGDATA")
    v22 = b"ID3\x02\0\0\0\0\0\x0c" + b"TT2" + b"\0\0\x06" + b"\0Hello"
    assert [(r.tag, r.value) for r in tagbytes.id3v2(spark, frame(spark, [(v22,)], "content binary")).collect()] == [("title", "Hello")]


def test_flac_blocks_and_pictures(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D") + b"IHDR" + struct.pack(">II", 7, 9)
    pic = lambda w, h, d: struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 2) + b"hi" + struct.pack(">IIIII", w, h, 24, 0, len(d)) + d
    rows = [(0, pic(7, 9, png)), (1, pic(7, 8, png)), (2, pic(0, 0, b"x")), (3, pic(1, 1, b"x")), (4, pic(7, 9, png)[:-1])]
    f = containers.picture(F.col("b"))
    got = frame(spark, rows, "id int, b binary").select("id", containers.picture_status(f["width"], f["height"], f["data"]).alias("s"), f["mime"].alias("mime"))
    got = {r.id: (r.s, r.mime) for r in got.collect()}
    assert got == {0: ("VERIFIED", "image/png"), 1: ("MISMATCH", "image/png"), 2: ("NOT_STATED", "image/png"), 3: ("MISMATCH", "image/png"), 4: ("MISMATCH", None)}
    track = bytes(35) + b"\x02" + bytes(24)
    sheets = frame(spark, [(bytes(395) + b"\x02" + track + track,), (bytes(395) + b"\x02" + track,), (bytes(10),), (None,)], "b binary")
    assert [r[0] for r in sheets.select(containers.cuesheet_ok(F.col("b"))).collect()] == [True, False, False, False]


def test_opus_packets(spark):
    vbr = bytes([20 * 8 + 3, 0x80 | 0x40 | 3, 2, 4, 5]) + bytes(4 + 5 + 6) + bytes(2)
    rows = [("vbr", vbr), ("odd", bytes([161, 1, 2, 3])), ("none", b""), ("zero", bytes([163, 0])), ("cut", bytes([162])), ("long", bytes([160]) + bytes(1276))]
    got = src.opus_frame_rows(frame(spark, rows, "name string, data binary")).collect()
    assert [(r.name, r.offset, r.size) for r in got] == [("vbr", 5, 4), ("vbr", 9, 5), ("vbr", 14, 6)]
    head = b"OpusHead" + bytes([1, 2]) + struct.pack("<HIhB", 312, 44100, -5, 0)
    h = containers.opus_head(F.col("b"))
    made = [head, head[:9] + b"\x03" + head[10:], head[:18], head[:8] + b"\x10" + head[9:]]
    assert [r[0] for r in frame(spark, [(b,) for b in made], "b binary").select(h["result"]).collect()] == ["OK", "CORRUPT", "CORRUPT", "CORRUPT"]


@pytest.mark.parametrize("span", [3, 7, 1000])
def test_ranges_match_one_window(spark, span):
    r = random.Random(span)
    rows = [(t, f, r.randint(-9, 9)) for t in (1, 2, None) for f in range(25)]
    df = frame(spark, rows, "track int, frame long, x long").where("track IS NOT NULL")
    xs = {(t, f): x for t, f, x in rows}
    got = ranges.running_sum(df, "track", "frame", F.col("x"), "s", span=span).collect()
    assert len(got) == 50 and all(g.s == sum(xs[g.track, k] for k in range(g.frame + 1)) for g in got)
    for order in (1, 2, 4):
        res = predict.residual(df, order, span)
        back = {(g.track, g.frame): g.x for g in predict.reconstruct(res, order, span).collect()}
        assert back == {k: v for k, v in xs.items() if k[0]}
    points = frame(spark, [(1, 4, 40), (1, 11, 110), (2, 20, 200), (3, 0, 0)], "track int, frame long, offset long")
    got = seek.as_of(df, points, span=span).collect()
    assert len(got) == 50 and "x" in got[0].asDict()
    for g in got:
        best = max((p for t, p, _ in [(1, 4, 0), (1, 11, 0), (2, 20, 0)] if t == g.track and p <= g.frame), default=None)
        assert (g.point, g.offset) == (best, best * 10 if best is not None else None)
    assert seek.as_of(df.limit(0), points).count() == 0 and predict.residual(df.limit(0), 2).count() == 0


def test_unknown_and_refused(spark):
    one = spark.range(1)
    null = F.lit(None).cast("bigint")
    got = one.select(headers.duration(F.lit(10), F.lit(0), F.lit(0), F.lit(0)).alias("a"), headers.duration(null, F.lit(0), F.lit(0), F.lit(8000)).alias("b"), headers.layout_valid(F.lit(0), F.lit(0)).alias("c"), headers.coded_frames("ms-adpcm", F.lit(3), F.lit(2)).alias("d"), headers.track_result(F.lit(44100), F.lit(3), F.lit(2), F.lit(None).cast("string")).alias("e")).first()
    assert tuple(got) == (-1.0, -1.0, False, None, "INVALID")


def test_dither_of_ranges_is_that_of_the_buffer(spark):
    rng = np.random.default_rng(5)
    v = [float(x) for x in rng.uniform(-1.1, 1.1, 5000)]
    state, want = 77, []
    for x in v:
        x *= 1 << 15
        for _ in range(2):
            state ^= state >> 12
            state = state ^ state << 25 & (1 << 64) - 1
            state ^= state >> 27
            x += (state * 0x2545F4914F6CDD1D % (1 << 64) >> 11) / 2.0**53 - 0.5
        x = math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)
        want.append(min(max(x, -32768), 32767))
    for step in (7, 999, 5000):
        df = spark.createDataFrame([(at, v[at : at + step]) for at in range(0, len(v), step)], "at bigint, v array<double>")
        got = samples.dithered(df, "v", "s16", F.lit(77), first=F.col("at")).collect()
        assert [x for r in sorted(got) for x in r.v] == want
    odd = spark.createDataFrame([(1, [0.0, None, float("nan"), 0.0]), (2, None), (3, [])], "k int, v array<double>")
    got = {r.k: r.v for r in samples.dithered(odd, "v", "s16", F.lit(9)).collect()}
    full = samples.dithered(spark.createDataFrame([(1, [0.0] * 4)], "k int, v array<double>"), "v", "s16", F.lit(9)).head().v
    assert got == {1: [full[0], None, None, full[3]], 2: [], 3: []}
