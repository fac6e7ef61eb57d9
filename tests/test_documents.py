"""Files of any size in ranges, and whole files at once, against bytes made by hand."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wavelake.operators import adpcm, containers, documents
from wavelake.sources import byte_ranges
from wavelake.sources import files as src

from .test_files import chunk, frame, wav

FMT = struct.pack("<HHIIHH", 1, 2, 48000, 48000 * 4, 4, 16)


def rf64(length, more=b"", stated=None, form=b"RF64"):
    """Everything before the samples of a long file, and what stands behind them."""
    ds64 = b"" if stated is None else chunk(b"ds64", struct.pack("<QQQI", 0, stated, 0, 0))
    return form + b"\xff" * 4 + b"WAVE" + ds64 + chunk(b"fmt ", FMT) + b"data" + b"\xff" * 4, more


def test_three_gib_in_ranges(spark, tmp_path):
    length = 3 << 30
    head, tail = rf64(length, chunk(b"LIST", b"INFO" + chunk(b"INAM", b"Long one\0")), length)
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + length - 8)  # a sparse file: all zeros but its last two frames
        f.write(struct.pack("<4h", 1, -2, 3, -4))
        f.write(tail)
    files = byte_ranges.list_files(spark, f"file://{path}")
    tracks = documents.load(files, ["path"], None)
    one = tracks.first()
    assert (one.codec, one.result, one.frames, one.data_offset, one.data_length) == ("wav", "OK", length // 4, len(head), length)
    assert [(r.tag, r.value) for r in documents.load_tags(spark, files, ["path"], None).collect()] == [("title", "Long one")]
    ranges = documents.sample_ranges(tracks, 1 << 22)
    assert ranges.count() == 192 and ranges.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == length
    assert ranges.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = documents.sample_ranges(tracks, 1000).where(F.col("stop") == len(head) + length)
    got = documents.range_samples(last, "s16").orderBy(F.desc("frame"), F.desc("ch")).limit(5).collect()
    assert [(r.frame, r.ch, r.v * 32768) for r in got] == [(length // 4 - 1, 1, -4), (length // 4 - 1, 0, 3), (length // 4 - 2, 1, -2), (length // 4 - 2, 0, 1), (length // 4 - 3, 1, 0)]


def test_ranges_give_what_the_whole_file_gives(spark, tmp_path):
    r = random.Random(4)
    data = bytes(r.randrange(256) for _ in range(4000))
    (tmp_path / "a b.wav").write_bytes(wav(FMT, data))
    tracks = documents.load(byte_ranges.list_files(spark, f"file://{tmp_path}/*.wav"), ["path"], None)
    want = [(k // 2, k % 2, v / 32768) for k, v in enumerate(struct.unpack("<2000h", data))]
    for frames in (1, 7, 1000, 5000):
        got = documents.range_samples(documents.sample_ranges(tracks, frames), "s16").orderBy("frame", "ch").collect()
        assert [(x.frame, x.ch, x.v) for x in got] == want


def test_windows_read_as_bytes_do(tmp_path):
    r = random.Random(8)
    data = bytes(r.randrange(4) for _ in range(200_000))
    (tmp_path / "f").write_bytes(data)
    f = byte_ranges.FileBytes(str(tmp_path / "f"), len(data))
    for _ in range(300):
        a, b = r.randrange(-210_000, 210_000), r.randrange(-210_000, 210_000)
        assert f[a:b] == data[a:b]
        what = bytes(r.randrange(4) for _ in range(r.randrange(1, 9)))
        assert f.find(what, abs(a)) == data.find(what, abs(a)) and f.find(what, abs(a), abs(b)) == data.find(what, abs(a), abs(b))
    assert f[-1] == data[-1] and f[5] == data[5] and len(f) == len(data)
    with pytest.raises(IndexError):
        f[200_000]


def mp3_frame(byte1=0xFB, extra=b""):
    """MPEG-1 layer III, 128 kbit/s at 44,100, 417 bytes; byte1 FA: with a checksum."""
    return (bytes([0xFF, byte1, 0x90, 0x00]) + extra).ljust(417, b"\0")


def test_mixed_files_in_both_forms(spark, tmp_path):
    id3 = b"ID3\x04\0\0\0\0\0\x0f" + b"TIT2\0\0\0\x05\0\0\x03Song"
    trailer = b"TAG" + b"Old title".ljust(30, b"\0") + b"Somebody".ljust(30, b"\0") + bytes(64) + b"\x11"
    comments = struct.pack("<I", 1) + b"x" + struct.pack("<II", 1, 8) + b"ARTIST=A"
    info = struct.pack(">HH", 16, 4096) + bytes(6) + struct.pack(">II", (44100 << 12) | (1 << 9) | (15 << 4), 77) + bytes(16)
    flac = b"fLaC" + b"\0\0\0\x22" + info + b"\x84" + len(comments).to_bytes(3, "big") + comments
    opus = src.ogg_stream(5, [(b"OpusHead\x01\x02\x38\x01\x80\xbb\0\0\0\0\0", 0), (b"OpusTags" + comments, 0), (b"\0" * 9, 1000)])
    cases = {
        "a.wav": wav(FMT, b"\0" * 8, chunk(b"bext", b"about".ljust(256, b"\0") + b"maker".ljust(32, b"\0") + bytes(314)), chunk(b"id3 ", id3)),
        "b.mp3": id3 + mp3_frame() * 4 + trailer,
        "c.flac": flac,
        "d.opus": opus,
        "e.txt": b"text",
        "f.wav": b"RIFF\0\0\0\0WAVE",
        "g.aif": b"FORM\0\0\0\0AIFF",
        "h.flac": b"fLaC\0",
        "i": b"",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    want = {
        "a.wav": ("wav", "OK", 2, 48000, 2), "b.mp3": ("mp3", "OK", 2, 44100, 4 * 1152), "c.flac": ("flac", "OK", 2, 44100, 77), "d.opus": ("opus", "OK", 2, 48000, 1000 - 312),
        "e.txt": (None, "UNKNOWN", None, None, None), "f.wav": ("wav", "CORRUPT", None, None, None), "g.aif": ("aiff", "CORRUPT", None, None, None), "h.flac": ("flac", "CORRUPT", None, None, None), "i": (None, "UNKNOWN", None, None, None),
    }
    told = [("a.wav", "bext", "comment", "about"), ("a.wav", "bext", "organization", "maker"), ("a.wav", "id3v2", "title", "Song"), ("b.mp3", "id3v1", "artist", "Somebody"), ("b.mp3", "id3v1", "genre", "Rock"), ("b.mp3", "id3v2", "title", "Song"), ("c.flac", "vorbis", "artist", "A"), ("d.opus", "vorbis", "artist", "A")]
    whole = spark.createDataFrame([*[(f"file://{tmp_path}/{n}", d) for n, d in cases.items()]], "path string, content binary")
    listed = byte_ranges.list_files(spark, f"file://{tmp_path}/*")
    for files, content in ((whole, "content"), (listed, None)):
        got = documents.load(files, ["path"], content).collect()
        there = {k: v for k, v in want.items() if content or k != "i"}  # empty files are not listed
        assert len(got) == len(there)
        assert {r.path.rsplit("/", 1)[1]: (r.codec, r.result, r.channels, r.sample_rate, r.frames) for r in got} == there
        found = documents.load_tags(spark, files, ["path"], content).collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.scheme, r.tag, r.value) for r in found) == told
    odd = spark.createDataFrame([(None, cases["a.wav"]), (None, None), ("x", None)], "key string, content binary")
    assert sorted((r.key or "", r.result) for r in documents.load(odd, ["key"]).collect()) == [("", "OK"), ("x", "UNKNOWN")]
    assert documents.load(odd.limit(0), ["key"]).count() == 0


def test_long_forms(spark):
    data = b"\1\0" * 6
    files = {
        "stated": b"".join(x if i else x + data for i, x in enumerate(rf64(12, chunk(b"fact", b"\0\0\0\0"), 12))),
        "unstated": rf64(12)[0] + data,
        "plain": rf64(12, form=b"RIFF")[0] + data,
    }
    rows = frame(spark, list(files.items()), "name string, content binary")
    assert {r.name: (r.result, r.frames) for r in containers.wav_scan(rows, ["name"]).collect()} == {"stated": ("OK", 3), "unstated": ("CORRUPT", None), "plain": ("OK", 3)}
    behind = src.chunk_rows(rows.where("name = 'stated'"))
    assert [r.id for r in behind.orderBy("at").collect()] == ["ds64", "fmt ", "data", "fact"]


def test_mpeg_lengths(spark):
    xing = lambda n, at, byte1=0xFB: mp3_frame(byte1, bytes(at - 4) + b"Xing" + struct.pack(">II", 1, n))
    plain, checked = mp3_frame(), mp3_frame(0xFA)
    vbri = mp3_frame(0xFB, bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 0, 3) + bytes(8))
    files = {
        "plain": (xing(4, 36) + plain * 5, ("stated", 4 * 1152)),
        "checked": (xing(7, 38, 0xFA) + checked * 7, ("stated", 7 * 1152)),
        "too many": (xing(90, 36) + plain * 5, ("counted", 5 * 1152)),
        "just possible": (xing(24, 36) + plain * 5, ("stated", 24 * 1152)),
        "one more": (xing(25, 36) + plain * 5, ("counted", 5 * 1152)),
        "vbri": (vbri + plain * 5, ("stated", 3 * 1152)),
    }
    rows = frame(spark, [(k, v[0]) for k, v in files.items()], "name string, content binary")
    got = {r.name: (r.source, r.frames) for r in containers.mpeg_scan(rows, ["name"]).collect()}
    assert got == {k: v[1] for k, v in files.items()}


def test_streams_without_their_headers(spark):
    opus, vorbis = b"OpusHead\x01\x02\x38\x01\x80\xbb\0\0\0\0\0", b"\x01vorbis" + struct.pack("<IBIIIIBB", 0, 1, 8000, 0, 0, 0, 0x86, 1)
    comment, setup = b"\x03vorbis" + bytes(9), b"\x05vorbis" + bytes(9)
    files = {"a": [opus], "b": [opus, b"OpusTags" + bytes(8)], "c": [opus, b"other"], "d": [vorbis, comment], "e": [vorbis, comment, setup], "f": [vorbis, setup, comment]}
    rows = frame(spark, [(k, src.ogg_stream(1, [(p, 0) for p in v])) for k, v in files.items()] + [(None, src.ogg_stream(1, [(opus, 0)]))], "name string, content binary")
    got = {r.name: r.result for r in containers.ogg_scan(rows, ["name"]).collect()}
    assert got == {"a": "CORRUPT", "b": "OK", "c": "CORRUPT", "d": "CORRUPT", "e": "OK", "f": "CORRUPT", None: "CORRUPT"}


def test_own_predictor_pairs(spark):
    own = [(128, 64), (300, -50), (0, 0)]
    fmt = FMT + struct.pack("<HHH", 0, 500, len(own)) + b"".join(struct.pack("<hh", *p) for p in own)
    block = bytes([1]) + struct.pack("<hhh", 16, 100, -200) + bytes([0x12, 0xE7])
    rows = frame(spark, [(fmt, block, 1)], "fmt binary, block binary, channels int").withColumn("pairs", adpcm.ms_pairs(F.col("fmt")))
    got = [r.x for r in adpcm.ms_block(rows, pairs="pairs").orderBy("frame").collect()]
    a, b, d, out = *own[1], 16, [-200, 100]
    factors = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]
    for n in (1, 2, 14, 7):
        x = int((out[-1] * a + out[-2] * b) / 256) + (n - 16 if n > 7 else n) * d
        out.append(max(-32768, min(32767, x)))
        d = max(16, factors[n] * d // 256)
    assert got == out
