"""Packet positions and seeks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from wavelake.operators import positions
from wavelake.sources import files as src


def stream(r, packets, start):
    """(duration, granule, page) of each packet, and the true ends; pages hold one to five packets."""
    rows, at, page, left = [], start, 0, r.randint(1, 5)
    for k in range(packets):
        d = r.choice((120, 240, 960, 2880))
        at, left = at + d, left - 1
        ends = left == 0 or k + 1 == packets
        rows.append((k, d, at if ends else -1, page, at))
        if ends:
            page, left = page + 1, r.randint(1, 5)
    return rows


@pytest.mark.parametrize("span", [3, 7, 65_536])
def test_positions(spark, span):
    r = random.Random(9)
    own = {k: stream(r, n, start) for k, (n, start) in enumerate(((40, 0), (25, 5000), (1, 0), (60, 17), (9, 0)))}
    rows = []
    for k, packets in own.items():
        cut = 100 if k in (0, 1) else 0  # an end that is less than what the packets give
        rows += [(k, n, d, g - cut if n + 1 == len(packets) else g) for n, d, g, _, _ in packets]
    rows += [(90, n, 960, -1) for n in range(3)] + [(91, 0, None, None), (91, 1, 120, None), (None, 0, 1, 1)]
    df = spark.createDataFrame(rows, "k int, packet bigint, duration bigint, granule bigint").repartition(4)
    got = {(x.k, x.packet): (x.start, x.end) for x in positions.packet_positions(df, "k", span=span).collect()}
    for k, packets in own.items():
        for n, d, _, _, end in packets:
            assert got[k, n] == (end - d, end), (k, n)
    assert [got[90, n] for n in range(3)] == [(0, 960), (960, 1920), (1920, 2880)]
    assert [got[91, n] for n in (0, 1)] == [(0, 0), (0, 120)] and len(got) == len(rows) - 1
    assert positions.packet_positions(df.limit(0), "k").collect() == []


def test_durations(spark):
    cases = [(b"\x00", 480), (b"\x08", 960), (b"\x19x", 2880 * 2), (b"\xf8", 960), (b"\xe0", 120), (b"\xe3\x05", 600), (b"\xe3\x00", None), (b"\xe3", None), (b"", None), (b"\x1b\x03", None), (None, None), (b"\x60", 480), (b"\x6a", 1920)]
    df = spark.createDataFrame([(k, bytearray(d) if d is not None else None) for k, (d, _) in enumerate(cases)], "k int, data binary")
    got = {x.k: x.d for x in df.select("k", positions.opus_duration(F.col("data")).alias("d")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    blocks = spark.createDataFrame([(0, n, b) for n, b in enumerate((256, 2048, 2048, 256, 256))], "k int, packet bigint, block bigint")
    for span in (1, 2, 99):
        rows = positions.with_vorbis_durations(blocks, "k", span=span).orderBy("packet").collect()
        assert [x.duration for x in rows] == [0, 576, 1024, 576, 128]


def test_seeks_in_written_streams(spark):
    """Streams as bytes: pages, packets, positions and landings of them; each landing is held against all pages."""
    r, skip, files = random.Random(2), 312, []
    for k in range(4):
        at, packets = 0, [(b"OpusHead" + bytes([1, 1]) + skip.to_bytes(2, "little") + (48000).to_bytes(4, "little") + bytes(3), 0), (b"OpusTags" + bytes(8), 0)]
        for _ in range(60):
            toc, d = r.choice(((0xF8, 960), (0xE0, 120), (0x08, 960), (0x18, 2880)))
            at += d
            packets.append((bytes([toc]) + r.randbytes(r.choice((3, 300, 70_000))), at))  # the largest go over two pages
        files.append((k, bytearray(src.ogg_stream(k, packets))))
    df = spark.createDataFrame(files, "id int, content binary")
    pages = src.ogg_page_rows(df).where("number > 1").select("id", "number", "granule", "flags", "offset").cache()
    points = positions.landings(pages, "id")
    targets = spark.createDataFrame([(k, f) for k in range(4) for f in range(0, 60_000, 611)], "id int, frame bigint")
    got = positions.seek(targets, points, "id", skip=F.lit(skip)).collect()
    own = {}
    for p in pages.orderBy("number").collect():
        own.setdefault(p.id, []).append(p)
    for x in got:
        fit = [(a.granule, b.offset) for a, b in zip(own[x.id], own[x.id][1:]) if a.granule != -1 and not b.flags & 1 and skip < a.granule <= x.frame + skip - positions.PRE_ROLL]
        want = max(fit, default=(skip, None))
        assert (x.position, x.offset) == (want[0] - skip, want[1]) and x.discard == x.frame - x.position
    placed = positions.packet_positions(src.ogg_packet_rows(df).where("packet > 1").select("id", (F.col("packet") - 2).alias("packet"), "granule", positions.opus_duration(F.col("data")).alias("duration")), "id")
    assert all(p.granule in (-1, p.end) for p in placed.collect())
    assert len({x.offset for x in got}) > 40
