"""FLAC in Ogg against the same frames in a native file."""

import numpy as np

from wavelake.operators import flac, ogg_flac
from wavelake.sources import files as src

from .test_flac import sound

INFO = bytes.fromhex("0010232800000000000001F400F0") + bytes(20)


def wrapped(data, places, serial=7, head=b"\x00\x00\x00\x22" + INFO, blocks=(b"\x81\x00\x00\x02\x00\x00",)):
    """A stream of the frames at places of a native file."""
    own = [(data[at : at + n], first + size) for at, n, first, size in places]
    return src.ogg_stream(serial, [(b"\x7fFLAC\x01\x00\x00\x01fLaC" + head, 0), *[(b, 0) for b in blocks], *own])


def test_same_frames_as_native(spark):
    fields = ["number", "variable", "first_sample", "block_size", "sample_rate", "assignment", "depth", "header", "length"]
    for variable in (False, True):
        data, places = sound(4, 6, variable)
        native = spark.createDataFrame([(1, bytearray(data))], "k int, content binary")
        ogg = spark.createDataFrame([(1, bytearray(wrapped(data, places)))], "k int, content binary")
        want = flac.frame_index(native, "k").orderBy("offset").select(*fields).collect()
        got = ogg_flac.frames(ogg_flac.packets(ogg), "k").orderBy("offset")
        assert got.select(*fields).collect() == want and len(want) == 6
        assert [bytes(r.data) for r in got.collect()] == [data[at : at + n] for at, n, _, _ in places]


def test_damage_and_other_streams(spark):
    data, places = sound(5, 4)
    hurt = bytearray(data)
    hurt[places[1][0] + 30] ^= 1
    other = src.ogg_stream(9, [(b"OpusHead" + bytes(11), 0), (b"OpusTags" + bytes(8), 0), (b"x" * 600, 960)])
    mixed = other + wrapped(bytes(hurt), places)
    cases = [mixed, wrapped(data, places, blocks=()), wrapped(data, [], blocks=(b"\x01\x00\x00\x02\x00\x00",)), wrapped(data, places, blocks=(b"\x84\x00\x00\x09" + bytes(8),)), wrapped(data, places, head=b"\x80\x00\x00\x22" + INFO[:-20] + bytes(20), blocks=()), other, b"", None, wrapped(data, places, blocks=(b"",))]
    files = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(cases)], "k int, content binary")
    rows = ogg_flac.packets(files).cache()
    results = {r.k: r.result for r in ogg_flac.scan(rows, ["k"]).collect()}
    assert results == {0: "OK", 1: "OK", 2: "CORRUPT", 3: "CORRUPT", 4: "OK", 8: "CORRUPT"}
    info = ogg_flac.scan(rows, ["k"]).where("k = 0").first()
    assert (info.serial, info.sample_rate, info.channels, info.depth, info.least_block, info.most_block) == (7, 8000, 1, 16, 16, 9000)
    found = {}
    for r in ogg_flac.frames(rows, "k").orderBy("offset").collect():
        found.setdefault(r.stream.key, []).append(r.number)
    assert found == {0: [0, 2, 3], 1: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: [0, 1, 2, 3], 8: [0, 1, 2, 3]}
    assert np.array_equal(sorted({r.stream.serial for r in ogg_flac.frames(rows, "k").collect()}), [7])
    targets = ogg_flac.frames(rows, "k").where("stream.key = 0").selectExpr("stream", "first_sample + 5 AS sample")
    got = flac.seek_frame(targets, ogg_flac.frames(rows, "k"), "stream").collect()
    assert {(r.skip, r.found) for r in got} == {(5, True)}
