"""Tracks of sound files from their bytes: container scans, sample bytes, and the bytes of new files.

A scan gives a row for each file of its format with result (OK, CORRUPT, UNSUPPORTED or LIMIT) and, where that is OK, the
fields of its track. Files of other formats give no row; repeated files give a row each if a column tells them apart.
content names the column of a file's bytes; None: files are (path, length), of any size, and scans read no more of them
than they must. Keys may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..functions import headers
from ..functions.lookups import MPEG_BITRATES
from ..sources import files as src

#: Most channels, frames a second, and chunks of a file.
MOST_CHANNELS, MOST_RATE, MOST_CHUNKS = 256, 768_000, 64
# The end of the sub-format identifier of extensible WAV formats.
GUID = "000000001000800000AA00389B71"
FLOATS, CODED = {32: "f32", 64: "f64"}, {6: "alaw", 7: "ulaw", 17: "ima-wav", 2: "ms-adpcm"}


def _first(kind: str, field: str) -> Column:
    return F.min_by(F.when(F.col("id") == kind, F.col(field)), F.when(F.col("id") == kind, F.col("at")))


def _last(kind: str, field: str) -> Column:
    return F.max_by(F.when(F.col("id") == kind, F.col(field)), F.when(F.col("id") == kind, F.col("at")))


def _pick(value: Column, table: dict, kind: str = "string") -> Column:
    out = F.lit(None).cast(kind)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _with_all_files(elements: DataFrame, files: DataFrame) -> DataFrame:
    """elements with a row for each file besides, of place -1 and with no element's fields: no file goes missing for
    having none."""
    own = [c for c in files.columns if c != "content"]
    rest = [F.lit(-1 if f.name == "at" else None).cast(f.dataType).alias(f.name) for f in elements.schema.fields if f.name not in own]
    return elements.unionByName(files.select(*[F.col(f"`{c}`") for c in own], *rest))


def _finished(got: DataFrame, keys: list[str], result: Column, fields: dict[str, Column]) -> DataFrame:
    got = got.withColumn("result", F.coalesce(result, F.lit("CORRUPT")))
    return got.select(*keys, "result", *[F.when(F.col("result") == "OK", c).alias(k) for k, c in fields.items()])


def wav_scan(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, result, format, coding, channels, mask, sample_rate, frames, data_offset, data_length) of WAV files. keys name
    a file. Data that run past the end are cut to what is there; the frames of coded data come from their blocks, the last
    one's own included, unless a fact chunk says less within one block. In the long forms (RF64, BW64) a size of 2^32 - 1
    stands for that of the ds64 chunk, and is CORRUPT without one. A file without chunks is CORRUPT."""
    head = F.col("__head")
    own = src.with_head(files, keys, content).where(F.hex(by.part(head, 0, 4)).isin("52494646", "52463634", "42573634") & (F.hex(by.part(head, 8, 4)) == "57415645"))
    own = own.withColumn("__long", F.hex(by.part(head, 0, 4)) != "52494646").drop("__head")
    chunks = _with_all_files(src.chunk_rows(own, content and "content"), own)
    got = chunks.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__long").alias("rf64"), F.count_if(F.col("at") >= 0).alias("chunks"), _last("fmt ", "data").alias("fmt"), _last("fmt ", "size").alias("fmt_size"), _last("data", "offset").alias("at"), _last("data", "size").alias("size"), F.min(F.when((F.col("id") == "fmt "), F.col("size"))).alias("least"), _last("fact", "data").alias("fact"), _last("ds64", "data").alias("ds64"))
    # step by step: each step's columns are computed once, and no expression holds those before it
    fmt, c = F.col("fmt"), F.col("channels")
    got = got.withColumns({"tag": by.le(fmt, 0, 2), "channels": by.le(fmt, 2, 2), "rate": by.le(fmt, 4, 4), "align": by.le(fmt, 12, 2), "bits": by.le(fmt, 14, 2), "extra": by.le(fmt, 18, 2), "coef": by.le(fmt, 20, 2), "stated": by.le(fmt, 20, 4), "inner": by.le(fmt, 24, 2), "guid": F.hex(by.part(fmt, 26, 14)), "fmt_bytes": F.length(fmt), "fact": by.le(F.col("fact"), 0, 4), "long": by.le64(F.col("ds64"), 8)})
    wide = F.col("tag") == 0xFFFE
    length = F.least(F.when((F.col("size") == 0xFFFFFFFF) & F.col("long").isNotNull(), F.col("long")).otherwise(F.col("size")), F.col("n") - F.col("at"))
    got = got.withColumns({"real": F.when(wide, F.col("inner")).otherwise(F.col("tag")), "mask": F.when(wide & headers.layout_valid(F.col("stated"), c), F.col("stated")).otherwise(0), "length": F.greatest(length, F.lit(0))})
    got = got.withColumn("coding", F.coalesce(_pick(F.col("real"), CODED), F.lit("pcm")))
    pcm = F.when(F.col("real") == 1, _pick(F.col("bits"), {8: "u8", 16: "s16", 24: "s24", 32: "s32"})).when(F.col("real") == 3, _pick(F.col("bits"), FLOATS))
    got = got.withColumn("format", F.when(F.col("coding") != "pcm", "s16").otherwise(pcm))
    got = got.withColumn("width", _pick(F.col("format"), {"u8": 1, "s16": 2, "s24": 3, "s32": 4, "f32": 4, "f64": 8}, "bigint"))
    blocks = {name: headers.coded_geometry(name, F.col("align"), c, F.col("extra") if name in ("ima-wav", "ms-adpcm") else None) for name in CODED.values()}
    got = got.withColumns({k: F.coalesce(*[F.when(F.col("coding") == name, g[k]) for name, g in blocks.items()]).alias(k) for k in ("block_bytes", "block_frames")} | {"geometry": F.coalesce(*[F.when(F.col("coding") == name, g["result"]) for name, g in blocks.items()], F.lit("OK"))})
    rest = F.col("length") % F.col("block_bytes")
    tails = F.coalesce(*[F.when(F.col("coding") == name, headers.tail_frames(name, rest, F.col("block_bytes"), c)) for name in CODED.values()])
    got = got.withColumn("counted", F.floor(F.col("length") / F.col("block_bytes")) * F.col("block_frames") + tails)
    less = (F.col("fact") <= F.col("counted")) & (F.col("counted") - F.col("fact") < F.col("block_frames"))
    frame = F.when(c > 0, F.col("width") * c)
    got = got.withColumn("frames", F.when(F.col("coding") == "pcm", F.floor(F.col("length") / frame)).when(less, F.col("fact")).otherwise(F.col("counted")))
    ms = F.col("coding") == "ms-adpcm"
    result = (
        F.when(F.col("chunks") >= MOST_CHUNKS, "LIMIT")
        .when((F.col("fmt_size") < 16) | (F.col("fmt_bytes") < F.least(F.col("fmt_size"), F.lit(40))), "CORRUPT")
        .when((c == 0) | (F.col("rate") == 0), "CORRUPT")
        .when((c > MOST_CHANNELS) | (F.col("rate") > MOST_RATE), "LIMIT")
        .when(wide & (F.col("fmt_bytes") < 40), "CORRUPT")
        .when(wide & (F.col("guid") != GUID), "UNSUPPORTED")
        .when(F.col("coding").isin("ima-wav", "ms-adpcm") & (F.col("fmt_bytes") < 20), "CORRUPT")
        .when(ms & (F.col("fmt_bytes") < 22), "CORRUPT")
        .when(ms & ((F.col("coef") == 0) | (F.col("coef") > 32)), "UNSUPPORTED")
        .when(ms & (F.col("fmt_bytes") < 22 + 4 * F.col("coef")), "CORRUPT")
        .when(fmt.isNotNull() & F.col("format").isNull(), "UNSUPPORTED")
        .when(fmt.isNull() | F.col("at").isNull(), "CORRUPT")
        .when(F.col("rf64") & (F.col("size") == 0xFFFFFFFF) & F.col("long").isNull(), "CORRUPT")
        .otherwise(F.col("geometry"))
    )
    stored = F.when(F.col("coding") == "pcm", F.col("frames") * frame).otherwise(F.col("length"))
    return _finished(got, keys, result, {"format": F.col("format"), "coding": F.col("coding"), "channels": c, "mask": F.col("mask"), "sample_rate": F.col("rate"), "frames": F.col("frames").cast("bigint"), "data_offset": F.col("at"), "data_length": stored.cast("bigint")})


def aiff_scan(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """The same of AIFF and AIFF-C files, with little_endian. The bytes that are there say how many frames there are; of
    those stated, no more count than the bytes hold."""
    head = F.col("__head")
    own = src.with_head(files, keys, content).where((F.hex(by.part(head, 0, 4)) == "464F524D") & F.hex(by.part(head, 8, 4)).isin("41494646", "41494643"))
    own = own.withColumn("__kind", F.hex(by.part(head, 11, 1))).drop("__head")
    chunks = _with_all_files(src.chunk_rows(own, content and "content"), own)
    got = chunks.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__kind").alias("kind"), F.count_if(F.col("at") >= 0).alias("chunks"), _last("COMM", "data").alias("comm"), _last("COMM", "size").alias("comm_size"), _last("SSND", "data").alias("ssnd"), _last("SSND", "offset").alias("at"), _last("SSND", "size").alias("size"))
    comm, c = F.col("comm"), F.col("channels")
    packing = F.when((F.col("kind") == "43") & (F.length(comm) >= 22), by.part(comm, 18, 4).cast("string")).otherwise("NONE")
    got = got.withColumns({"channels": by.be(comm, 0, 2), "stated": by.be(comm, 2, 4), "bits": by.be(comm, 6, 2), "rate": by.extended(comm, 8), "packing": packing, "skip": by.be(F.col("ssnd"), 0, 4), "comm_bytes": F.length(comm), "ssnd_bytes": F.length(F.col("ssnd"))})
    p = F.col("packing")
    got = got.withColumns({"coding": F.when(p.isin("ulaw", "ULAW"), "ulaw").when(p.isin("alaw", "ALAW"), "alaw").when(p == "ima4", "ima-qt").otherwise("pcm"), "start": F.col("at") + 8 + F.col("skip")})
    whole = _pick(F.floor((F.col("bits") + 7) / 8), {1: "s8", 2: "s16", 3: "s24", 4: "s32"})
    got = got.withColumns({"format": F.when(F.col("coding") != "pcm", "s16").when(p.isin("fl32", "FL32", "fl64", "FL64"), _pick(F.col("bits"), FLOATS)).otherwise(whole), "length": F.greatest(F.least(F.col("size") - 8 - F.col("skip"), F.col("n") - F.col("start")), F.lit(0))})
    got = got.withColumn("width", F.when(F.col("coding") != "pcm", 1).otherwise(_pick(F.col("format"), {"s8": 1, "s16": 2, "s24": 3, "s32": 4, "f32": 4, "f64": 8}, "bigint")))
    packets = F.col("coding") == "ima-qt"  # 34 bytes a channel, 64 frames
    frame = F.when(c > 0, F.when(packets, 34).otherwise(F.col("width")) * c)
    frames = F.least(F.floor(F.col("length") / frame), F.col("stated")) * F.when(packets, 64).otherwise(1)
    result = (
        F.when(F.col("chunks") >= MOST_CHUNKS, "LIMIT")
        .when((F.col("comm_size") < 18) | (F.col("comm_bytes") < F.least(F.col("comm_size"), F.lit(22))), "CORRUPT")
        .when(~p.isin("NONE", "sowt", "twos", "fl32", "FL32", "fl64", "FL64", "ulaw", "ULAW", "alaw", "ALAW", "ima4"), "UNSUPPORTED")
        .when(F.col("ssnd_bytes") < 8, "CORRUPT")
        .when(comm.isNull() | F.col("ssnd").isNull() | (c == 0) | ~(F.col("rate") > 0), "CORRUPT")
        .when((c > MOST_CHANNELS) | (F.col("rate") > MOST_RATE), "LIMIT")
        .when(F.col("format").isNull(), "UNSUPPORTED")
        .otherwise("OK")
    )
    return _finished(got, keys, result, {"format": F.col("format"), "coding": F.col("coding"), "channels": c, "sample_rate": F.floor(F.col("rate") + 0.5).cast("bigint"), "frames": frames.cast("bigint"), "data_offset": F.col("start"), "data_length": F.col("length").cast("bigint"), "little_endian": p == "sowt"})


def pcm_samples(rows: DataFrame, data: str, fmt: str, channels: Column, big: bool = False) -> DataFrame:
    """rows (each with a run of whole frames) with frame, ch and v: samples as fractions, floats as they are. A run is a
    bounded piece of a file, and runs decode apart from each other; bytes beyond the last whole frame are left out."""
    width = {"u8": 1, "s8": 1, "s16": 2, "s24": 3, "s32": 4, "f32": 4, "f64": 8}[fmt]
    b = F.col(data)
    n = F.floor(F.length(b) / (width * channels)) * channels

    def sample(i: Column) -> Column:
        if fmt == "f64":
            half = lambda k: (by.be if big else by.le)(b, i * 8 + k, 4)
            hi, lo = (half(0), half(4)) if big else (half(4), half(0))
            return by.real(F.shiftleft(hi, 32).bitwiseOR(lo), 11, 52)
        raw = (by.be if big else by.le)(b, i * width, width)
        if fmt == "f32":
            return by.real(raw, 8, 23)
        if fmt == "u8":
            return (raw - 128) / F.lit(128.0)
        return by.signed(raw, 8 * width) / F.lit(float(1 << (8 * width - 1)))

    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), sample)).otherwise(F.array().cast("array<double>"))
    out = rows.withColumn("__n", channels).select(*[F.col(f"`{c}`") for c in rows.columns], "__n", F.posexplode(every).alias("__i", "v"))
    return out.withColumn("frame", F.floor(F.col("__i") / F.col("__n"))).withColumn("ch", F.col("__i") % F.col("__n")).drop("__i", "__n")


def sample_bytes(values: Column, width: int, big: bool = False) -> Column:
    """An array of whole numbers as bytes."""
    return by.joined(F.transform(values, lambda x: (by.be_bytes if big else by.le_bytes)(x, width)))


def _chunk(name: str, data: Column, big: bool = False) -> Column:
    pad = lambda d: F.when(F.length(d) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return by.let(data, lambda d: F.concat(F.lit(name.encode()), (by.be_bytes if big else by.le_bytes)(F.length(d), 4), d, pad(d)))


def wav_bytes(fmt: str, channels: Column, rate: Column, data: Column, mask: Column | None = None, more: Column | None = None) -> Column:
    """A WAV file of sample bytes of a PCM or float format; null (refused) for s8. With a mask, or more than two channels,
    its format chunk is the extensible one. more: whole further chunks."""
    bits = {"u8": 8, "s16": 16, "s24": 24, "s32": 32, "f32": 32, "f64": 64}.get(fmt)
    if bits is None:
        return F.lit(None).cast("binary")
    tag, mask = (3 if fmt[0] == "f" else 1), mask if mask is not None else F.lit(0)
    frame = channels * (bits // 8)
    wide = (channels > 2) | (mask != 0)
    head = F.concat(by.le_bytes(F.when(wide, 0xFFFE).otherwise(tag), 2), by.le_bytes(channels, 2), by.le_bytes(rate, 4), by.le_bytes(rate * frame, 4), by.le_bytes(frame, 2), by.le_bytes(F.lit(bits), 2))
    tail = F.concat(by.le_bytes(F.lit(22), 2), by.le_bytes(F.lit(bits), 2), by.le_bytes(mask, 4), by.le_bytes(F.lit(tag), 2), F.unhex(F.lit(GUID)))
    body = F.concat(F.lit(b"WAVE"), _chunk("fmt ", F.when(wide, F.concat(head, tail)).otherwise(head)), _chunk("data", data), *([more] if more is not None else []))
    return by.let(body, lambda b: F.concat(F.lit(b"RIFF"), by.le_bytes(F.length(b), 4), b))


def aiff_bytes(fmt: str, channels: Column, rate: Column, frames: Column, data: Column) -> Column:
    """An AIFF file of big-endian sample bytes of a whole-number format; null (refused) for u8."""
    bits = {"s8": 8, "s16": 16, "s24": 24, "s32": 32}.get(fmt)
    if bits is None:
        return F.lit(None).cast("binary")
    comm = F.concat(by.be_bytes(channels, 2), by.be_bytes(frames, 4), by.be_bytes(F.lit(bits), 2), by.extended_bytes(rate))
    body = F.concat(F.lit(b"AIFF"), _chunk("COMM", comm, True), _chunk("SSND", F.concat(by.be_bytes(F.lit(0), 8), data), True))
    return by.let(body, lambda b: F.concat(F.lit(b"FORM"), by.be_bytes(F.length(b), 4), b))


# FLAC


def streaminfo(data: Column) -> dict[str, Column]:
    """result and fields of a STREAMINFO block. 0 frames: not known (null)."""
    packed = by.be(data, 10, 4)
    low = by.be(data, 14, 4)
    least, most = by.be(data, 0, 2), by.be(data, 2, 2)
    rate = F.shiftright(packed, 12)
    channels, depth = F.shiftright(packed, 9).bitwiseAND(7) + 1, F.shiftright(packed, 4).bitwiseAND(31) + 1
    frames = packed.bitwiseAND(15) * (1 << 32) + low
    result = F.when((F.length(data) < 34) | (least < 16) | (least > most) | (depth < 4), "CORRUPT").when((rate == 0) | ~depth.isin(8, 16, 24, 32), "UNSUPPORTED").otherwise("OK")
    fields = {"least_block": least, "most_block": most, "least_frame": by.be(data, 4, 3), "most_frame": by.be(data, 7, 3), "sample_rate": rate, "channels": channels, "depth": depth, "frames": F.when(frames > 0, frames), "md5": F.lower(F.hex(by.part(data, 18, 16)))}
    return {"result": result, **{k: F.when(result == "OK", v) for k, v in fields.items()}}


def flac_scan(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, result, fields of STREAMINFO, frames_offset) of FLAC files. STREAMINFO must come first and once, a block must
    be marked last, cue sheets, pictures and comments must hold just what their lengths say, and type 127 is CORRUPT."""
    own = src.with_head(files, keys, content, 4).where(F.hex("__head") == "664C6143").drop("__head")
    blocks = _with_all_files(src.flac_block_rows(own, content and "content"), own).withColumn("picture", F.when(F.col("type") == 6, picture(F.col("data"))["data"]))
    got = blocks.groupBy(*keys).agg(F.max(F.when((F.col("at") == 0) & (F.col("type") == 0), F.col("data"))).alias("info"), F.count_if(F.col("type") == 0).alias("infos"), F.count_if(F.col("type") == 127).alias("bad"), F.count_if(F.length("data") < F.col("size")).alias("cut"), F.count_if((F.col("type") == 5) & ~cuesheet_ok(F.col("data")) | (F.col("type") == 6) & F.col("picture").isNull() | (F.col("type") == 4) & ~comments_ok(F.col("data"))).alias("broken"), F.max("last").alias("ended"), F.max(F.when(F.col("last"), F.col("offset") + F.col("size"))).alias("sound_at"))
    got = got.withColumn("f", F.struct(*[v.alias(k) for k, v in streaminfo(F.col("info")).items()]))
    f = {k: F.col("f")[k] for k in ("result", "least_block", "most_block", "least_frame", "most_frame", "sample_rate", "channels", "depth", "frames", "md5")}
    result = F.when(F.col("info").isNull() | (F.col("infos") != 1) | (F.col("bad") > 0) | (F.col("cut") > 0) | (F.col("broken") > 0) | ~F.coalesce(F.col("ended"), F.lit(False)), "CORRUPT").otherwise(f["result"])
    return _finished(got, keys, result, {**{k: v for k, v in f.items() if k != "result"}, "frames_offset": F.col("sound_at")})


def seek_points(blocks: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """(keys, sample, offset, frames) of SEEKTABLE blocks: placeholders are passed over, a table that doesn't ascend or isn't
    of whole points is dropped as a whole."""
    rows = src.seek_point_rows(blocks.select(*keys, F.col(data).alias("__data")), "__data")
    return rows.select(*keys, "sample", "offset", "frames")


def picture(data: Column) -> dict[str, Column]:
    """Fields of a PICTURE block; all null if a length runs past its end."""
    mime = by.be(data, 4, 4)
    text = by.be(data, 8 + mime, 4)
    at = 12 + mime + text
    n = by.be(data, at + 16, 4)
    whole = F.coalesce(F.length(data) >= at + 20 + n, F.lit(False))
    fields = {"kind": by.be(data, 0, 4), "mime": F.decode(by.part(data, 8, mime), "ISO-8859-1"), "description": by.latin1_or_utf8(by.part(data, 12 + mime, text)), "width": by.be(data, at, 4), "height": by.be(data, at + 4, 4), "depth": by.be(data, at + 8, 4), "colours": by.be(data, at + 12, 4), "data": by.part(data, at + 20, n)}
    return {k: F.when(whole, v) for k, v in fields.items()}


def measured(data: Column) -> dict[str, Column]:
    """Width and height that a PNG picture's own header states; null for other bytes."""
    png = (F.hex(by.part(data, 0, 8)) == "89504E470D0A1A0A") & (by.part(data, 12, 4).cast("string") == "IHDR")
    return {"width": F.when(png, by.be(data, 16, 4)), "height": F.when(png, by.be(data, 20, 4))}


def picture_status(width: Column, height: Column, data: Column) -> Column:
    """What a stated size is worth: NOT_STATED, VERIFIED, or MISMATCH, also where the bytes can't be measured."""
    own = measured(data)
    same = ((width == 0) | (width == own["width"])) & ((height == 0) | (height == own["height"]))
    return F.when((width == 0) & (height == 0), "NOT_STATED").when(F.coalesce(same, F.lit(False)), "VERIFIED").otherwise("MISMATCH")


def cuesheet_ok(data: Column) -> Column:
    """Whether a CUESHEET block holds just its tracks: 396 bytes, and for each track 36 and 12 for each index."""
    tracks = by.u8(data, 395)
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(tracks, F.lit(1)).cast("int")), F.lit(396).cast("bigint"), lambda at, _: at + 36 + 12 * by.u8(data, at + 35))
    return F.coalesce((tracks > 0) & (end == F.length(data)), F.lit(False))


def comments_ok(data: Column) -> Column:
    """Whether the vendor text of a comment block and the number behind it lie within the block."""
    return F.coalesce(by.le(data, 0, 4) + 8 <= F.length(data), F.lit(False))


# Ogg


def logical_streams(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, serial, offset) of the streams that begin at the head of a file, before any page that begins none."""
    begins = F.col("flags").bitwiseAND(2) != 0
    rest = pages.groupBy(*keys).agg(F.min(F.when(~begins, F.col("offset"))).alias("__rest"))
    own = pages.where(begins).join(rest, keys, "left")
    return own.where(F.col("__rest").isNull() | (F.col("offset") < F.col("__rest"))).select(*keys, "serial", "offset")


def opus_head(data: Column) -> dict[str, Column]:
    """result and fields of an Opus head packet: version 0.x, a channel at least, mapping family 0 of one or two channels,
    1 of up to eight, or 255."""
    channels, family = by.u8(data, 9), by.u8(data, 18)
    good = (by.part(data, 0, 8).cast("string") == "OpusHead") & (by.u8(data, 8) < 16) & (channels > 0)
    mapped = F.when(family == 0, channels <= 2).when(family == 1, (channels <= 8) & (F.length(data) >= 21 + channels)).when(family == 255, F.length(data) >= 21 + channels)
    result = F.when(~F.coalesce(good & (F.length(data) >= 19), F.lit(False)), "CORRUPT").when(mapped.isNull(), "UNSUPPORTED").when(mapped, "OK").otherwise("CORRUPT")
    fields = {"channels": channels, "pre_skip": by.le(data, 10, 2), "input_rate": by.le(data, 12, 4), "gain": by.signed(by.le(data, 16, 2), 16), "family": family}
    return {"result": result, **{k: F.when(result == "OK", v) for k, v in fields.items()}}


def vorbis_head(data: Column) -> dict[str, Column]:
    """result and fields of a Vorbis identification packet: version 0, blocks of 64 to 8192 with the short one no longer
    than the long one, and the framing bit."""
    sizes = by.u8(data, 28).cast("int")
    short, long = sizes.bitwiseAND(15), F.shiftright(sizes, 4)
    good = (F.hex(by.part(data, 0, 7)) == "01766F72626973") & (by.le(data, 7, 4) == 0) & (by.u8(data, 11) > 0) & (by.le(data, 12, 4) > 0) & short.between(6, 13) & long.between(6, 13) & (short <= long) & (by.u8(data, 29) % 2 == 1)
    result = F.when(F.coalesce(good & (F.length(data) >= 30), F.lit(False)), "OK").otherwise("CORRUPT")
    fields = {"channels": by.u8(data, 11), "sample_rate": by.le(data, 12, 4), "short_block": F.pow(F.lit(2), short).cast("bigint"), "long_block": F.pow(F.lit(2), long).cast("bigint")}
    return {"result": result, **{k: F.when(result == "OK", v) for k, v in fields.items()}}


def ogg_scan(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, serial, codec, result, channels, sample_rate, pre_skip, frames) of the Opus and Vorbis streams of Ogg files.
    frames: the last stated granule, for Opus less its pre-skip; null where none is stated. A stream without its tag
    packet, or for Vorbis without its comment and setup packets, is CORRUPT."""
    own = files.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{content}`").alias("content")) if content else files
    last = F.max(F.when(F.col("at").isNotNull(), F.struct("at", "granule")))["granule"]
    heads = src.ogg_stream_rows(own, content and "content").groupBy(*keys, "serial").agg(F.max("first").alias("data"), F.max("second").alias("second"), F.max("third").alias("third"), last.alias("granule"))
    d = F.col("data")
    opus, vorbis = opus_head(d), vorbis_head(d)
    codec = F.when(by.part(d, 0, 8).cast("string") == "OpusHead", "opus").when(F.hex(by.part(d, 0, 7)) == "01766F72626973", "vorbis")
    got = heads.withColumn("codec", codec).where("codec IS NOT NULL")
    is_opus = F.col("codec") == "opus"
    pick = lambda a, b: F.when(is_opus, a).otherwise(b)
    fields = {"channels": pick(opus["channels"], vorbis["channels"]), "sample_rate": pick(F.lit(48000), vorbis["sample_rate"]), "pre_skip": pick(opus["pre_skip"], F.lit(0)), "frames": pick(headers.opus_frames(F.col("granule"), opus["pre_skip"]), F.col("granule"))}
    tags = F.coalesce(F.col("second").cast("string") == "OpusTags", F.lit(False))
    setup = F.coalesce((F.hex(by.part(F.col("second"), 0, 7)) == "03766F72626973") & (F.hex(by.part(F.col("third"), 0, 7)) == "05766F72626973"), F.lit(False))
    result = pick(F.when(tags | (opus["result"] != "OK"), opus["result"]), F.when(setup | (vorbis["result"] != "OK"), vorbis["result"]))
    return _finished(got, [*keys, "serial", "codec"], result, fields)


# MPEG


def xing_tag(frame: Column, side: Column) -> dict[str, Column]:
    """frames, bytes, delay and padding that the tag in a stream's first frame states (VBRI at 36, or else Xing or Info
    behind the side information, with a checksum also two bytes further on); null where it states none. The decoder's 529
    frames go from padding to delay."""
    vbri = F.coalesce(by.part(frame, 36, 4).cast("string") == "VBRI", F.lit(False))
    there = lambda k: F.coalesce(by.part(frame, k, 4).cast("string").isin("Xing", "Info"), F.lit(False))
    at = 4 + side + F.when(there(4 + side) | (by.u8(frame, 1) % 2 == 1), 0).otherwise(2)
    name = by.part(frame, at, 4).cast("string")
    xing = there(at) & ~vbri
    flags = by.be(frame, at + 4, 4)
    has = lambda k: flags.bitwiseAND(k) != 0
    size_at = at + 8 + F.when(has(1), 4).otherwise(0)
    lame_at = size_at + F.when(has(2), 4).otherwise(0) + F.when(has(4), 100).otherwise(0) + F.when(has(8), 4).otherwise(0)
    encoder = by.part(frame, lame_at, 9)
    lame = xing & (F.length(encoder) == 9) & F.coalesce(F.regexp_like(F.decode(encoder, "ISO-8859-1"), F.lit("^[\\x20-\\x7e]{9}$")), F.lit(False))
    trims = by.be(frame, lame_at + 21, 3)
    return {
        "tag": F.when(xing, name).when(vbri, "VBRI"),
        "frames": F.when(xing & has(1), by.be(frame, at + 8, 4)).when(vbri, by.be(frame, 50, 4)),
        "bytes": F.when(xing & has(2), by.be(frame, size_at, 4)).when(vbri, by.be(frame, 46, 4)),
        "delay": F.when(lame, F.floor(trims / 4096) + 529),
        "padding": F.when(lame, F.greatest(trims % 4096 - 529, F.lit(0))),
    }


def mpeg_scan(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, version, layer, channels, sample_rate, first_offset, walked, source, frames, delay, padding) of MPEG files:
    the frames (samples of a channel) as a tag states them, if the file's bytes can hold as many of the shortest frames,
    else counted over all frames of the file. A frame that holds a tag is none of the sound. Files without a frame give no row."""
    own = files.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{content}`").alias("content")) if content else files
    rows = src.mpeg_track_rows(own, content and "content")
    got = rows.groupBy(*keys).agg(F.max("sound_end").alias("end"), F.sum("walked").alias("walked"), F.sum("total").alias("total"), *[F.max(c).alias(c) for c in ("data", "offset", "samples")])
    got = got.withColumns({f"b{k}": by.u8(F.col("data"), k) for k in range(4)})
    got = headers.with_mpeg_header(got.withColumnRenamed("samples", "of_first"), "b0", "b1", "b2", "b3")
    got = got.withColumn("tag", F.struct(*[v.alias(k) for k, v in xing_tag(F.col("data"), F.col("side_info")).items()]))
    tag = F.col("tag")
    least = F.coalesce(*[F.when(((F.col("version") == 1) == F.lit(v == 1)) & (F.col("layer") == layer), F.lit(MPEG_BITRATES[v, layer][1] * 1000)) for v in (1, 2) for layer in (1, 2, 3)])
    shortest = F.when(F.col("layer") == 1, F.floor(12 * least / F.col("sample_rate")) * 4).otherwise(F.floor(F.floor(F.col("of_first") / 8) * least / F.col("sample_rate")))
    got = got.withColumns({"counted": F.col("total") - F.when(tag["tag"].isNotNull(), F.col("of_first")).otherwise(0), "plausible": F.coalesce((tag["frames"] > 0) & (tag["frames"] <= F.floor((F.col("end") - F.col("offset")) / shortest)), F.lit(False))})
    got = got.withColumn("frames", F.when(F.col("plausible"), tag["frames"] * F.col("of_first")).otherwise(F.col("counted")).cast("bigint"))
    trims = F.coalesce(tag["delay"] + tag["padding"] < F.col("frames"), F.lit(False))
    return got.select(*keys, "version", "layer", "channels", "sample_rate", F.col("offset").alias("first_offset"), "walked", F.when(F.col("plausible"), "stated").otherwise("counted").alias("source"), "frames", F.when(trims, tag["delay"]).alias("delay"), F.when(trims, tag["padding"]).alias("padding"))


def mpeg_seek(targets: DataFrame, rows: DataFrame, keys: list[str], frame: str = "target", back: int = 6) -> DataFrame:
    """targets (keys, frame wanted) with start_frame and offset where decoding starts, ``back`` frames before the one that
    holds the target, and discard: samples to throw away. A target past the end gives nulls. One join on the frame.
    Rows that come out of files are more than their files' rows let Spark guess, so none are broadcast."""
    samples = rows.groupBy(*keys).agg(F.max("samples").alias("__samples"), F.max("frame").alias("__last"))
    at = F.floor(F.col(frame) / F.col("__samples"))
    own = targets.join(samples.hint("merge"), keys).withColumn("start_frame", F.when(at <= F.col("__last"), F.greatest(at - back, F.lit(0))))
    places = rows.select(*keys, F.col("frame").alias("start_frame"), "offset")
    return own.join(places.hint("merge"), [*keys, "start_frame"], "left").withColumn("discard", F.when(F.col("start_frame").isNotNull(), F.col(frame) - F.col("start_frame") * F.col("__samples"))).drop("__samples", "__last")
