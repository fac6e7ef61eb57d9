"""Whole files at once: which codec each has, its tracks, its tags, and its samples in ranges.

files are (keys, content), or with content=None (path, length) of files of any size. A row that no codec claims gives
one track of result UNKNOWN, so that every file is in the answer; null contents too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..sources import files as src
from ..sources.byte_ranges import pieces, read_ranges
from ..sources.shared import stored
from . import containers, probe, tagbytes, tags

#: What of a file its codec is told by; MPEG frames are searched in it behind a tag.
HEAD = 1 << 17
TRACK = {"serial": "bigint", "result": "string", "format": "string", "coding": "string", "channels": "bigint", "mask": "bigint", "sample_rate": "bigint", "frames": "bigint", "data_offset": "bigint", "data_length": "bigint", "big": "boolean"}


def _named(files: DataFrame, keys: list[str], content: str | None) -> DataFrame:
    """files with codec: null where no codec claims the bytes. Written once, in a folder for each codec, so that a scan
    reads the files of its own codec alone and nothing is probed again; of files by path only the paths are written."""
    heads = src.with_head(files, keys, content, HEAD)
    return stored(probe.identify(heads, "__head").drop("__head", "__n", "confidence"), "codec")


def load(files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, codec, serial, result, format, coding, channels, mask, sample_rate, frames, data_offset, data_length, big):
    a row for each track. serial tells the streams of an Ogg file apart. The place of the samples is given where they lie
    as they are (WAV, AIFF) or start there (FLAC, MPEG); big: their bytes are big-endian."""
    named = _named(files, keys, content)
    mine = lambda *codecs: named.where(F.col("codec").isin(*codecs)).drop("codec")
    where = content and "content"

    def tracks(codec: str, scanned: DataFrame, **own) -> DataFrame:
        own = {c: own.get(c, F.col(c) if c in scanned.columns else F.lit(None)) for c in TRACK}
        return scanned.select(*[F.col(f"`{k}`") for k in keys], (F.col("codec") if "codec" in scanned.columns else F.lit(codec)).alias("codec"), *[v.cast(TRACK[c]).alias(c) for c, v in own.items()])

    depth = F.concat(F.lit("s"), F.col("depth"))
    found = [
        tracks("wav", containers.wav_scan(mine("wav"), keys, where), big=F.lit(False)),
        tracks("aiff", containers.aiff_scan(mine("aiff"), keys, where), big=~F.col("little_endian")),
        tracks("flac", containers.flac_scan(mine("flac"), keys, where), format=F.when(depth == "s8", "u8").otherwise(depth), coding=F.lit("flac"), data_offset=F.col("frames_offset")),
        tracks("mp3", containers.mpeg_scan(mine("mp3"), keys, where), result=F.lit("OK"), format=F.lit("s16"), coding=F.lit("mpeg"), data_offset=F.col("first_offset")),
        tracks("", containers.ogg_scan(mine("vorbis", "opus"), keys, where), coding=F.col("codec")),
    ]
    # a file whose codec is known but whose scan finds no track is CORRUPT, and one of no codec UNKNOWN
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    rest = named.select(*[F.col(f"`{k}`") for k in keys], "codec", F.lit(True).alias("__none"))
    none = rest.select(*[F.col(f"`{k}`") for k in keys], "codec", *[F.lit(None).cast(v).alias(c) for c, v in TRACK.items() if c != "result"], F.when(F.col("codec").isNull(), "UNKNOWN").otherwise("CORRUPT").alias("result"), F.lit(0).alias("__rank"))
    ranked = whole.withColumn("__rank", F.lit(1)).unionByName(none)
    best = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])  # a file's own tracks
    return ranked.withColumn("__best", F.max("__rank").over(best)).where("__rank = __best").select(*[F.col(f"`{c}`") for c in whole.columns])


def load_tags(spark: SparkSession, files: DataFrame, keys: list[str], content: str | None = "content") -> DataFrame:
    """(keys, scheme, at, tag, value): the tags of files of any codec in the order of each scheme: ID3v2 at the start of
    MPEG files and in chunks of WAV and AIFF, RIFF INFO, bext, AIFF text, comments of FLAC and Ogg, and of an ID3v1
    trailer what the ID3v2 tag lacks. Entries of no known tag are left out."""
    named = _named(files, keys, content)
    where = content and "content"
    mine = lambda *codecs: named.where(F.col("codec").isin(*codecs)).drop("codec")
    own = [F.col(f"`{k}`") for k in keys]

    def given(scheme: str, rows: DataFrame) -> DataFrame:
        return rows.where("tag IS NOT NULL").select(*own, F.lit(scheme).alias("scheme"), F.col("at").cast("int").alias("at"), "tag", "value")

    def id3(blocks: DataFrame, column: str | None) -> DataFrame:
        return tagbytes.id3v2(spark, blocks, column)

    def mapped(fields: dict) -> F.Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("tag"), v.alias("value")) for i, (k, v) in enumerate(fields.items())]))

    mpeg = mine("mp3")
    v2 = given("id3v2", id3(mpeg, where))
    if content:
        tail = mpeg.select(*own, F.col("content").alias("tail"))
    else:
        tail = read_ranges(mpeg.withColumns({"start": F.col("length") - 128, "stop": F.col("length")}), data="tail")
    v1 = tail.select(*own, mapped(tagbytes.id3v1(F.col("tail"))).alias("f")).select(*own, F.lit("id3v1").alias("scheme"), F.col("f.at").alias("at"), "f.tag", "f.value").where("value IS NOT NULL")
    chunks = src.chunk_rows(mine("wav", "aiff"), where).select(*own, F.col("id").alias("chunk"), F.col("at").alias("place"), "data")
    bext = chunks.where("chunk = 'bext'").select(*own, mapped(tagbytes.bext(F.col("data"))).alias("f")).select(*own, "f.*").where("value IS NOT NULL")
    text = tagbytes.aiff_text(chunks.select(*own, F.col("chunk").alias("id"), F.col("place").alias("at"), "data"))
    blocks = src.flac_block_rows(mine("flac"), where).where("type = 4").select(*own, "data")
    packets = src.ogg_packet_rows(mine("vorbis", "opus"), where, head=2).where("packet = 1")
    packets = packets.select(*own, F.when(by.part(F.col("data"), 0, 8).cast("string") == "OpusTags", F.expr("substring(data, 9)")).otherwise(F.expr("substring(data, 8)")).alias("data"))
    parts = [
        v2,
        tags.fill_missing(v2, v1, [*keys, "tag"]).select(*v2.columns),
        given("id3v2", id3(chunks.where("chunk IN ('id3 ', 'ID3 ')").select(*own, "data"), "data")),
        given("riff", tagbytes.riff_info(spark, chunks.where("chunk = 'LIST'").select(*own, "data"))),
        given("bext", bext),
        given("aiff", text),
        given("vorbis", tagbytes.vorbis_comments(spark, blocks.unionByName(packets))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sample_ranges(tracks: DataFrame, frames: int = 1 << 20) -> DataFrame:
    """tracks of load() over (path, length) files, each once for every range of ``frames`` frames of its PCM samples, with
    start, stop and first_frame; dealt to tasks by range, so that one file is read by many."""
    width = F.when(F.col("format") == "f64", 8).otherwise(F.floor(F.regexp_extract("format", r"\d+", 0).cast("int") / 8)).cast("bigint")
    size = width * F.col("channels")
    own = tracks.where("result = 'OK' AND coding = 'pcm' AND data_length > 0").withColumn("frame_bytes", size)
    out = pieces(own, F.col("data_offset"), F.col("frames") * F.col("frame_bytes"), F.col("frame_bytes") * frames)
    return out.withColumn("first_frame", F.floor((F.col("start") - F.col("data_offset")) / F.col("frame_bytes")))


def range_samples(ranges: DataFrame, fmt: str, big: bool = False) -> DataFrame:
    """(the ranges' columns, frame, ch, v): the samples of ranges of one format and byte order, numbered from the start of
    their track."""
    own = read_ranges(ranges.where((F.col("format") == fmt) & (F.col("big") == F.lit(big))))
    got = containers.pcm_samples(own, "data", fmt, F.col("channels"), big)
    return got.drop("data").withColumn("frame", F.col("frame") + F.col("first_frame"))
