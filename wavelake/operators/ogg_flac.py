"""FLAC in Ogg (mapping 1): packets as metadata blocks and frames, in the columns that the native forms have, so that their operators
take them from there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files as src
from ..sources.flac_frames import crc16, header
from .containers import comments_ok, cuesheet_ok, picture, streaminfo

FIELDS = "serial bigint, packet bigint, type int, last boolean, size bigint, data binary, number bigint, variable boolean, block_size int, sample_rate int, assignment int, depth int, header int"


def _packets(b: bytes) -> Iterator[tuple]:
    heads: dict[int, bool] = {}  # whether metadata blocks still come
    for serial, n, _, data in src.ogg_packets(b):
        if n == 0:
            if data[:6] != b"\x7fFLAC\x01" or data[9:13] != b"fLaC" or len(data) < 51:
                continue
            heads[serial], data = True, data[13:]
        if serial not in heads:
            continue
        if heads[serial] and data[:1] != b"\xff":
            last = data[:1] >= b"\x80"
            heads[serial] = not last
            yield serial, n, data[0] & 127 if data else 127, last, int.from_bytes(data[1:4], "big") if len(data) > 3 else 1, data[4:], *[None] * 7
        else:
            heads[serial] = False
            own = header(data[:16])
            if own and crc16(data) == 0:
                variable, number, *rest = own
                yield serial, n, None, None, len(data), data, number, variable, *rest


def packets(files: DataFrame, content: str | None = "content") -> DataFrame:
    """files with a row for each packet of their FLAC streams (FIELDS). Metadata blocks have a type, and data without the
    block's head; they end with the one marked last, or at the first frame. Frames have no type; one whose header or
    checksum is wrong is missing, and the others stay. Files without such streams give no rows."""
    return src.walked(files, FIELDS, _packets, content)


def scan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, serial, result, fields of STREAMINFO) of the streams of packets(). A block that is shorter than it says, and
    comments, pictures or cue sheets that hold other than their lengths say, are CORRUPT; so is a stream that ends before
    the last block."""
    kind, data = F.col("type"), F.substring("data", F.lit(1), F.col("size").cast("int"))
    broken = (kind == 4) & ~comments_ok(data) | (kind == 6) & picture(data)["data"].isNull() | (kind == 5) & ~cuesheet_ok(data) | (F.length("data") < F.col("size"))
    marked = rows.withColumn("__broken", F.coalesce(kind.isNotNull() & broken, F.lit(False)))
    got = marked.groupBy(*keys, "serial").agg(F.max(F.when((F.col("packet") == 0) & (kind == 0), data)).alias("info"), F.max("__broken").alias("broken"), F.max(kind.isNull() | F.coalesce("last", F.lit(False))).alias("ended"))
    f = streaminfo(F.col("info"))
    result = F.when(F.col("info").isNull() | F.col("broken") | ~F.col("ended"), "CORRUPT").otherwise(f["result"])
    fields = [F.when(result == "OK", v).alias(k) for k, v in f.items() if k != "result"]
    return got.select(*keys, "serial", result.alias("result"), *fields)


def frames(rows: DataFrame, key: str) -> DataFrame:
    """(stream, offset, length, number, variable, first_sample, block_size, sample_rate, assignment, depth, header, data):
    the frames of packets(), as the native index and frame_data() give them. stream is (key, serial), and offset is the
    packet's number."""
    own = rows.where("type IS NULL").withColumn("stream", F.struct(F.col(f"`{key}`").alias("key"), "serial"))
    size = F.max(F.when(~F.col("variable"), F.col("block_size"))).over(Window.partitionBy("stream"))  # all but the last have it
    placed = own.withColumn("first_sample", F.when(F.col("variable"), F.col("number")).otherwise(F.col("number") * size))
    return placed.select("stream", F.col("packet").alias("offset"), F.col("size").alias("length"), "number", "variable", "first_sample", "block_size", "sample_rate", "assignment", "depth", "header", "data")
