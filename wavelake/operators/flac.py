"""FLAC frames as rows: an index of confirmed frames made range by range, landing on the frame of a sample, the subframes
of frames, the samples of subframes, and channels put back from the four stereo assignments."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import flac_frames as src
from ..sources import flac_subframes as sub
from ..sources.byte_ranges import pieces, read_ranges
from ..sources.files import each, walked
from .ranges import last_before

#: Bytes of a range, about a megabyte.
SPAN = 32 * src.ORDER


def frame_index(files: DataFrame, key: str, content: str | None = "content", span: int = SPAN) -> DataFrame:
    """(key, offset, length, number, variable, first_sample, block_size, sample_rate, assignment, depth, header): the frames
    of FLAC files whose CRC-8 and CRC-16 are right, the same for any span, which is a multiple of 32,767 bytes. header is
    the length of a frame's header; rate and depth are null where only STREAMINFO has them.

    Each range of a file is searched by itself. A frame ends where the next number of the same mark starts (see
    sources.flac_frames), or else at the end of the file, so frames meet their successors by number. Files are searched
    once and their headers shuffled once, by file: a task holds about a hundred bytes a frame of a file, on disk if they are
    many, and never its bytes. A damaged frame is missing and those behind it are found. Null, empty and other contents have no frames;
    of files with bytes behind the last frame that frame is missing. Keys are unique and not null; other columns go."""
    if span % src.ORDER or span <= 0:
        raise ValueError(f"span must be a multiple of {src.ORDER}")
    k = F.col(f"`{key}`")
    if content:
        c = F.col(f"`{content}`").cast("binary")
        cut = files.where(F.length(c) > 0).select(k.alias("__key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.length(c) - 1) / span))).alias("__range"), c.alias("__all"))
        ranges = cut.select("__key", "__range", F.substring(F.col("__all"), (F.col("__range") * span + 1).cast("int"), F.lit(span + src.HALO)).alias("data"))
    else:
        own = files.select(k.alias("__key"), "path", "length")
        cut = pieces(own, F.lit(0).cast("bigint"), F.col("length"), span).withColumn("__range", F.floor(F.col("start") / span))
        ranges = read_ranges(cut.withColumn("stop", F.col("stop") + src.HALO)).select("__key", "__range", "data")
    found = walked(ranges, src.FIELDS, partial(src.candidates, span=span), "data")

    # marks and places from the start of the file on: a range's end comes behind its headers, and adds to those behind it
    own = Window.partitionBy("__key")
    add = F.when(F.col("number").isNull(), F.col("mark"))
    carried = F.coalesce(F.bit_xor(add).over(own.orderBy("__range", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.select("*", (F.col("__range") * span + F.col("place")).alias("offset"), carried.alias("__carried")).withColumn("mark", F.col("mark").bitwiseXOR(F.col("__carried")))
    ended = placed.withColumn("__end", F.max(F.when(F.col("number").isNull(), F.struct("__range", F.col("offset").alias("end"), "mark"))).over(own))
    heads = ended.where("number IS NOT NULL").drop("__range", "place", "__carried")

    # each header is a successor of its own number, and looks for the next number behind it
    follows = F.col("number") + F.when(F.col("variable"), F.col("block_size")).otherwise(1)
    roles = F.explode(F.array(F.struct(F.col("number").alias("n"), F.lit(True).alias("there")), F.struct(follows.alias("n"), F.lit(False).alias("there")))).alias("__role")
    behind = Window.partitionBy("__key", "mark", "variable", "__role.n").orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, -1)
    met = heads.select("*", roles).withColumn("__next", F.last(F.when(F.col("__role.there"), F.col("offset")), ignorenulls=True).over(behind)).where("NOT __role.there")
    done = met.withColumn("stop", F.coalesce("__next", F.when(F.col("__end.mark") == F.col("mark"), F.col("__end.end")))).where("stop IS NOT NULL")

    # of a fixed size only the last frame may be shorter, so the largest is the size that numbers count in
    size = F.max(F.when(~F.col("variable"), F.col("block_size"))).over(own)
    sized = done.withColumn("first_sample", F.when(F.col("variable"), F.col("number")).otherwise(F.col("number") * size))
    return sized.select(F.col("__key").alias(key), "offset", (F.col("stop") - F.col("offset")).alias("length"), "number", "variable", "first_sample", "block_size", "sample_rate", "assignment", "depth", "header")


def seek_frame(targets: DataFrame, frames: DataFrame, key: str, sample: str = "sample") -> DataFrame:
    """targets with offset (of the last frame that starts at or before a sample; null before the first) and skip, the samples
    of it to leave out; found is false where the sample lies behind that frame's end, in a damaged one or past the last."""
    points = frames.select(key, F.col("first_sample").alias(sample), F.col("offset").alias("__offset"), F.col("block_size").alias("__size"))
    got = last_before(targets, points, key, sample, ["__offset", "__size"])
    skip = F.col(sample) - F.col("point")
    return got.withColumns({"offset": F.col("__offset"), "skip": skip, "found": F.coalesce(skip < F.col("__size"), F.lit(False))}).drop("point", "__offset", "__size")


def frame_data(files: DataFrame, frames: DataFrame, key: str, content: str | None = "content") -> DataFrame:
    """frames of frame_index() with data, their bytes. Of files by path each task reads the bytes of its own frames."""
    if content:
        c = files.select(key, F.col(f"`{content}`").alias("__all"))
        return frames.join(c.hint("merge"), key).select(*frames.columns, F.substring("__all", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")).alias("data"))
    own = frames.join(files.select(key, "path"), key).withColumns({"__start": F.col("offset"), "__stop": F.col("offset") + F.col("length")})
    return read_ranges(own, start="__start", stop="__stop").select(*frames.columns, "data")


def subframes(frames: DataFrame, key: str, depth=None) -> DataFrame:
    """(key, offset, first_sample, block_size, assignment, depth, channel, result, kind, order, wasted, shift, coefficients,
    warm, partitions, residuals): each channel of frames with data. warm: the first samples, all of a verbatim channel, or
    the constant. partitions: k of each Rice partition, or null and the width of its plain numbers, and how many. result
    is OK, CORRUPT or UNSUPPORTED; the latter without fields, and no later channel of that frame follows. depth: what to
    take where a frame states none; frames without any, and null data, give no rows."""
    return each(_readable(frames, key, depth), ["data", "block_size", "assignment", "depth", "header"], sub.FIELDS, sub.subframes).drop("header", "data")


def _readable(frames: DataFrame, key: str, depth) -> DataFrame:
    own = frames.withColumn("depth", F.coalesce("depth", F.lit(None).cast("int") if depth is None else depth).cast("int"))
    return own.where("depth IS NOT NULL AND data IS NOT NULL").select(key, "offset", "first_sample", "block_size", "assignment", "depth", "header", "data")


def whole_frame_samples(frames: DataFrame, key: str, depth=None) -> DataFrame:
    """(key, frame, ch, v): what frame_samples() gives for all channels of frames with data. A frame's channels stay in its
    row, so nothing is shuffled."""
    return _heard(each(_readable(frames, key, depth), ["data", "block_size", "assignment", "depth", "header"], "x array<array<bigint>>", sub.channels), key)


def channel_samples(parts: DataFrame) -> DataFrame:
    """Rows of subframes() whose result is OK, with x, the array of the channel's samples as the frame carries them, in place
    of what they are made from."""
    made = ["kind", "order", "wasted", "shift", "coefficients", "warm", "partitions", "residuals"]
    needs = ["kind", "block_size", "order", "wasted", "shift", "coefficients", "warm", "residuals"]
    got = each(parts.where("result = 'OK'"), needs, "x array<bigint>", lambda *v: [(sub.rebuilt(*v),)])
    return got.drop("result", *made)


def frame_samples(channels: DataFrame, key: str) -> DataFrame:
    """(key, frame, ch, v): samples from rows of channel_samples(), numbered from the start of the track; left, right, mid and
    side are told apart by the frame's assignment. A frame that lacks a channel gives no samples. A group holds the
    channels of one frame, eight at most."""
    got = channels.groupBy(key, "offset", "first_sample", "assignment").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda c: c["x"]).alias("x"))
    return _heard(got, key)


def _heard(got: DataFrame, key: str) -> DataFrame:
    count = F.when(F.col("assignment") < 8, F.col("assignment") + 1).otherwise(2)
    a, b = F.get("x", 0), F.get("x", 1)
    two = lambda use: F.zip_with(a, b, use)
    total = lambda m, s: m * 2 + s.bitwiseAND(F.lit(1))
    both = (
        F.when(F.col("assignment") == 8, F.array(a, two(lambda left, side: left - side)))
        .when(F.col("assignment") == 9, F.array(two(lambda side, right: side + right), b))
        .when(F.col("assignment") == 10, F.array(two(lambda m, s: F.shiftright(total(m, s) + s, 1)), two(lambda m, s: F.shiftright(total(m, s) - s, 1))))
        .otherwise(F.col("x"))
    )
    each = got.where(F.size("x") == count).select(key, "first_sample", F.posexplode(both).alias("ch", "own"))
    return each.select(key, "first_sample", "ch", F.posexplode("own").alias("at", "v")).select(key, (F.col("first_sample") + F.col("at")).alias("frame"), "ch", "v")
