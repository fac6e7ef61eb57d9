"""Where the packets of Ogg streams lie in time, and where a decoder starts for a seek. Pages state positions only at
their ends, so they are carried from there through the packets' durations, range by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import u8
from ..functions.headers import opus_toc
from .ranges import SPAN, last_before, running_sum, with_previous

#: Samples at 48 kHz that an Opus decoder needs before it is what a straight reading gives.
PRE_ROLL = 3840


def opus_duration(data: Column) -> Column:
    """Samples at 48 kHz of an Opus packet: its frames, by the code or in code 3 the count behind the first byte, times
    their size. Null for empty packets, a count of 0 or none, and more than 120 ms."""
    toc = opus_toc(u8(data, 0))
    count = F.when(toc["code"] == 0, 1).when(toc["code"] < 3, 2).when(F.length(data) > 1, u8(data, 1).cast("int").bitwiseAND(63))
    total = (count * toc["frame_size"]).cast("bigint")
    return F.when((F.length(data) > 0) & total.between(1, 5760), total)


def with_vorbis_durations(packets: DataFrame, key: str, order: str = "packet", block: str = "block", span: int = SPAN) -> DataFrame:
    """packets with duration: a quarter of the block before and a quarter of the own one, and nothing for a stream's first.
    Packets are numbered from 0 up by one."""
    near = with_previous(packets, key, order, block, 1, span)
    own = F.when(F.col(order) > 0, F.floor((F.col("__p1") + F.col(block)) / 4)).otherwise(0).cast("bigint")
    return near.withColumn("duration", own).select(*[c for c in packets.columns if c != "duration"], "duration")


def packet_positions(packets: DataFrame, key: str, order: str = "packet", duration: str = "duration", granule: str = "granule", span: int = SPAN) -> DataFrame:
    """packets with start and end, in the numbers of their stream's granules.

    A granule is where the last packet that ends on a page ends; earlier ones are counted back from it. The last granule
    of a stream is its length, which may be less than its packets give, so it counts only as that: packets behind the
    last granule but one are counted on from it. A stream with one granule or none starts at 0. Null durations count 0;
    null and -1 state no granule. Packets are numbered without repeats from 0; rows with a null key or number go."""
    own = packets.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    summed = running_sum(own, key, order, F.col(duration), "__sum", span=span)
    stated = summed.where(F.col(granule) != -1).select(key, order, (F.col(granule) - F.col("__sum")).alias("__shift"))
    length = stated.groupBy(key).agg(F.max(order).alias("__last"))
    anchors = stated.join(length, key).where(F.col(order) < F.col("__last")).select(key, order, "__shift")
    # the next anchor at or behind a packet is the last one before it when numbers run backwards
    turned = summed.withColumn("__turned", -F.col(order))
    ahead = last_before(turned, anchors.select(key, (-F.col(order)).alias("__turned"), F.col("__shift").alias("__ahead")), key, "__turned", ["__ahead"], span)
    both = last_before(ahead.drop("point"), anchors.withColumnRenamed("__shift", "__behind"), key, order, ["__behind"], span)
    end = (F.col("__sum") + F.coalesce("__ahead", "__behind", F.lit(0))).cast("bigint")
    out = both.withColumn("start", end - F.coalesce(F.col(duration), F.lit(0))).withColumn("end", end)
    return out.select(*[c for c in packets.columns if c not in ("start", "end")], "start", "end")


def landings(pages: DataFrame, key: str, order: str = "number", granule: str = "granule", flags: str = "flags") -> DataFrame:
    """(key, position, offset): the pages that a decoder can start on, and the granule that they start at: those behind a
    page with a granule that don't begin within a packet. A page behind a missing one is none."""
    starts = pages.where(F.col(flags).bitwiseAND(1) == 0).select(F.col(key), F.col(order), "offset")
    before = pages.where(F.col(granule) != -1).select(F.col(key), (F.col(order) + 1).alias(order), F.col(granule).alias("position"))
    return starts.join(before, [key, order]).groupBy(key, "position").agg(F.min("offset").alias("offset"))


def seek(targets: DataFrame, points: DataFrame, key: str, margin: int = PRE_ROLL, skip: Column | None = None, frame: str = "frame", span: int = SPAN) -> DataFrame:
    """targets with offset, position and discard: the page to decode from, the frame that it starts at, and how many
    frames to decode before the target. Offset is null where it's the stream's start, and all frames before the target
    are then discarded.

    The page is the last of points (landings()) that starts margin before the target at least: 3,840 for Opus, whose skip
    is the stream's pre-skip, and two long blocks for Vorbis, where the first block behind a landing gives nothing but
    its lap. A point at or before skip is the start. Columns of targets stay, but for the three."""
    lead = skip if skip is not None else F.lit(0)
    kept = [c for c in targets.columns if c not in ("offset", "position", "discard")]
    wanted = targets.select(*kept, lead.cast("bigint").alias("__skip")).withColumn("position", F.greatest(F.col(frame) + F.col("__skip") - margin, F.lit(0)).cast("bigint"))
    got = last_before(wanted, points.select(key, "position", "offset"), key, "position", ["offset"], span)
    far = F.col("point") > F.col("__skip")
    at = F.when(far, F.col("point") - F.col("__skip")).otherwise(0)
    return got.select(*kept, F.when(far, F.col("offset")).alias("offset"), at.cast("bigint").alias("position"), (F.col(frame) - at).cast("bigint").alias("discard"))
