"""Positions: the last seek point at or before a frame, and packets from lacing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import SPAN, last_before, running_sum


def as_of(targets: DataFrame, points: DataFrame, key: str = "track", at: str = "frame", payload: str = "offset", span: int = SPAN) -> DataFrame:
    """targets with the payload and position (point) of the last point at or before them; both null before the first.
    Other columns of targets stay. A long key is worked range by range, and no range join is needed."""
    return last_before(targets, points, key, at, [payload], span)


def packets(lacing: DataFrame, stream: str, order: str, value: str, span: int = SPAN) -> DataFrame:
    """Packets of each stream: a lacing value below 255 ends one. (stream, packet, values, bytes, whole)"""
    ends = running_sum(lacing, stream, order, (F.col(value) < 255).cast("bigint"), "packet", inclusive=False, span=span)
    return ends.groupBy(stream, "packet").agg(F.count("*").alias("values"), F.sum(value).cast("bigint").alias("bytes"), F.max((F.col(value) < 255).cast("int")).cast("bigint").alias("whole"))


def last_granule(pages: DataFrame, stream: str, order: str, granule: str = "granule") -> DataFrame:
    """The last stated granule of each stream; null where none of its pages states one (null or -1)."""
    stated = F.when(F.col(granule) != -1, F.struct(F.col(order).alias("o"), F.col(granule).alias("g")))
    return pages.groupBy(stream).agg(F.max(stated)["g"].alias("granule"))


def bisect(targets: DataFrame, pages: DataFrame, key: str, granule: str = "granule") -> DataFrame:
    """For each target granule the offset of the page after the last page whose granule isn't above it; before the
    first such page, the first page with a granule. pages: (key, offset, next_offset, granule), -1: not stated."""
    stated = pages.where(F.col(granule).isNotNull() & (F.col(granule) != -1))
    # the first page is the answer of a place before all granules, so that targets need no second join by key
    lowest = F.lit(-(1 << 63)).cast("bigint")
    first = stated.groupBy(key).agg(F.min("offset").alias("next_offset")).select(key, lowest.alias("__place"), "next_offset")
    points = stated.select(key, F.col(granule).cast("bigint").alias("__place"), "next_offset").unionByName(first)
    own = targets.withColumn("__place", F.coalesce(F.col(granule).cast("bigint"), lowest))
    got = last_before(own, points, key, "__place", ["next_offset"])
    return got.withColumnRenamed("next_offset", "landing").drop("point", "__place")
