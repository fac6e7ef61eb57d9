"""Level measurement: peak, RMS and DC offset, straight or from the partial sums of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measure(samples: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    """Peak, RMS and DC offset of v (fractions of full scale) for each key. One partial aggregation, one shuffle of
    three numbers a key and task; no group is ever collected."""
    x = F.col(v)
    return samples.groupBy(*keys).agg(
        F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("peak"),
        F.round(F.sqrt(F.avg(x * x)), 9).alias("rms"),
        F.round(F.avg(x), 9).alias("dc"),
    )


def measure_blocks(samples: DataFrame, block_frames: int = 16) -> DataFrame:
    """Partial sums of each block of a track, as a decoder that yields blocks would give them."""
    x = F.col("v")
    return samples.groupBy("track", F.floor(F.col("frame") / block_frames).alias("block")).agg(F.count("*").alias("n"), F.max(F.abs(x)).alias("peak"), F.sum(x * x).alias("power"), F.sum(x).alias("total"))


def combine_blocks(blocks: DataFrame) -> DataFrame:
    """Measures of tracks from the partial sums of their blocks."""
    n = F.sum("n")
    return blocks.groupBy("track").agg(F.max("peak").alias("peak"), F.round(F.sqrt(F.sum("power") / n), 9).alias("rms"), F.round(F.sum("total") / n, 9).alias("dc"))
