"""Lossless prediction over sample rows: fixed predictors, stereo decorrelation, Rice costs and block tests."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import zigzag
from .ranges import SPAN, running_sum, with_previous

BLOCK = 16


def residual(samples: DataFrame, order: int, span: int = SPAN) -> DataFrame:
    """(track, frame, r): what the fixed predictor of an order leaves; samples before a track's start are 0."""
    near = with_previous(samples, "track", "frame", "x", order, span) if order else samples
    r = sum(((-1) ** k * comb(order, k) * F.col(f"__p{k}") for k in range(1, order + 1)), F.col("x"))
    return near.select("track", "frame", r.cast("bigint").alias("r"))


def reconstruct(residuals: DataFrame, order: int, span: int = SPAN) -> DataFrame:
    """(track, frame, x): the samples back, a running sum for each order, range by range."""
    out = residuals.select("track", "frame", F.col("r").alias("x"))
    for _ in range(order):
        out = running_sum(out, "track", "frame", F.col("x"), "x", span=span)
    return out.select("track", "frame", F.col("x").cast("bigint").alias("x"))


def rice_costs(residuals: DataFrame, most: int = 14) -> DataFrame:
    """(track, block, k, bits): the bits of each block of residuals under each Rice parameter. The sums of all
    parameters come from one aggregation."""
    z = zigzag(F.col("r"))
    sums = [F.sum(F.shiftright(z, k) + 1 + k).cast("bigint").alias(str(k)) for k in range(most + 1)]
    blocks = residuals.groupBy("track", F.floor(F.col("frame") / BLOCK).alias("block")).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(str(k)).alias("bits")) for k in range(most + 1)]))
    return blocks.select("track", "block", each.alias("e")).select("track", "block", "e.k", "e.bits")


def best_rice(residuals: DataFrame) -> DataFrame:
    """The cheapest parameter of each block; the smallest of equal ones."""
    return rice_costs(residuals).groupBy("track", "block").agg(F.min(F.struct("bits", "k")).alias("m")).select("track", "block", F.col("m.k").alias("k"), F.col("m.bits").alias("bits"))


def mid_side(stereo: DataFrame) -> DataFrame:
    return stereo.select("track", "frame", F.shiftright(F.col("l") + F.col("r"), 1).alias("mid"), (F.col("l") - F.col("r")).alias("side"))


def left_right(ms: DataFrame) -> DataFrame:
    """Back from mid and side; the sum's low bit, which mid lost, is that of side."""
    total = F.col("mid") * 2 + F.col("side").bitwiseAND(1)
    return ms.select("track", "frame", F.shiftright(total + F.col("side"), 1).alias("l"), F.shiftright(total - F.col("side"), 1).alias("r"))


def stereo_assignment(stereo: DataFrame) -> DataFrame:
    """For each block the cheapest of independent, left/side, side/right and mid/side by the sum of magnitudes; of
    equal ones the earlier."""
    d = stereo.withColumns({"mid": F.shiftright(F.col("l") + F.col("r"), 1), "side": F.col("l") - F.col("r")})
    cost = {c: F.sum(F.abs(F.col(c))) for c in ("l", "r", "mid", "side")}
    plans = [cost["l"] + cost["r"], cost["l"] + cost["side"], cost["side"] + cost["r"], cost["mid"] + cost["side"]]
    got = d.groupBy("track", F.floor(F.col("frame") / BLOCK).alias("block")).agg(F.least(*[F.struct(p.cast("bigint").alias("cost"), F.lit(i).cast("bigint").alias("plan")) for i, p in enumerate(plans)]).alias("m"))
    return got.select("track", "block", F.col("m.plan").alias("plan"), F.col("m.cost").alias("cost"))


def block_facts(samples: DataFrame) -> DataFrame:
    """For each block: whether it is constant, and how many low bits are zero in all its samples."""
    got = samples.groupBy("track", F.floor(F.col("frame") / BLOCK).alias("block")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.bit_or("x").alias("all"))
    low = F.col("all").bitwiseAND(-F.col("all"))
    return got.select("track", "block", (F.col("lo") == F.col("hi")).alias("constant"), F.when(F.col("all") == 0, 0).otherwise(F.floor(F.log2(low) + 0.5)).cast("bigint").alias("wasted"))


#: The two codings of a residual: bits of a parameter, and the greatest one.
CODINGS = ((4, 14), (5, 30))


def residual_plan(residuals: DataFrame, order: int, block: int = 4096, most: int = 8) -> DataFrame:
    """(track, block, size, method, partition_order, bits, partitions): how each block of residuals (track, frame, r) of a
    fixed predictor of an order is written with the fewest bits; of equal plans that with the fewer partitions, then the
    smaller method. partitions has k of each Rice partition, or null and the width of its plain numbers.

    The first ``order`` places of a block are its warm-up, whatever residuals they have. A parameter is searched two up and
    down from the bits of the mean. The last block may be shorter, and takes only such partition orders as divide it; one
    no longer than its warm-up has no plan. Sums of the finest partitions are made once, and added up for coarser ones.
    Null residuals are an error of the input and their partition's sums leave them out."""
    at = F.col("frame") % block
    sized = residuals.select("track", F.floor(F.col("frame") / block).alias("block"), at.alias("at"), zigzag(F.col("r")).alias("z"))
    sized = sized.withColumn("size", F.count("*").over(Window.partitionBy("track", "block")))  # a block, of bounded size
    fits = [F.when((F.col("size") % (1 << o) == 0) & (F.floor(F.col("size") / (1 << o)) > order), o) for o in reversed(range(most + 1))]
    fine = sized.withColumn("finest", F.coalesce(*fits)).where(F.col("finest").isNotNull() & (F.col("at") >= order))
    place = F.floor(F.col("at") / F.floor(F.col("size") / F.pow(F.lit(2.0), F.col("finest"))))
    names = [f"s{k}" for k in range(CODINGS[-1][1] + 1)]
    sums = fine.groupBy("track", "block", "size", "finest", place.alias("place")).agg(F.count("*").alias("n"), F.max("z").alias("top"), *[F.sum(F.shiftright("z", k)).alias(c) for k, c in enumerate(names)])

    coarser = sums.withColumn("partition_order", F.explode(F.sequence(F.lit(0), F.col("finest"))))
    place = F.floor(F.col("place") / F.pow(F.lit(2.0), F.col("finest") - F.col("partition_order")))
    own = coarser.groupBy("track", "block", "size", "partition_order", place.alias("place")).agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.array(*[F.sum(c) for c in names]).alias("sums"))

    length = lambda v: F.when(v > 0, F.length(F.bin(v))).otherwise(0)
    own = own.withColumns({"mean": length(F.floor(F.get("sums", 0) / F.col("n"))), "width": F.when(F.col("top") > 0, 1 + length(F.shiftright("top", 1))).otherwise(0)})
    plans = []
    for method, (bits, limit) in enumerate(CODINGS):
        guess = F.least("mean", F.lit(limit))
        tried = F.transform(F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, F.lit(limit))), lambda k: F.struct((F.get("sums", k) + F.col("n") * (k + 1)).alias("bits"), k.alias("k")))
        best = F.array_min(tried)
        plain = 5 + F.col("n") * F.col("width")
        escapes = (F.col("width") <= 32) & (plain < best["bits"])
        plans.append(F.struct(F.lit(method).alias("method"), (bits + F.when(escapes, plain).otherwise(best["bits"])).alias("bits"), F.when(~escapes, best["k"]).alias("k"), F.when(escapes, F.col("width")).alias("width")))
    each = own.select("track", "block", "size", "partition_order", "place", F.explode(F.array(*plans)).alias("p"))
    whole = each.groupBy("track", "block", "size", "partition_order", "p.method").agg((F.sum("p.bits") + 6).alias("bits"), F.array_sort(F.collect_list(F.struct("place", "p.k", "p.width"))).alias("own"))
    parts = F.transform("own", lambda x: F.struct(x["k"].alias("k"), x["width"].alias("width"))).alias("partitions")
    least = whole.groupBy("track", "block", "size").agg(F.min(F.struct("bits", "partition_order", "method", parts)).alias("m"))
    return least.select("track", "block", "size", "m.method", "m.partition_order", "m.bits", "m.partitions")
