"""Running values over long keys, range by range: no task ever sorts a whole track.

Positions of a key are cut into ranges of ``span``. A window runs within each range, the few totals of a key's ranges are
added up, and each range takes what came before it by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def in_range(at: str, span: int = SPAN) -> Column:
    return F.floor(F.col(at) / span).alias("__range")


def running_sum(df: DataFrame, key: str, at: str, value: Column, name: str, inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """df with name: the sum of value over all earlier positions of the key and, if inclusive, its own; nulls count 0."""
    own = df.withColumn("__range", in_range(at, span)).withColumn("__value", F.coalesce(value, F.lit(0)))
    totals = own.groupBy(key, "__range").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carried"))
    within = Window.partitionBy(key, "__range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = own.withColumn("__local", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    out = local.join(carried, [key, "__range"]).withColumn(name, F.col("__local") + F.col("__carried"))
    return out.select(*[c for c in df.columns if c != name], name)


def with_previous(df: DataFrame, key: str, at: str, value: str, n: int, span: int = SPAN) -> DataFrame:
    """df with __p1 to __pn: the value at the n positions before, 0 before the first. Positions count up by one. The last
    n rows of a range, which has n at least, are sent to the next one as well."""
    span = max(span, n)
    own = df.withColumn("__range", in_range(at, span))
    ahead = F.when(F.col(at) % span >= span - n, F.array(F.col("__range"), F.col("__range") + 1)).otherwise(F.array("__range"))
    both = own.withColumn("__to", F.explode(ahead))
    w = Window.partitionBy(key, "__to").orderBy(at)
    lags = [F.coalesce(F.lag(value, k).over(w), F.lit(0)).alias(f"__p{k}") for k in range(1, n + 1)]
    return both.select("*", *lags).where("__to = __range").drop("__to", "__range")


def last_before(targets: DataFrame, points: DataFrame, key: str, at: str, payload: list[str], span: int = SPAN) -> DataFrame:
    """targets with point (the position of the last of points at or before them) and its payload columns; null before
    the first. All columns of targets stay. Of points at one position any may count. However many targets a key has at one
    position, that position is looked up once, so that a range holds no more than its positions."""
    held = F.struct(F.col(at).alias("point"), *payload)
    p = points.groupBy(key, at).agg(F.max(held).alias("__held")).withColumn("__range", in_range(at, span))
    last = p.groupBy(key, "__range").agg(F.max("__held").alias("__last"))
    places = targets.select(key, at).distinct().withColumn("__range", in_range(at, span))
    none = F.lit(None).cast(last.schema["__last"].dataType)
    marks = places.select(key, "__range").distinct().withColumn("__last", none)
    ranges = last.unionByName(marks).groupBy(key, "__range").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(key, "__range", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    both = places.withColumns({"__held": none, "__kind": F.lit(1)}).unionByName(p.withColumn("__kind", F.lit(0)))
    w = Window.partitionBy(key, "__range").orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__held", ignorenulls=True).over(w)).where("__kind = 1").join(carried, [key, "__range"], "left")
    got = near.select(F.col(key).alias("__of"), F.col(at).alias("__at"), F.coalesce("__near", "__carried").alias("__got"))
    out = targets.join(got, F.col(f"`{key}`").eqNullSafe(F.col("__of")) & F.col(f"`{at}`").eqNullSafe(F.col("__at")))
    return out.select(*[F.col(f"`{c}`") for c in targets.columns], F.col("__got")["point"].alias("point"), *[F.col("__got")[c].alias(c) for c in payload])
