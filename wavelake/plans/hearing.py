"""Queries that compare tracks: lags, spectrograms and similarities, with SQL that sums each of them up in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectra
from ..sources import tables as t
from .catalogue import query


def whole(spark, d):
    return t.float_tracks(spark, d).withColumn("v", F.floor(F.col("v") * 256).cast("double"))


WHOLE_SQL = f"(SELECT track, frame, floor(v * 256) AS v FROM {t.FLOAT_SQL})"


@query(
    "track_lag",
    f"""WITH r AS {WHOLE_SQL}, d AS (SELECT track, frame + track % 9 - 4 AS frame, v FROM r WHERE frame + track % 9 - 4 >= 0),
    c AS (SELECT r.track, d.frame - r.frame AS lag, sum(r.v * d.v) AS c FROM r JOIN d ON r.track = d.track GROUP BY ALL),
    n AS (SELECT track, sqrt(a * b) AS n FROM (SELECT track, sum(v * v) AS a FROM r GROUP BY track) JOIN (SELECT track, sum(v * v) AS b FROM d GROUP BY track) USING (track))
    SELECT track, lag, round(c / n, 6) AS correlation FROM c JOIN n USING (track) QUALIFY row_number() OVER (PARTITION BY track ORDER BY c DESC, lag < 0, lag) = 1""",
)
def track_lag(spark, d):
    ref = whole(spark, d)
    test = ref.withColumn("frame", F.col("frame") + F.col("track") % 9 - 4).where("frame >= 0")
    return spectra.lags(ref, test).withColumn("correlation", F.round("correlation", 6))


@query(
    "spectrogram",
    f"""WITH f AS (SELECT track, t, frame - 16 * t AS i, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (frame - 16 * t) / 31)) AS x FROM {WHOLE_SQL}, range(0, 3) r(t) WHERE frame BETWEEN 16 * t AND 16 * t + 31),
    p AS (SELECT track, t, k, (power(sum(x * cos(2 * pi() * i * k / 32)), 2) + power(sum(x * sin(2 * pi() * i * k / 32)), 2)) / 12 AS p FROM f, range(0, 17) l(k) GROUP BY ALL),
    ends AS (SELECT log10(4.37::DOUBLE * 50 / 1000 + 1) AS a, log10(4.37::DOUBLE * 3800 / 1000 + 1) AS z),
    c AS (SELECT b, (power(10::DOUBLE, a + b * (z - a) / 7) - 1) * 1000 / 4.37::DOUBLE AS c FROM ends, range(0, 8) l(b)),
    w AS (SELECT b, k, power(1 + power((k * 250 - c) / (1.019::DOUBLE * 24.7::DOUBLE * (4.37::DOUBLE * c / 1000 + 1)), 2), -4) AS w FROM c, range(0, 17) l(k))
    SELECT track, t, b AS band, round(10 * log10(sum(p * w / n) + 0.001::DOUBLE), 4) AS level FROM p JOIN (SELECT *, sum(w) OVER (PARTITION BY b) AS n FROM w) USING (k) GROUP BY track, t, b""",
)
def spectrogram(spark, d):
    levels = spectra.spectrogram(whole(spark, d), 8000, nfft=32, bands=8)
    each = levels.select("track", "t", F.posexplode("v").alias("band", "level"))
    return each.select("track", "t", F.col("band").cast("bigint").alias("band"), F.round("level", 4).alias("level"))


_SUMS = ", ".join(f"sum({c}) OVER w AS {c}" for c in ("r", "d", "rr", "dd", "rd"))


@query(
    "similarity",
    f"""WITH e AS (SELECT vec_id // 100 AS track, vec_id % 100 AS t, generate_subscripts(embedding, 1) - 1 AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    x AS (SELECT track, t, band, greatest(300 * v, 0) AS r, greatest(4 * floor(75 * v), 0) AS d FROM e),
    h AS (SELECT track, t, band, {_SUMS} FROM (SELECT *, r * r AS rr, d * d AS dd, r * d AS rd FROM x) WINDOW w AS (PARTITION BY track, t ORDER BY band ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    b AS (SELECT track, t, band, lead(t, 2) OVER w AS far, {_SUMS} FROM h WHERE band < 62 WINDOW w AS (PARTITION BY track, band ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    m AS (SELECT track, t, r / 9 AS r, d / 9 AS d, greatest(rr / 9 - r * r / 81, 0) AS vr, greatest(dd / 9 - d * d / 81, 0) AS vd, rd / 9 - r * d / 81 AS c FROM b WHERE far = t + 2),
    s AS (SELECT track, t, sum((2 * r * d + 1) / (r * r + d * d + 1) * (c + 4.5::DOUBLE) / (sqrt(vr * vd) + 4.5::DOUBLE)) AS s FROM m GROUP BY track, t)
    SELECT track, round(avg(s), 6) AS similarity, count(*) AS patches FROM
      (SELECT track, p, sum(s) / (30 * 62) AS s FROM s, range(0, 5) l(p) WHERE t BETWEEN 16 * p AND 16 * p + 29 GROUP BY track, p HAVING count(*) = 30) GROUP BY track""",
)
def similarity(spark, d):
    v = F.col("embedding")
    e = t.read(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 100).alias("track"),
        (F.col("vec_id") % 100).alias("t"),
        F.transform(v, lambda x: x.cast("double") * 300).alias("ref"),
        F.transform(v, lambda x: F.floor(x.cast("double") * 75) * F.lit(4.0)).alias("test"),
    )
    return spectra.similarity(e, bands=64).withColumn("similarity", F.round("similarity", 6))


def long_track(spark, d):
    """All events as one track of two channels, and the same in coarser steps, 37 frames late."""
    e = t.read(spark, d, "events").select(F.lit(0).alias("track"), F.col("event_id").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"), "value")
    ref = e.select("track", "ch", "frame", (F.floor(F.col("value") * 10) * (F.col("ch") + 1)).cast("double").alias("v"))
    return ref, ref.select("track", "ch", (F.col("frame") + 37).alias("frame"), (F.floor(F.col("v") / 64) * 64).alias("v"))


@query("track_score")
def track_score(spark, d):
    """One track as long as the table, so that all of its work is in ranges; tested against plain numpy."""
    return spectra.score(*long_track(spark, d), rate=8000).withColumn("similarity", F.round("similarity", 6))
