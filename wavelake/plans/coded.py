"""Queries that write coded blocks, with SQL that goes through each block sample by sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import IMA_MOVES, IMA_STEPS, MS_FACTORS
from ..operators import encode
from ..sources import tables as t
from .catalogue import query


def blocks_sql(frames: int) -> str:
    return f"""b AS (SELECT track, frame // {frames} AS block, list(x ORDER BY frame) AS xs FROM {t.MONO_SQL} GROUP BY ALL),
    m AS (SELECT *, len(xs) AS n, CASE WHEN len(xs) < 2 THEN 0 ELSE CAST(list_sum([abs(xs[k + 1] - xs[k]) FOR k IN range(1, len(xs))]) AS BIGINT) // (len(xs) - 1) END AS mean FROM b)"""


IMA_SQL = f"""WITH RECURSIVE {blocks_sql(64)},
    c AS (SELECT *, CAST(floor(xs[1] / 128::DOUBLE) AS BIGINT) * 128 AS p0, CASE WHEN n < 2 THEN 0 ELSE (SELECT arg_min(k, abs(mean - {list(IMA_STEPS)}[k + 1]) * 100 + k) FROM range(0, 89) r(k)) END AS i0 FROM m),
    r AS (SELECT track, block, xs, 0 AS f, CAST(p0 AS BIGINT) AS p, CAST(i0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS nib FROM c
      UNION ALL SELECT track, block, xs, f + 1, CAST(greatest(-32768, least(32767, CASE WHEN g < 0 THEN p - d ELSE p + d END)) AS BIGINT), CAST(greatest(0, least(88, i + {list(IMA_MOVES)[:8]}[told + 1])) AS BIGINT), CAST(told + CASE WHEN g < 0 THEN 8 ELSE 0 END AS BIGINT)
      FROM (SELECT *, st // 8 + b4 * st + b2 * (st // 2) + b1 * (st // 4) AS d, 4 * b4 + 2 * b2 + b1 AS told
        FROM (SELECT *, CAST(abs(g) - b4 * st - b2 * (st // 2) >= st // 4 AS INT) AS b1
          FROM (SELECT *, CAST(abs(g) - b4 * st >= st // 2 AS INT) AS b2
            FROM (SELECT *, CAST(abs(g) >= st AS INT) AS b4
              FROM (SELECT *, {list(IMA_STEPS)}[i + 1] AS st, coalesce(xs[f + 1], p) - p AS g FROM r WHERE f < 64))))))
    SELECT track, block, n AS frames, data FROM (SELECT track, block, upper(printf('%04x', (any_value(p0) & 65408) | any_value(i0))) || string_agg(byte, '' ORDER BY f) AS data, any_value(n) AS n
      FROM (SELECT track, block, (f - 1) // 2 AS f, upper(printf('%02x', CAST(sum(CASE WHEN f % 2 = 1 THEN nib ELSE 16 * nib END) AS BIGINT))) AS byte FROM r WHERE f > 0 GROUP BY track, block, (f - 1) // 2) JOIN c USING (track, block) GROUP BY track, block)"""

MS_SQL = f"""WITH RECURSIVE {blocks_sql(82)},
    c AS (SELECT *, greatest(16, least(32767, mean // 4)) AS d0, coalesce(xs[2], xs[1]) AS s0 FROM m),
    r AS (SELECT track, block, xs, 2 AS f, CAST(s0 AS BIGINT) AS s, CAST(d0 AS BIGINT) AS d, CAST(-1 AS BIGINT) AS told FROM c
      UNION ALL SELECT track, block, xs, f + 1, CAST(greatest(-32768, least(32767, s + k * d)) AS BIGINT), CAST(greatest(16, {list(MS_FACTORS)}[(k & 15) + 1] * d // 256) AS BIGINT), CAST(k & 15 AS BIGINT)
      FROM (SELECT *, greatest(-8, least(7, CAST(sign(g) AS BIGINT) * ((abs(g) + d // 2) // d))) AS k FROM (SELECT *, coalesce(xs[f + 1], s) - s AS g FROM r WHERE f < 82)))
    SELECT track, block, any_value(n) AS frames, '00' || any_value(upper(printf('%02x%02x%02x%02x%02x%02x', d0 & 255, d0 // 256 & 255, s0 & 255, (s0 & 65535) // 256, xs[1] & 255, (xs[1] & 65535) // 256))) || string_agg(byte, '' ORDER BY f) AS data
      FROM (SELECT track, block, (f - 3) // 2 AS f, upper(printf('%02x', CAST(sum(CASE WHEN f % 2 = 1 THEN 16 * told ELSE told END) AS BIGINT))) AS byte FROM r WHERE f > 2 GROUP BY track, block, (f - 3) // 2) JOIN c USING (track, block) GROUP BY track, block"""


def add_encoder(name: str, coding: str, size: int, sql: str):
    @query(name, sql)
    def run(spark, d):
        samples = t.mono_tracks(spark, d).withColumn("ch", F.lit(0))
        return encode.encode_blocks(samples, coding, block_bytes=size).withColumn("data", F.hex("data"))


add_encoder("ima_qt_encode", "ima-qt", 34, IMA_SQL)
add_encoder("ms_encode", "ms-adpcm", 47, MS_SQL)
