"""Queries of packet positions and seeks in Ogg streams: each user's events are a stream's packets, four to a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import positions
from ..sources import tables as t
from .catalogue import query

# Positions start at 1,000, and the last stated one is 50 short of what the packets give
_ROWS = "(SELECT *, sum(duration) OVER (PARTITION BY stream ORDER BY packet) AS total, count(*) OVER (PARTITION BY stream) AS n FROM (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS packet, 120 * (1 + event_id % 8) AS duration FROM events))"


def packets(spark, d):
    w = Window.partitionBy("stream")
    e = t.read(spark, d, "events").select(F.col("user_id").alias("stream"), "event_id")
    e = e.select("stream", (F.row_number().over(w.orderBy("event_id")) - 1).cast("bigint").alias("packet"), (120 * (1 + F.col("event_id") % 8)).alias("duration"))
    e = e.withColumn("total", F.sum("duration").over(w.orderBy("packet"))).withColumn("n", F.count("*").over(w))
    last = F.col("packet") + 4 >= F.col("n")
    granule = F.when(F.col("packet") % 4 == 3, F.col("total") + 1000 - F.when(last, 50).otherwise(0)).otherwise(-1)
    return e.select("stream", "packet", "duration", granule.alias("granule"))


@query("packet_positions", f"SELECT stream, packet, total - duration + a AS start, total + a AS \"end\" FROM (SELECT *, CASE WHEN n >= 8 THEN 1000 ELSE 0 END AS a FROM {_ROWS})")
def packet_positions(spark, d):
    return positions.packet_positions(packets(spark, d), "stream").select("stream", "packet", "start", "end")


_PAGES = f"(SELECT stream, packet // 4 AS number, CASE WHEN packet // 4 % 5 = 2 THEN 1 ELSE 0 END AS flags, max(total) + 1000 - CASE WHEN max(packet) + 4 >= any_value(n) THEN 50 ELSE 0 END AS granule FROM {_ROWS} WHERE packet < n // 4 * 4 GROUP BY ALL)"


@query(
    "seek_ogg",
    f"""WITH p AS {_PAGES}, l AS (SELECT b.stream, a.granule AS position, b.number * 100 AS o FROM p a JOIN p b ON a.stream = b.stream AND b.number = a.number + 1 WHERE b.flags = 0),
    q AS (SELECT user_id AS stream, event_id, event_id * 97 % 60000 AS frame FROM events),
    m AS (SELECT q.stream, event_id, frame, max(position) AS position FROM q LEFT JOIN l ON q.stream = l.stream AND position <= greatest(frame + 312 - 3840, 0) AND position > 312 GROUP BY ALL)
    SELECT m.stream, event_id, frame, l.o AS "offset", coalesce(m.position - 312, 0) AS position, frame - coalesce(m.position - 312, 0) AS discard FROM m LEFT JOIN l ON m.stream = l.stream AND m.position = l.position""",
)
def seek_ogg(spark, d):
    ended = packets(spark, d).groupBy("stream", F.floor(F.col("packet") / 4).alias("number")).agg(F.max("granule").alias("granule")).where("granule <> -1")
    pages = ended.select("stream", "number", "granule", F.when(F.col("number") % 5 == 2, 1).otherwise(0).alias("flags"), (F.col("number") * 100).alias("offset"))
    e = F.col("event_id")
    targets = t.read(spark, d, "events").select(F.col("user_id").alias("stream"), "event_id", (e * 97 % 60000).alias("frame"))
    return positions.seek(targets, positions.landings(pages, "stream"), "stream", skip=F.lit(312))
