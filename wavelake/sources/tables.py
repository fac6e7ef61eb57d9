"""Sample tracks and byte columns made from the relational test tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task makes files or tracks from: fewer aren't worth a task, and more are another's.
FEW, ROWS = 1_000, 5_000
#: Rows that one task numbers in tracks.
TRACK_ROWS = 500_000


def dealt(df: DataFrame, *by: str, rows: int = ROWS) -> DataFrame:
    """df dealt by columns to the session's shuffle partitions, or to more tasks if each would get more than about ``rows``
    rows: a table of small rows lies in few splits, and what is made from one of them would be one task's. The count is
    read from the files' footers."""
    n, tasks = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(min(tasks, -(-n // FEW)), -(-n // rows), 1), *by)


def float_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame, v): one track for each embedding."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("frame", "v"))
    return e.select("track", F.col("frame").cast("bigint").alias("frame"), F.col("v").cast("double").alias("v"))


FLOAT_SQL = "(SELECT vec_id AS track, generate_subscripts(embedding, 1) - 1 AS frame, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def mono_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame, x): 16-bit samples from events, one track for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.least(F.lit(32767), F.floor(F.col("value") * 100 + 0.5)).cast("bigint")
    return dealt(read(spark, sf_dir, "events"), "user_id", rows=TRACK_ROWS).select(F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("bigint").alias("frame"), x.alias("x"))


MONO_SQL = "(SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(32767, CAST(floor(value * 100 + 0.5) AS BIGINT)) AS x FROM events)"


def stereo_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame, l, r): 16-bit stereo from lineitem, one track for each supplier."""
    q = F.col("l_quantity").cast("int")
    d = dealt(read(spark, sf_dir, "lineitem"), "l_suppkey", rows=TRACK_ROWS).select(
        F.col("l_suppkey").alias("track"), "l_orderkey", "l_linenumber", (q * 600 - 15000).cast("bigint").alias("l"), (F.floor(F.col("l_discount") * 100 + 0.5) * 1000 + q * 500 - 15000).cast("bigint").alias("r")
    )
    w = Window.partitionBy("track").orderBy("l_orderkey", "l_linenumber", "l", "r")
    return d.select("track", (F.row_number().over(w) - 1).cast("bigint").alias("frame"), "l", "r")


STEREO_SQL = """(SELECT track, row_number() OVER (PARTITION BY track ORDER BY l_orderkey, l_linenumber, l, r) - 1 AS frame, l, r FROM
  (SELECT l_suppkey AS track, l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 600 - 15000 AS l,
          CAST(floor(l_discount * 100 + 0.5) AS INT) * 1000 + CAST(l_quantity AS INT) * 500 - 15000 AS r FROM lineitem))"""


def byte_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, b): a byte from each event."""
    return read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("b"))


BYTE_SQL = "(SELECT event_id, event_id % 256 AS b FROM events)"


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, b0, b1, b2, b3): the bytes of an MPEG-like header from each event."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 0, 254).otherwise(255).cast("bigint").alias("b0"), (224 + (e * 7) % 32).alias("b1"), ((e * 37) % 256).alias("b2"), ((e * 101) % 256).alias("b3"))


HEADER_SQL = "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 254 ELSE 255 END AS b0, 224 + (event_id * 7) % 32 AS b1, (event_id * 37) % 256 AS b2, (event_id * 101) % 256 AS b3 FROM events)"
