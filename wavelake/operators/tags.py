"""Tags: one ordered, multi-valued vocabulary over the spellings of many containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lookups import GENRES, ID3_FRAMES, RIFF_FIELDS, VORBIS_FIELDS, table

SCHEMES = {"vorbis": VORBIS_FIELDS, "id3": ID3_FRAMES, "riff": RIFF_FIELDS}


def normalise(spark: SparkSession, fields: DataFrame, scheme: str, key: str = "key") -> DataFrame:
    """fields with tag (null for a key outside the vocabulary) and custom. Vorbis keys are matched without regard
    to ASCII case. The map has at most 20 rows, so it is broadcast."""
    rows = table(spark, list(SCHEMES[scheme].items()), "__key string, tag string")
    own = F.upper(key) if scheme == "vorbis" else F.col(key)
    out = fields.withColumn("__key", own).join(F.broadcast(rows), "__key", "left")
    return out.select(*fields.columns, "tag", F.col("tag").isNull().alias("custom"))


def add_unique(tags: DataFrame, owner: str, tag: str, value: str, order: str) -> DataFrame:
    """The first of equal values of a tag, in the order of their first appearance."""
    first = Window.partitionBy(owner, tag, value).orderBy(order)
    return tags.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def multivalued(tags: DataFrame, owner: str, tag: str, value: str, order: str) -> DataFrame:
    """One row for each tag of each owner with its values in order. The sizes are those of one file's tags."""
    got = tags.groupBy(owner, tag).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("v"))
    return got.select(owner, tag, F.size("v").cast("bigint").alias("n"), F.transform("v", lambda s: s[value]).alias("values"))


def split_pair(df: DataFrame, column: str) -> DataFrame:
    """number and total of "4/12"; empty parts are null."""
    parts = F.split(column, "/", 2)
    return df.withColumn("number", F.nullif(F.get(parts, F.lit(0)), F.lit(""))).withColumn("total", F.nullif(F.get(parts, F.lit(1)), F.lit("")))


def genre(spark: SparkSession, df: DataFrame, code: str) -> DataFrame:
    """df with the ID3v1 genre of a byte; null where no genre has the number."""
    rows = table(spark, list(enumerate(GENRES)), "__code int, genre string")
    return df.join(F.broadcast(rows), F.col(code) == F.col("__code"), "left").drop("__code")


def fill_missing(tags: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of more whose keys tags lacks: a trailer only fills what is still empty."""
    return more.join(tags.select(*keys).distinct(), keys, "left_anti")
