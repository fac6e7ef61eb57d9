"""Tags from bytes in every scheme, normalised to one vocabulary, and the bytes of new tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..functions.lookups import AIFF_FIELDS, GENRES, ID3_FRAMES, RIFF_FIELDS, VORBIS_FIELDS
from ..sources import files as src
from . import tags


def id3v1(data: Column) -> dict[str, Column]:
    """Fields of a file's last 128 bytes; all null without the mark. The track is there if a zero stands before it."""
    t = F.substring(data, -128, 128)
    own = F.coalesce((F.length(data) >= 128) & (by.part(t, 0, 3).cast("string") == "TAG"), F.lit(False))
    text = lambda at, n: F.nullif(F.rtrim(by.latin1(by.part(t, at, n))), F.lit(""))
    track = F.when((by.u8(t, 125) == 0) & (by.u8(t, 126) != 0), by.u8(t, 126).cast("string"))
    code = by.u8(t, 127).cast("int")
    fields = {"title": text(3, 30), "artist": text(33, 30), "album": text(63, 30), "date": text(93, 4), "comment": text(97, 30), "tracknumber": track, "genre": F.get(F.array(*map(F.lit, GENRES)), code)}
    return {k: F.when(own, v) for k, v in fields.items()}


def genre_text(value: Column) -> Column:
    """A genre as text: numbers in brackets go where text follows them, and a number alone, bracketed or not, is looked
    up, however many zeros stand before it. Numbers that no genre has stay, without brackets."""
    rest = F.trim(F.regexp_replace(value, r"^(\(\d+\))+", ""))
    last = F.regexp_extract(value, r"^(?:\(\d+\))*\((\d+)\)$", 1)
    left = F.when(rest == "", F.nullif(last, F.lit(""))).otherwise(rest)
    number = F.when(left.rlike(r"^0*\d{1,3}$"), F.regexp_replace(left, r"^0+(?=\d)", ""))
    return F.coalesce(F.get(F.array(*map(F.lit, GENRES)), number.cast("int")), left, value)


def id3v2(spark: SparkSession, files: DataFrame, content: str = "content") -> DataFrame:
    """The frames of ID3v2 tags (see sources.files.id3_frame_rows) with tag and custom; genres as text, and the total
    of "4/12" as a row of its own. Frames without a value are no tags and stay out (pictures() has those that are)."""
    rows = src.id3_frame_rows(files, content).where("value IS NOT NULL")
    named = tags.normalise(spark, rows.withColumnRenamed("id", "key"), "id3")
    value = F.when(F.col("tag") == "genre", genre_text(F.col("value"))).otherwise(F.col("value"))
    parts = F.split("value", "/", 2)
    totals = {"tracknumber": "tracktotal", "discnumber": "disctotal"}
    pairs = F.array(F.struct(F.col("tag").alias("tag"), F.get(parts, F.lit(0)).alias("value")), F.struct(F.when(F.col("tag") == "tracknumber", totals["tracknumber"]).otherwise(totals["discnumber"]).alias("tag"), F.get(parts, F.lit(1)).alias("value")))
    one = F.array(F.struct(F.col("tag").alias("tag"), value.alias("value")))
    kept = [c for c in named.columns if c not in ("tag", "value", "mime", "kind", "data")]
    out = named.select(*kept, F.explode(F.when(F.col("tag").isin(*totals), pairs).otherwise(one)).alias("p"))
    return out.select(*kept, "p.tag", "p.value").where("value <> ''")


def pictures(files: DataFrame, content: str = "content") -> DataFrame:
    """The pictures of ID3v2 tags: mime, kind, description and bytes."""
    return src.id3_frame_rows(files, content).where("mime IS NOT NULL").drop("id", "value")


def vorbis_comments(spark: SparkSession, blocks: DataFrame, data: str = "data") -> DataFrame:
    """The comments of Vorbis comment blocks with tag and custom."""
    return tags.normalise(spark, src.vorbis_comment_rows(blocks, data), "vorbis")


def riff_info(spark: SparkSession, blocks: DataFrame, data: str = "data") -> DataFrame:
    """The entries of RIFF INFO lists with tag and custom."""
    return tags.normalise(spark, src.riff_info_rows(blocks, data), "riff")


def bext(data: Column) -> dict[str, Column]:
    """comment and organization of a broadcast extension chunk of 602 bytes or more."""
    own = F.length(data) >= 602
    text = lambda at, n: F.when(own, F.nullif(F.rtrim(by.latin1(by.part(data, at, n))), F.lit("")))
    return {"comment": text(0, 256), "organization": text(256, 32)}


def aiff_text(chunks: DataFrame) -> DataFrame:
    """chunks (id, data) of AIFF text with tag and value; trailing NULs go, and empty texts and other chunks are left out."""
    tag = F.create_map(*[F.lit(x) for kv in AIFF_FIELDS.items() for x in kv])[F.col("id")]
    value = F.rtrim(by.latin1_or_utf8(F.col("data")), F.lit("\x00"))
    return chunks.withColumn("tag", tag).withColumn("value", value).where("tag IS NOT NULL AND value <> ''")


# New tags: entries is an array of (key, value) structs, in order


def vorbis_comment_bytes(vendor: str, entries: Column) -> Column:
    """A Vorbis comment block; keys with "=" are left out."""
    own = F.filter(entries, lambda e: ~F.contains(e["key"], F.lit("=")))
    text = lambda e: F.concat(e["key"], F.lit("="), e["value"]).cast("binary")
    body = by.joined(F.transform(own, lambda e: F.concat(by.le_bytes(F.length(text(e)), 4), text(e))))
    return F.concat(by.le_bytes(F.lit(len(vendor.encode())), 4), F.lit(vendor.encode()), by.le_bytes(F.size(own), 4), body)


def riff_info_bytes(entries: Column) -> Column:
    """The body of a LIST chunk of type INFO: texts end with a NUL and pad to even; keys not of four bytes are left out."""
    own = F.filter(entries, lambda e: F.octet_length(e["key"]) == 4)
    text = lambda e: F.concat(e["value"].cast("binary"), F.unhex(F.lit("00")))
    pad = lambda e: F.unhex(F.when(F.length(text(e)) % 2 == 1, "00").otherwise(""))
    return F.concat(F.lit(b"INFO"), by.joined(F.transform(own, lambda e: F.concat(e["key"].cast("binary"), by.le_bytes(F.length(text(e)), 4), text(e), pad(e)))))


def id3v24_bytes(entries: Column) -> Column:
    """An ID3v2.4 tag of UTF-8 text frames; several values of a frame are one value with NULs between. Null without
    entries, or where it would pass what four bytes of seven bits state."""
    safe = lambda n: F.concat(*[by.be_bytes(F.shiftright(n, s).bitwiseAND(127), 1) for s in (21, 14, 7, 0)])
    text = lambda e: F.concat(F.unhex(F.lit("03")), F.when(e["key"].isin("COMM", "USLT"), F.concat(F.lit(b"XXX"), F.unhex(F.lit("00")))).otherwise(F.unhex(F.lit(""))), e["value"].cast("binary"))
    body = by.joined(F.transform(entries, lambda e: F.concat(e["key"].cast("binary"), safe(F.length(text(e)).cast("bigint")), F.unhex(F.lit("0000")), text(e))))
    n = F.length(body).cast("bigint")
    return F.when((F.size(entries) > 0) & (n < 1 << 28), F.concat(F.lit(b"ID3"), F.unhex(F.lit("040000")), safe(n), body))


def writable(scheme: str) -> dict[str, str]:
    """The key that a writer gives each tag: the first that the scheme's table has for it."""
    out: dict[str, str] = {}
    for key, tag in {"vorbis": VORBIS_FIELDS, "id3": ID3_FRAMES, "riff": RIFF_FIELDS}[scheme].items():
        out.setdefault(tag, key)
    return out
