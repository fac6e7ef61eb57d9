"""Identification by bytes: signatures, each codec's own probe, and the ranking of both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import MAGICS, table
from ..sources.files import mpeg_confidence

LIKELY, CERTAIN = 75, 100
ORDER = ["wav", "aiff", "flac", "ogg-flac", "mp3", "vorbis", "opus"]


def _at(content: Column, offset: int, n: int) -> Column:
    return F.hex(F.substring(content, offset + 1, n))


def _text(s: str) -> str:
    return s.encode().hex().upper()


def probes(content: Column) -> dict[str, Column]:
    """The confidence of each codec that settles a file by its first bytes; null where a codec doesn't ask."""
    ogg = (_at(content, 0, 4) == _text("OggS")) & (_at(content, 26, 1) == "01")
    sure = lambda c: F.when(c, CERTAIN).otherwise(0)
    return {
        "wav": sure(_at(content, 0, 4).isin(*map(_text, ("RIFF", "RF64", "BW64"))) & (_at(content, 8, 4) == _text("WAVE"))),
        "aiff": sure((_at(content, 0, 4) == _text("FORM")) & _at(content, 8, 4).isin(_text("AIFF"), _text("AIFC"))),
        "flac": sure((_at(content, 0, 4) == _text("fLaC")) & _at(content, 4, 1).isin("00", "80")),
        "ogg-flac": sure(ogg & (_at(content, 28, 5) == "7F" + _text("FLAC"))),
        "vorbis": sure(ogg & (_at(content, 28, 7) == "01" + _text("vorbis"))),
        "opus": sure(ogg & (_at(content, 28, 8) == _text("OpusHead"))),
    }


def _mpeg(content: Column) -> Column:
    """The MPEG probe: frames have no fixed place, so the bytes are searched."""

    @F.pandas_udf("int")
    def confidence(data: pd.Series) -> pd.Series:
        return data.map(mpeg_confidence)

    return confidence(content)


def identify(files: DataFrame, content: str = "content") -> DataFrame:
    """files with codec and confidence: a probe's answer replaces that of a signature, the greatest wins, of equal
    ones the first registered; null and 0 if nothing matched. No join: the registry is a row expression."""
    c = F.col(content)
    files = files.withColumn("__mpeg", _mpeg(c))
    own = {**probes(c), "mp3": F.col("__mpeg")}
    ranked = []
    for codec in ORDER:
        magic = [m for m in MAGICS if m[0] == codec]
        hit = F.lit(False)
        for _, _, offset, h in magic:
            hit = hit | (_at(c, offset, len(h) // 2) == h)
        confidence = F.coalesce(own.get(codec, F.lit(None)), F.when(hit, LIKELY), F.lit(0))
        ranked.append(F.struct(confidence.cast("int").alias("confidence"), F.lit(-ORDER.index(codec)).alias("o"), F.lit(codec).alias("codec")))
    best = F.greatest(*ranked)
    return files.withColumn("__best", best).withColumn("codec", F.when(F.col("__best.confidence") > 0, F.col("__best.codec"))).withColumn("confidence", F.col("__best.confidence")).drop("__best", "__mpeg")


def magic_matches(spark: SparkSession, files: DataFrame, content: str = "content") -> DataFrame:
    """Each file with each signature that its bytes have. Nine signatures are broadcast and compared in place."""
    rows = table(spark, [(c, o, h) for c, _, o, h in MAGICS], "codec string, offset int, magic string")
    same = F.expr(f"hex(substring({content}, offset + 1, length(magic) div 2)) = magic")
    return files.join(F.broadcast(rows), same)
