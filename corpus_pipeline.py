"""A pipeline over documents: known languages, no boilerplate lines, one of each near-duplicate group, no benchmark
items, and sampled piece sequences of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import decontamination, language_id, line_dedup, near_dedup, sentencepieces
from wavelake.llm.common import fresh, written

#: No stage but the second, third and fourth can be said in SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough certainty; trained on those outside the held-out fifth.

    Null, empty and letterless texts have no language and go. Repeated rows go or stay together. Where no row has a text
    and a language, nothing is learned and all rows go; an empty table stays empty. All columns stay."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    own = {c: fresh(docs, f"own_{c}") for c in docs.columns if c in ("lang_pred", "score", "rejected")}
    judged = language_id.predict(docs.withColumnsRenamed(own), model).where("NOT rejected")
    return judged.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars, where there is such a column, is that of the
    new text. No row goes: null stays null, empty stays empty, and a text that loses all its lines becomes empty.
    Repeated rows count each."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 and more on five-word shingles), that with the smallest
    doc_id. Texts without words (null, empty) are linked with nothing and stay; rows that repeat id and text leave one.
    An empty table stays empty."""
    return near_dedup.keep_one(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark. Null and empty texts hold none and stay, repeated rows go or stay
    together, and an empty table of either kind changes nothing."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their ids, beside doc_id and, where there are such
    columns, lang and source. A text with one segmentation gives one row; null and empty texts give what the operator
    states for them, and repeated rows give equal rows. An empty table gives none."""
    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    out = sentencepieces.sample(docs.select(*own, "text"), k=2)
    return out.select(*own, F.posexplode("samples").alias("sample", "s")).select(*own, "sample", "s.*")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", piece_samples),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
