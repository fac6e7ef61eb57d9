"""The queries of this subpackage and their SQL: one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, jaccard_join, language_id, line_dedup, lm_scoring, near_dedup, pii, quality, resampling, secrets, sentencepieces, toxicity
from .common import LOWER, UPPER

#: DuckDB expressions of the white space and of the A-Z folding in the contracts.
SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(documents(spark, sf_dir)).select(*columns, "quality")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim({sql_lower("line")}, {SQL_SPACES}) AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


#: Shingles of a table's texts, as SQL; fewer words: the whole sequence.
def sql_shingles(table: str, key: str, width: int = 5) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s
  FROM (SELECT {key}, list_filter(string_split_regex({sql_lower("text")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL)"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(documents(spark, sf_dir), items).select("doc_id", "item_id", "n_item_shingles", "n_shared")


OP3_SQL = f"""
WITH d AS ({sql_shingles("documents", "doc_id")}), b AS ({sql_shingles("benchmark", "item_id")}),
sizes AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM d JOIN b USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING 100 * count(*) >= 80 * n_item_shingles
"""


def sql_components(width: int, columns: str) -> str:
    """Components of documents with 85 percent of their shingles in common, by all pairs that share one."""
    return f"""
WITH RECURSIVE d AS ({sql_shingles("documents", "doc_id", width)}),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT o.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id{columns}
FROM documents o LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = o.doc_id
"""


OP5_SQL = sql_components(5, ", o.doc_id = m AS kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "severity", "grade", "toxic")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.find_secrets(docs, words=secrets.ranked_words(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
        count("guess").alias("n_guess"),
    )


#: The key of the query's pseudonyms; a real run takes its own from a secret store.
PII_KEY = "a key for tests"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], secrets.listed(F.col("pii")).alias("spans"), "text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.sample(documents(spark, sf_dir).select("doc_id", "text"), k=2, with_ids=False)
    return out.select("doc_id", F.posexplode("samples").alias("at", "s")).select("doc_id", F.col("at").alias("sample"), "s.*")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def sql_features(table: str, key: str) -> str:
    """Each row's single words and pairs of words, repeats included."""
    return f"""
  SELECT {key}, len(w) AS n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {key}, regexp_extract_all({sql_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table})"""


OP12_SQL = f"""
WITH d AS ({sql_features("documents", "doc_id")}), b AS ({sql_features("benchmark", "item_id")}),
crc_step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS steps),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b))),
bytes AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) AS x FROM hexed),
hashed AS (SELECT f, xor(list_reduce(x, lambda c, y: xor(c // 256, steps[xor(c % 256, y) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc_step),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket), totals),
w AS (SELECT doc_id, any_value(n_words) AS n_words, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM d JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(documents(spark, sf_dir), percent=85)


OP13_SQL = sql_components(4, "")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_line_dedup": op2_line_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_secret_scans": op6_secret_scans,
        "op7_pii": op7_pii,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op3_benchmark_decontamination": OP3_SQL,
        "op5_minhash_near_dedup": OP5_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_importance_resampling": OP12_SQL,
        "op13_ngram_jaccard_join": OP13_SQL,
    }
