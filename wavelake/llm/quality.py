"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each
one is, and the posterior probability of good quality decides, instead of a filter that all rules must pass.

DataFrame functions only. Per document everything is computed within its row; what is shuffled is one row for
each pattern of votes (at most 3 to the number of rules), counted before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

SYMBOLS = "#*$%&|<>"
#: Rules in order; each is +1 (good), -1 (bad) or 0 (abstains) for a document.
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "line_words", "letters")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def base_columns(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed,
    and what the rules need besides. All of a row within the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("__text"))
    d = d.select("doc_id", "__text", words_of(F.col("__text")).alias("__w"))
    # 3-word windows: their hashes; a text without equal ones needs no sorting
    window = F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    d = d.select("doc_id", "__text", F.size("__w").cast("long").alias("n_words"), F.when(F.size("__w") > 2, F.slice(window, 1, F.size("__w") - 2)).otherwise(F.array().cast("array<bigint>")).alias("__h"))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    equal = lambda x, i: (x["h"] == F.get("__s", i - 1)["h"]) | (x["h"] == F.get("__s", i + 1)["h"])
    again = F.sort_array(F.transform(F.filter("__s", lambda x, i: F.coalesce(equal(x, i), F.lit(False))), lambda x: x["i"]))
    d = d.select("doc_id", "__text", "n_words", F.when(F.col("__s").isNotNull(), again).alias("__p"))
    step = F.transform("__p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - x, F.lit(3))))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.select("doc_id", "__text", "n_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"), lines.alias("__l"))
    length = F.length("__text")
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.size("__l").cast("long").alias("n_lines"),
        (length - F.length(F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        (length - F.length(F.translate("__text", "0123456789.,;:!?()[]{}\"'@/_=+-", ""))).cast("long").alias("n_marks"),
    )


def votes(d: DataFrame) -> list[Column]:
    """One column for each of RULES, from the columns of base_columns()."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    w, lines = F.greatest(n, F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    mean = F.col("word_chars") / w
    return [
        rule(n < 20, n >= 100),
        rule((mean < 2.5) | (mean > 15), mean.between(3, 10)),
        rule(F.col("n_symbols") / w > 0.1, F.col("n_symbols") / w < 0.02),
        rule(F.col("n_dup_lines") / lines > 0.3, F.col("n_dup_lines") / lines < 0.05),
        rule(F.col("n_repeat_words") / w > 0.3, F.col("n_repeat_words") / w < 0.1),
        rule(F.col("n_capitals") / chars > 0.3, F.col("n_capitals") / chars < 0.1),
        rule(n / lines < 3, n / lines >= 5),
        rule((F.col("n_marks") + F.col("n_symbols")) / chars > 0.25, (F.col("n_marks") + F.col("n_symbols")) / chars < 0.15),
    ]


def posterior(model: dict) -> Column:
    """Probability of good quality from the votes v0, v1, ... under the model's prior and vote rates."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, (good, bad) in enumerate(zip(model["objects_to_good"], model["objects_to_bad"])):
        v = F.col(f"v{k}")
        odds = odds + F.when(v == -1, F.lit(math.log(good / bad))).when(v == 1, F.lit(math.log((1 - good) / (1 - bad)))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, n_rules: int, rounds: int = 12) -> dict:
    """The rules' accuracies and the prior by expectation-maximisation over counted vote patterns (v0, v1, ..., n).

    A rule that votes has one accuracy for each class: it votes -1 on good documents at the rate objects_to_good
    and on bad ones at objects_to_bad. Each round is one aggregation over the patterns, of which there are at most
    3 ** n_rules. Every rate starts with ten imaginary votes; good documents meet at most one objection of a rule
    in ten and bad ones at least one, which fixes the classes' names."""
    model = {"prior": 0.85, "objects_to_good": [0.02] * n_rules, "objects_to_bad": [0.3] * n_rules}
    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
        for k in range(n_rules):
            v = F.col(f"v{k}")
            for name, share in (("good", p), ("bad", 1 - p)):
                sums += [F.sum(F.when(v == -1, n * share).otherwise(0.0)).alias(f"{name}{k}"), F.sum(F.when(v != 0, n * share).otherwise(0.0)).alias(f"{name}_of{k}")]
        got = patterns.withColumn("p", posterior(model)).agg(*sums).first()
        if not got["n"]:
            return model
        rate = lambda name, k, start: (got[f"{name}{k}"] + 10 * start) / (got[f"{name}_of{k}"] + 10)
        model = {
            "prior": min(0.99, max(0.01, (got["good"] + 8.5) / (got["n"] + 10))),
            "objects_to_good": [min(0.1, max(0.001, rate("good", k, 0.02))) for k in range(n_rules)],
            "objects_to_bad": [min(0.95, max(0.1, rate("bad", k, 0.3))) for k in range(n_rules)],
        }
    return model


def quality(docs: DataFrame, keep_at: float = 0.5, rounds: int = 12) -> DataFrame:
    """For each row of docs (doc_id, text): the base columns, votes v0.., quality (posterior) and kept.

    kept: not base_failed, and quality at keep_at or more. Null and empty texts have no words and fail the base.
    Rows that repeat count each; an empty table gives an empty result. Other columns of docs play no part."""
    base = base_columns(docs)
    voted = written(base.select("*", *[v.alias(f"v{k}") for k, v in enumerate(votes(base))]))
    names = [f"v{k}" for k in range(len(RULES))]
    patterns = written(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    out = voted.withColumn("quality", posterior(fit(patterns, len(RULES), rounds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
