"""Toxicity: cumulative-link ordinal regression from sparse text features to graded severity.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all grades and an ordered threshold between each
two. Features are the words of a text, each with log(1 + count). Labels say only toxic or not, so the grades of
training texts are made from them: grade 0 is not toxic; toxic texts get grades 1, 2, 3 by how many occurrences
they have of words that are far more frequent in toxic texts (up to 2, up to 4, more). Expected severity is the sum of
P(grade > k), and a text is toxic if grade 0 is less likely than all others together.

Training is proximal gradient descent with an L1 penalty in numpy, in one task, on a bounded sample of labelled
texts; the penalty leaves a few hundred words, and that is all that scoring needs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, map_texts, sampled
from .language_id import text_words

GRADES = 4
#: Most marker occurrences of grades 1 and 2.
GRADE_ENDS = (2, 4)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grades_of(bags: list[Counter], toxic: list[int]) -> list[int]:
    """Grades of the training texts; a marker is in at least three toxic texts and at least eight times as frequent
    there (one text added on the other side)."""
    inside, outside = Counter(), Counter()
    for bag, t in zip(bags, toxic):
        (inside if t else outside).update(bag.keys())
    n_in, n_out = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    markers = {w for w, k in inside.items() if k >= 3 and k / n_in >= 8 * (outside[w] + 1) / n_out}
    out = []
    for bag, t in zip(bags, toxic):
        k = sum(bag[w] for w in markers & bag.keys()) if t else 0
        out.append(0 if not t else 1 + sum(k > end for end in GRADE_ENDS))
    return out


def train(texts: list[str], toxic: list[int], rounds: int = 300, penalty: float = 2e-3, least_texts: int = 3) -> dict:
    """words, weights (those not zero) and thresholds."""
    import numpy as np

    bags = [Counter(text_words(t)) for t in texts]
    y = np.array(grades_of(bags, toxic))
    df = Counter(w for bag in bags for w in bag)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, k in df.items() if k >= least_texts))}
    row, col, val = [], [], []
    for i, bag in enumerate(bags):
        own = [(vocabulary[w], k) for w, k in bag.items() if w in vocabulary]
        row += [i] * len(own)
        col += [c for c, _ in own]
        val += [k for _, k in own]
    row, col, val = np.array(row, np.int64), np.array(col, np.int64), np.log1p(np.array(val, float))
    n, m = len(texts), len(vocabulary)
    share = np.cumsum(np.bincount(y, minlength=GRADES)[:-1] + 1) / (n + GRADES)
    theta = np.log(share / (1 - share))
    w, seen_w, seen_t = np.zeros(m), np.full(m, 1e-6), np.full(GRADES - 1, 1e-6)
    weight = np.where(y > 0, 0.5 * n / max(1, (y > 0).sum()), 0.5 * n / max(1, (y == 0).sum()))  # both sides count alike
    for _ in range(rounds):
        s = np.bincount(row, w[col] * val, n)
        upper = np.where(y < GRADES - 1, sigmoid(theta[np.minimum(y, GRADES - 2)] - s), 1.0)
        lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        g = np.bincount(col, (weight * (1 - upper - lower))[row] * val, m) / n  # of minus log likelihood
        up, lo = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        gt = np.array([(lo[y == k + 1].sum() - up[y == k].sum()) / n for k in range(GRADES - 1)])
        seen_w += g * g
        seen_t += gt * gt
        rate = 0.3 / np.sqrt(seen_w)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        theta = np.maximum.accumulate(theta - 0.3 / np.sqrt(seen_t) * gt + np.arange(GRADES - 1) * 1e-9)
    names = list(vocabulary)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return {"words": [names[i] for i in kept], "weights": w[kept].tolist(), "thresholds": theta.tolist()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> dict | None:
    """The model learned from at most sample_rows labelled documents, half of them toxic where there are so many:
    the bound on what training sees. labels: (doc_id, toxic); a document with several labels counts as toxic if
    one says so. toxic is boolean or a number, of which all but 0 say toxic. Null labels and texts are left out. None if
    nothing is labelled."""
    says = F.when(F.col("toxic").cast("double") == 0, 0).otherwise(1)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(says).alias("toxic"))
    pick = lambda t: sampled(known.where(F.col("toxic") == t), F.xxhash64("doc_id"), sample_rows // 2).select("doc_id", "toxic")
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(pick(0).union(pick(1))), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: texts[i])
            m = train([texts[i] for i in order], [int(toxic[i]) for i in order])
            kinds = {"words": pa.list_(pa.string()), "weights": pa.list_(pa.float64()), "thresholds": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([m[k]], kind) for k, kind in kinds.items()], list(kinds))

    got = sample.repartition(1).mapInArrow(lean(run), "words array<string>, weights array<double>, thresholds array<double>").collect()
    return got[0].asDict() if got else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with severity (expected grade, 0 to 3), grade (the likeliest) and toxic (boolean), from whole texts.

    Null and empty texts, and texts without a word of the model, get what the thresholds alone give. Of equally likely
    grades the lowest is named. Rows that repeat get the same. An empty table gives an empty table. Without a
    model all are 0 and false. Columns of docs with these names are replaced; all others stay."""
    import numpy as np

    weights = dict(zip(model["words"], model["weights"])) if model else {}
    theta = np.array(model["thresholds"]) if model else np.full(GRADES - 1, 40.0)

    def start():
        known = weights.keys()

        def compute(texts):
            s = np.zeros(len(texts))
            for i, t in enumerate(texts):
                words = text_words(t)
                hit = known & set(words)
                if hit:
                    s[i] = sum(weights[w] * k for w, k in ((w, np.log1p(words.count(w))) for w in sorted(hit)))
            below = sigmoid(theta[None] - s[:, None])
            p = np.diff(np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], 1), axis=1)
            return [(1 - below).sum(1), p.argmax(1), below[:, 0] < 0.5]

        return compute

    return map_texts(docs, [("severity", "double"), ("grade", "int"), ("toxic", "boolean")], start)
