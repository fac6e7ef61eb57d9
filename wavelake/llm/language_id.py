"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A word's subwords are its character n-grams (2 to 4 bytes' worth of letters, with word ends marked), hashed into a
table of embeddings; a text is the average of the embeddings of all its subwords, and a linear softmax gives the
languages' probabilities. Training is stochastic gradient descent in numpy on a bounded sample of the training
documents, in one task; the model it returns is a few megabytes whatever the corpus holds.

The rejection threshold is calibrated on part of the sample that training does not see: the probability that all
but ``reject_rate`` of its correctly predicted texts reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, sampled, small_batches
from .shingles import PLACES, mix

GRAMS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams_of(words: list[str], buckets: int):
    """(bucket, owner): the hashed subwords of words, each word with a mark at both ends."""
    import numpy as np

    joined = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), length)
    bucket, at = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h += code[k : k + m] * PLACES[k]
        whole = owner[:m] == owner[n - 1 : n - 1 + m]
        bucket.append((mix(h[whole]) % np.uint64(buckets)).astype(np.int64))
        at.append(owner[:m][whole])
    if not bucket:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bucket), np.concatenate(at)


def text_words(text: str | None) -> list[str]:
    return NOT_LETTERS.sub(" ", (text or "").lower()).split()


class WordTable:
    """Sum of table rows over each word's subwords, and how many those are, kept for words already seen."""

    def __init__(self, table, most: int = 100_000):
        self.table, self.most = table, most
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, self.table.shape[1]))
        self.counts = np.zeros(0)

    def add(self, words: list[str]) -> None:
        import numpy as np

        bucket, owner = grams_of(words, len(self.table))
        sums = np.stack([np.bincount(owner, self.table[bucket, k], len(words)) for k in range(self.table.shape[1])], 1)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.sums = np.concatenate([self.sums, sums])
        self.counts = np.concatenate([self.counts, np.bincount(owner, minlength=len(words))])

    def averages(self, texts: list):
        """The average of the table's rows over all subwords of each text; zeros for a text without letters."""
        import numpy as np

        split = [text_words(t) for t in texts]
        flat = [w for ws in split for w in ws]
        if len(self.at) > self.most:
            self.clear()
        if new := list(dict.fromkeys(w for w in flat if w not in self.at)):
            self.add(new)
        ids = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        total = np.bincount(owner, self.counts[ids], len(texts)) if len(ids) else np.zeros(len(texts))
        sums = np.stack([np.bincount(owner, self.sums[ids, k], len(texts)) for k in range(self.table.shape[1])], 1) if len(ids) else np.zeros((len(texts), self.table.shape[1]))
        return sums / np.maximum(total, 1)[:, None]


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], buckets: int, dim: int, epochs: int, reject_rate: float, seed: int = 7) -> dict:
    """The model as plain lists: langs, table (buckets x langs, embeddings times softmax weights), bias, threshold."""
    import numpy as np

    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    bags = []
    for t in texts:
        b = np.bincount(grams_of(text_words(t), buckets)[0], minlength=1)
        at = np.flatnonzero(b)
        bags.append((at, b[at] / max(1, b.sum())))
    emb = rng.normal(0, 1 / dim, (buckets, dim))
    w, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    hold = np.arange(len(texts)) % 5 == 0 if len(texts) >= 50 else np.zeros(len(texts), bool)
    seen = np.flatnonzero(~hold)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(seen):
            at, share = bags[i]
            if not len(at):
                continue
            x = share @ emb[at]
            p = softmax((x @ w + bias)[None])[0]
            p[y[i]] -= 1
            g = w @ p
            w -= rate * np.outer(x, p)
            bias -= 0.1 * rate * p
            emb[at] -= rate * share[:, None] * g[None] * min(50.0, len(at) ** 0.5)
    table = emb @ w
    probability = np.array([softmax((share @ table[at] + bias)[None])[0] for at, share in bags])
    check = hold if hold.any() else ~hold
    right = check & (probability.argmax(1) == y) & np.array([len(at) > 0 for at, _ in bags])
    threshold = float(np.quantile(probability[right].max(1), reject_rate)) * 0.999 if right.any() else 0.0
    return {"langs": names, "table": table.astype(np.float32).ravel().tolist(), "bias": bias.tolist(), "threshold": threshold}


def fit(labelled: DataFrame, sample_rows: int = 4000, buckets: int = 1 << 16, dim: int = 16, epochs: int = 8, reject_rate: float = 0.001) -> dict | None:
    """The model learned from at most sample_rows different (text, lang) pairs, those with the smallest hash: the one
    bound on what training sees. None if no row has both. Hashes alone are sorted; only the chosen texts travel to
    the one task that trains."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sample = sampled(rows, F.xxhash64("text", "lang"), sample_rows).repartition(1).sortWithinPartitions("__h").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            langs += batch.column("lang").to_pylist()
        if texts:
            m = train(texts, langs, buckets, dim, epochs, reject_rate)
            kinds = {"langs": pa.list_(pa.string()), "table": pa.list_(pa.float32()), "bias": pa.list_(pa.float64()), "threshold": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([m[k]], kind) for k, kind in kinds.items()], list(kinds))

    got = sample.mapInArrow(lean(run), "langs array<string>, table array<float>, bias array<double>, threshold double").collect()
    return got[0].asDict() if got else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred, score (the probability of lang_pred) and rejected: not sure enough, or lang_pred `und`.

    A null text, a text without a letter, or no model: `und`, score 0, rejected. Whole texts count. The columns
    added replace columns of docs of the same names; all others stay."""
    import numpy as np

    small_batches(docs.sparkSession)
    names = model["langs"] if model else []
    table = np.array(model["table"], np.float32).reshape(-1, len(names)) if model else None
    bias, threshold = (np.array(model["bias"]), model["threshold"]) if model else (None, 1.0)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(table.astype(np.float64)) if names else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, end in pieces(texts):
                own = texts[first:end]
                p = softmax(words.averages(own) + bias) if names else np.zeros((len(own), 1))
                best = p.argmax(1)
                known = np.array([bool(names) and t is not None and LETTER.search(t) is not None for t in own], bool)
                score = np.where(known, p[np.arange(len(own)), best], 0.0)
                lang = [names[k] if ok else "und" for k, ok in zip(best, known)]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < threshold))],
                    [*kept, "lang_pred", "score", "rejected"],
                )

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in kept]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(lean(run), schema)
