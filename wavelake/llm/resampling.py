"""Importance resampling towards a target's distribution of hashed word features.

1. Each text's words and pairs of neighbouring words fall in buckets by CRC-32. The counts of documents by buckets are
   a sparse matrix, written as CSR blocks: a row of the table holds some hundred documents (ids, row starts, bucket
   numbers, counts). Later steps read that table and no text.
2. Column sums of the documents' and of the target's matrix are the two distributions; each bucket's gain is the
   logarithm of their ratio, smoothed.
3. A block's weights are its sparse matrix-vector product with the gains, over each document's number of features.
4. A key drawn from each row's id is added (Gumbel's trick), so that taking the highest scores draws without
   replacement by weight. Places in that order come from a range partitioning, never from one task.

Null texts, and texts without a word, have no feature and weight 0. Rows that repeat id and text have the same score
and places next to each other. An empty documents table gives an empty result; an empty target gives gains against no
feature at all, as the formula says. Columns of other names take no part, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, pieces, row_key, small_batches, written

BUCKETS = 10_000
#: Bytes of a row group of the matrix; a reader holds one at a time.
GROUP_BYTES = 8 << 20
#: About how many characters of text one block of the matrix holds.
BLOCK_CHARS = 400_000
#: Longest words (and a space) that the tables of shifts know.
SHIFTS = 64
#: A-Z to a-z, and every ASCII byte that is no letter or digit to a space; other bytes are parts of words.
FOLD = bytes(k + 32 if 65 <= k <= 90 else k if k > 127 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Shifts:
    """CRC-32 of bytes one behind the other from those of each: CRCs are linear, so what n further bytes do to a CRC is
    the exclusive or of four table entries, one for each of its bytes."""

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        at = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        steps = [np.stack(at)]
        for _ in range(SHIFTS):
            steps.append(table[steps[-1] & 255] ^ (steps[-1] >> np.uint32(8)))
        self.steps = np.stack(steps)

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = second.copy()
        for k in range(4):
            out ^= self.steps[length, k, (first >> np.uint32(8 * k)) & 255]
        return out


class WordCrcs(dict):
    """Numbers of the words seen, with arrays of their CRCs, those behind a space, and lengths."""

    def __init__(self) -> None:
        self.crcs: list[tuple[int, int, int]] = []
        self.known = np.zeros((0, 3), np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crcs)
        self.crcs.append((zlib.crc32(word), zlib.crc32(b" " + word), min(len(word) + 1, SHIFTS + 1)))
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """(words, 3)"""
        if len(self) > 100_000:
            self.clear()
            self.crcs, self.known = [], self.known[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.crcs) > len(self.known):
            self.known = np.concatenate([self.known, np.array(self.crcs[len(self.known) :], np.uint32)])
        return self.known[at]


def counted(texts: list, cache: WordCrcs, shifts: Shifts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, indptr, bucket, count): the rows of the matrix for texts."""
    split = [words(t) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    crc = cache.of(flat)
    owner = np.repeat(np.arange(len(texts)), n_words)
    within = owner[1:] == owner[:-1]
    length = np.minimum(crc[1:, 2], SHIFTS)
    pair = shifts.joined(crc[:-1, 0], crc[1:, 1], length)
    for i in np.flatnonzero(within & (crc[1:, 2] > SHIFTS)):  # words too long for the tables
        pair[i] = zlib.crc32(b" " + flat[i + 1], int(crc[i, 0]))
    feature = np.concatenate([crc[:, 0], pair[within]]).astype(np.int64) % buckets
    cell, count = np.unique(np.concatenate([owner, owner[1:][within]]) * buckets + feature, return_counts=True)
    return n_words, np.searchsorted(cell, np.arange(len(texts) + 1) * buckets), cell % buckets, count


def matrix(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """The written CSR blocks of docs (key, text): ids, rows (128 bits of id and text), n_words, indptr, bucket, count."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", row_key().alias("row"), "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shifts = WordCrcs(), Shifts()
        whole = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, t))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, end in pieces(texts, BLOCK_CHARS):
                n_words, indptr, bucket, count = counted(texts[first:end], cache, shifts, buckets)
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [whole(own.column("doc_id"), None), whole(own.column("row"), None), whole(n_words, pa.int64()), whole(indptr, pa.int32()), whole(bucket, pa.int32()), whole(count, pa.int32())],
                    ["ids", "rows", "n_words", "indptr", "bucket", "count"],
                )

    made = docs.mapInArrow(lean(blocks), f"ids array<{kind}>, rows array<binary>, n_words array<bigint>, indptr array<int>, bucket array<int>, count array<int>")
    return written(made, row_group_bytes=GROUP_BYTES)


def _numpy(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The array of each row."""
    column = batch.column(name)
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The matrix's sum over all documents for each bucket. A task gives one row a bucket, however many documents it
    holds; the driver gets one row a bucket."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, count in zip(_numpy(batch, "bucket"), _numpy(batch, "count")):
                np.add.at(total, bucket, count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("bucket", "count").mapInArrow(lean(sums), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """scale * ln of how many times as frequent each bucket is in the target, with one added to every count; floored."""
    n, s, t = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log((float(b) + 1) * (float(s) + n) / ((float(a) + 1) * (float(t) + n)))) for a, b in zip(documents, target)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight) for each document of the matrix: the floored mean of its features'
    gains, 0 without features."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: _numpy(batch, c) for c in ("n_words", "indptr", "bucket", "count")}
            for i, (n_words, indptr, bucket, count) in enumerate(zip(*of.values())):
                run = np.concatenate([[0], np.cumsum(gain[bucket] * count)])
                total = run[indptr[1:]] - run[indptr[:-1]]
                n = np.maximum(2 * n_words - 1, 0)
                ids, rows = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "rows"))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "row", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(lean(products), f"doc_id {kind}, row binary, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = 7, scale: int = 1000) -> Column:
    """scale times a Gumbel number drawn from seed and id by SHA-256, floored; the same wherever and whenever. A null id
    draws as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df, written, with each row's place from 1 in a total order: ranges are sorted each in its task, and only their
    sizes meet at the driver, a row a range."""
    part, at = fresh(df, "__part"), fresh(df, "__at")
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = written(spread.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r[0]: r[1] for r in spread.groupBy(part).agg(F.count("*")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    start = fresh(df, "__start")
    starts = df.sparkSession.createDataFrame(starts, f"`{part}` int, `{start}` bigint")
    return spread.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(at) + 1).drop(part, at, start)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, target_key: str = "item_id", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight, score, rank) for each row of docs (doc_id, text): rank is the place in
    the draw of percent of the documents with least_words or more, towards target (target_key, text); null if not
    drawn. Ties go to the smaller doc_id, rows without one last."""
    blocks = matrix(docs, buckets=buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, target_key, buckets), buckets))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    long = F.col("n_words") >= least_words
    n = blocks.select(F.sum(F.size(F.filter("n_words", lambda w: w >= least_words)))).first()[0] or 0
    placed = numbered(scored, "place", F.desc(F.expr(f"n_words >= {least_words}")), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return placed.withColumn("rank", F.when(long & (F.col("place") <= percent * n // 100), F.col("place"))).drop("place")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, **options) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns. Of rows that repeat id and text, as many as were
    drawn."""
    key, copies, n, first = (fresh(docs, c) for c in ("__row", "__copies", "__n", "__first"))
    found = resample(docs, target, percent, **options).where("rank IS NOT NULL").groupBy("row").agg(F.count("*").alias(copies)).withColumnRenamed("row", key)
    own = written(docs.withColumn(key, row_key()).join(found, key).withColumn(n, F.monotonically_increasing_id()))
    if not own.groupBy(key).agg(F.count("*").alias(n), F.max(copies).alias(copies)).where(F.col(n) > F.col(copies)).isEmpty():
        own = numbered(own, n, F.asc(key), F.asc(n))
        own = own.join(own.groupBy(key).agg(F.min(n).alias(first)), key).where(F.col(n) < F.col(first) + F.col(copies))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])
