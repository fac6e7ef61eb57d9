"""Benchmark decontamination: which documents contain a test item, however long they are.

Size-partitioned MinHash containment search. Items are put into classes by the size of their shingle set; each
class has one sketch size k, and an item's sketch is its k smallest shingle hashes (a bottom-k MinHash). A
document that holds at least the share t of an item's n shingles misses at most n - ceil(t * n) of them, so with
k = u - ceil(t * u) + 1 for the largest size u of a class, the sketch and the document must share a hash. The
size of the document plays no part, where plain MinHash would need a similarity that long documents never reach.
Each candidate is then verified by exact containment of word shingles, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, fresh, lean, row_key, small_batches, within, written
from .shingles import WordHashes, shingle_sets, words

WIDTH = 5


def sketch_size(n: int, percent: int) -> int:
    """The sketch size of the class of n: classes end at powers of two."""
    u = 1 << (n - 1).bit_length() if n else 0
    return u - math.ceil(u * percent / 100) + 1


def _item_sketches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache = WordHashes()
        for batch in batches:
            texts = batch.column("item_text").to_pylist()
            for first, end, x, owner in shingle_sets(texts, WIDTH, cache):
                ends = np.searchsorted(owner, np.arange(end - first + 1)).tolist()
                # sorted by hash within an item: the first k are the smallest
                low = [x[a : a + sketch_size(b - a, percent)][: b - a] for a, b in zip(ends[:-1], ends[1:])]
                at = np.repeat(np.arange(end - first), [len(v) for v in low])
                width = np.array([min(WIDTH, len(words(t))) for t in texts[first:end]], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__item").slice(first, end - first).take(pa.array(at)), pa.array(width[at], pa.int32()), pa.array(np.concatenate([*low, x[:0]]).view(np.int64))],
                    ["__item", "width", "hash"],
                )

    return run


def _document_hashes(widths: list[int], wanted: list[int] | None):
    """The distinct shingle hashes of each document, of all of them or of those wanted alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        look = None if wanted is None else np.sort(np.array(wanted, np.int64).view(np.uint64))
        cache = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for width in widths:
                for first, end, x, owner in shingle_sets(texts, width, cache):
                    if look is not None:
                        hit = look[np.minimum(np.searchsorted(look, x), len(look) - 1)] == x if len(look) else np.zeros(len(x), bool)
                        x, owner = x[hit], owner[hit]
                    yield pa.RecordBatch.from_arrays([batch.column("__row").slice(first, end - first).take(pa.array(owner)), pa.array(x.view(np.int64))], ["__row", "hash"])

    return run


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact word shingles of both texts of each pair."""

    def grams(w: list[bytes], width: int) -> set:
        return set(zip(*[w[k:] for k in range(width)])) if width else set()

    for batch in batches:
        n_item, n_shared, last = [], [], None
        for row, text, item in zip(batch.column("__row").to_pylist(), batch.column("text").to_pylist(), batch.column("item_text").to_pylist()):
            if row != last:
                last, w, sets = row, words(text), {}
            v = words(item)
            width = min(WIDTH, len(v))
            if width not in sets:
                sets[width] = grams(w, width)
            own = grams(v, width)
            n_item.append(len(own))
            n_shared.append(len(own & sets[width]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__row"), batch.column("doc_id"), batch.column("item_id"), pa.array(n_item, pa.int64()), pa.array(n_shared, pa.int64())],
            ["__row", "doc_id", "item_id", "n_item_shingles", "n_shared"],
        )


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (__row, doc_id, item_id, n_item_shingles, n_shared) where the document (doc_id, text) holds at least
    percent % of the distinct shingles of the item (item_id, text). Words are cut at white space, A-Z in lower
    case; a shingle is five words, and an item of fewer words is one shingle of its own length.

    Null or empty texts of either side are in no pair. Rows equal in id and text give a pair once; other columns
    play no part. A share of just percent % counts. ``bound``: up
    to so many sketch hashes of all items go to every task; beyond it documents and sketches are joined by a
    shuffle, with the same result."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", row_key().alias("__row"), "text").where("text IS NOT NULL")
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("__item"), F.col("text").alias("item_text")).where("text IS NOT NULL").dropDuplicates(["__item"])
    items = written(items)
    sketches = written(items.mapInArrow(lean(_item_sketches(percent)), "__item bigint, width int, hash bigint"))
    widths = sorted(r.width for r in sketches.select("width").distinct().collect())
    few = within(sketches, bound)
    wanted = [r.hash for r in sketches.select("hash").distinct().collect()] if few else None
    hits = docs.select("__row", "text").mapInArrow(lean(_document_hashes(widths, wanted)), "__row binary, hash bigint")
    hashes = sketches.select("hash", "__item")
    candidates = written(hits.join(F.broadcast(hashes) if few else hashes, "hash").select("__row", "__item").distinct())

    rows = broadcast_if_small(candidates.select("__row").distinct())
    texts = docs.join(rows, "__row", "left_semi").dropDuplicates(["__row"])
    pairs = texts.join(candidates, "__row").join(broadcast_if_small(items, wide=F.col("item_text")), "__item").select("__row", "doc_id", "item_id", "text", "item_text")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    checked = pairs.mapInArrow(lean(_contained), f"__row binary, doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item_shingles bigint, n_shared bigint")
    return checked.where((F.col("n_item_shingles") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_item_shingles")))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the documents that contain an item; all columns stay, and so do rows with a null or empty text.
    Rows that repeat go or stay together. Without items, or without documents, docs is what it was."""
    found = written(contaminated(docs, items, percent).select("__row").distinct())
    key = fresh(docs, "__row")
    marked = docs.select("*", row_key().alias(key))
    return marked.join(broadcast_if_small(found.withColumnRenamed("__row", key)), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
