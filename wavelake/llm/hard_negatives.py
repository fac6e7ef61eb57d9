"""Hard negatives of vectors by inner product, over one-dimensional distance keys.

1. Vectors are whole numbers (floor of 256 times each component). A coordinate is added that gives all the same length,
   so that a higher inner product with an anchor is a smaller distance to it.
2. Some vectors of a bounded sample are pivots. Every vector belongs to its nearest pivot, and the index is all vectors
   sorted by (pivot, distance to it), cut into blocks that know the interval of their distances.
3. Anchors are cut into blocks in the same order. From the distances of an anchor block to a pivot and the interval of a
   data block follows how near the two can be at least (and at most), by the triangle inequality.
4. A search scans, for every anchor block, first the nearest intervals and then four times as many, until the next one
   can't hold anything nearer than what each anchor already has (k rows), or is wholly outside of its annulus.
5. It runs twice: for the positives of each anchor, and then for the negatives in the annulus of each positive.

Scans are exact products of whole numbers. Blocks meet blocks, so a scan costs a row for each pair of blocks; results
of a scan are at most k rows for each anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, sampled, small_batches, written

PIVOTS, SAMPLE = 24, 2000
#: Most rows of a block of the index and of anchors, and most bytes of its components.
BLOCK, ANCHORS, BLOCK_BYTES = 1024, 256, 1 << 19
#: Data blocks that a round scans for each block of anchors, times four in each further round.
FIRST_ROUND = 4
#: Part of a squared distance by which float arithmetic may be off.
SLACK = 1e-9


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component x, as doubles; null for a null vector and for one with a component that is null or
    not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * 256)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    # from 2^53 on doubles are whole, and floor() as a long might not hold them
    return F.when(~bad, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact: as floats where no sum can pass 2^53, else as Python's numbers."""
    if a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2**53:
        return a @ b.T
    exact = np.vectorize(int, otypes=[object])
    return exact(a).dot(exact(b).T)


def _table(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones count as if zeros followed."""
    column = batch.column("v")
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat) - 0)[ends[0] : ends[-1]] - np.repeat(ends[:-1], size)] = flat[ends[0] : ends[-1]]
    return out


class Space:
    """What is fixed for all vectors: dim, the greatest squared length, and the pivots, with their added coordinate."""

    def __init__(self, dim: int, most: float, pivots: np.ndarray):
        self.dim, self.most = dim, most
        self.pivots = pivots
        self.added = np.sqrt(np.maximum(most - (pivots * pivots).sum(axis=1), 0))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of vectors, with their added coordinate, to each pivot."""
        added = np.sqrt(np.maximum(self.most - (v * v).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (v @ self.pivots.T + added[:, None] * self.added), 0))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        """The same for anchors, whose added coordinate is 0."""
        return np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + self.most - 2 * v @ self.pivots.T, 0))

    @property
    def slack(self) -> float:
        """How far a distance may be off: the root of what a squared one may."""
        return float(np.sqrt(SLACK * self.most * 4)) + 1e-6


def space_of(rows: DataFrame) -> Space | None:
    """Pivots far from each other, out of at most SAMPLE rows with the smallest hashes; None if there is no row."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("most")).first()
    if stats.dim is None:
        return None
    some = sampled(rows, F.xxhash64("id"), SAMPLE).orderBy("__h").select("v").collect()
    v = np.array([[*r.v, *[0.0] * (stats.dim - len(r.v))] for r in some]).reshape(len(some), stats.dim)
    taken = [0]
    far = ((v - v[0]) ** 2).sum(axis=1)
    while len(taken) < PIVOTS and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[taken[-1]]) ** 2).sum(axis=1))
    return Space(stats.dim, stats.most, v[taken])


def blocks(rows: DataFrame, space: Space, most_rows: int, ranges: bool = False) -> DataFrame:
    """rows (id, label, v) as a written table of blocks in the order of (pivot, distance): block, pivot, lo, hi, n, ids,
    labels, v; with ranges also near and far, an anchor block's distances to each pivot."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.of_rows(_table(batch, space.dim))
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], [*batch.schema.names, "pivot", "dist"])

    size = max(1, min(most_rows, BLOCK_BYTES // (8 * max(space.dim, 1))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "lo", "hi", "n", "ids", "labels", "v", *(["near", "far"] if ranges else [])]
        row = lambda x: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))
        for batch in batches:
            v, pivot, dist = _table(batch, space.dim), batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for p, run in groupby(range(len(pivot)), key=lambda i: pivot[i]):
                run = np.array(list(run))
                for k in range(0, len(run), size):
                    own = run[k : k + size]
                    own = own[np.argsort(ids[own], kind="stable")]
                    q = [space.of_anchors(v[own])] if ranges else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([dist[own].min()]), pa.array([dist[own].max()]), pa.array([len(own)], pa.int32()), *[row(x) for x in (ids[own], labels[own], v[own])], *[row(x) for d in q for x in (d.min(axis=0), d.max(axis=0))]], names
                    )

    kinds = "pivot int, lo double, hi double, n int, ids array<bigint>, labels array<bigint>, v array<double>" + (", near array<double>, far array<double>" if ranges else "")
    put = rows.mapInArrow(lean(assigned), "id bigint, label bigint, v array<double>, pivot int, dist double")
    put = put.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    return written(put.mapInArrow(lean(cut), kinds).withColumn("block", F.monotonically_increasing_id()), row_group_bytes=8 << 20)


def block_pairs(anchors: DataFrame, index: DataFrame) -> DataFrame:
    """(anchors, block, least, most, at): how near and how far rows of a block can be from those of an anchor block, and
    the block's place by that; written. Only numbers of blocks meet here, by pivot, in slices."""
    parts = 8
    wide = anchors.select(F.col("block").alias("anchors"), F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "q")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = index.select("block", "pivot", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    least = F.greatest(F.col("lo") - F.col("q.far"), F.col("q.near") - F.col("hi"), F.lit(0.0))
    met = wide.join(keys, ["pivot", "part"]).select("anchors", "block", least.alias("least"), (F.col("q.far") + F.col("hi")).alias("most"))
    return written(met.withColumn("at", F.row_number().over(Window.partitionBy("anchors").orderBy("least", "block"))))


FOUND = "anchors bigint, pos int, win int, anchor_id bigint, id bigint, score bigint, d2 double"


def _scanned(space: Space, k: int, low: int, high: int):
    """The rows that a block of anchors finds in a block of the index: the k best of the same label, or, for anchors with
    windows, the k best of other labels in each window. What is below the k-th that a window has already is left out."""
    minus = -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                array = lambda c: one[c].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                q, x = array("q_v").reshape(-1, space.dim), array("v").reshape(-1, space.dim)
                q_ids, q_labels, ids, labels = (array(c) for c in ("q_ids", "q_labels", "ids", "labels"))
                s = products(q, x)
                same = q_labels[:, None] == labels[None, :]
                windows = one["windows"].as_py() if "windows" in one else None
                s = np.where(~same if windows is not None else same & (q_ids[:, None] != ids[None, :]), s, np.array(minus, s.dtype))
                order = np.argsort(-s, axis=1, kind="stable")
                down = np.take_along_axis(-s, order, axis=1)
                known = {(w["pos"], w["win"]): w["score"] for w in one["known"].as_py() or []}
                # where[window] = the range of places in the anchor's order that it asks for
                if windows is None:
                    where = [(i, 0, 0, int(np.searchsorted(down[i], -minus))) for i in range(len(q))]
                else:
                    where = [(w["pos"], w["win"], int(np.searchsorted(down[w["pos"]], -(high * w["score"] // 100))), int(np.searchsorted(down[w["pos"]], -(-(-low * w["score"] // 100)), "right"))) for w in windows]
                out: list[list] = [[] for _ in range(6)]
                norm = (q * q).sum(axis=1) + space.most
                for i, win, first, end in where:
                    end = min(end, first + k)
                    if (i, win) in known:
                        end = min(end, int(np.searchsorted(down[i], -known[i, win], "right")))
                    for at in range(first, end):
                        score = -int(down[i, at])
                        for column, value in zip(out, (i, win, int(q_ids[i]), int(ids[order[i, at]]), score, norm[i] - 2.0 * score)):
                            column.append(value)
                if out[0]:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([one["anchors"].as_py()] * len(out[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(out, kinds)]], ["anchors", "pos", "win", "anchor_id", "id", "score", "d2"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchors", "pos", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(anchors: DataFrame, index: DataFrame, pairs: DataFrame, space: Space, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """(anchors, pos, win, anchor_id, id, score, d2, place): the k best rows of each window, in rounds of more and more
    distant blocks. anchors with a windows column (pos, win, score) look for other labels in low to high percent of the
    score; without, for other rows of their label."""
    windows = "windows" in anchors.columns
    asked = anchors.select(F.col("block").alias("anchors"), F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("v").alias("q_v"), *(["windows"] if windows else []))
    if windows:
        each = anchors.select(F.col("block").alias("anchors"), F.explode("windows").alias("w")).select("anchors", "w.*")
        whole_score = F.col("score").cast("double")  # near enough for a bound, and it can't overflow
        edge = lambda s: F.sqrt(F.greatest(F.col("norm") + space.most - 2.0 * s, F.lit(0.0)))
        each = written(each.where("score >= 0").select("anchors", "pos", "win", edge(F.ceil(whole_score * low / 100)).alias("outer"), edge(F.floor(whole_score * high / 100)).alias("inner")))
        pairs = pairs.join(each.groupBy("anchors").agg(F.min("inner").alias("inner")), "anchors").where(F.col("most") + space.slack >= F.col("inner")).drop("inner")
    else:
        each = anchors.select(F.col("block").alias("anchors"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).select("anchors", "pos", F.lit(0).alias("win"), F.lit(float("inf")).alias("outer"))
    best, first, more = None, 0, FIRST_ROUND
    while True:
        todo = pairs.where(F.col("at") > first)
        known = None
        if best is not None:
            full = best.groupBy("anchors", "pos", "win").agg(F.count("*").alias("c"), F.max("d2").alias("d2"), F.min("score").alias("score")).where(F.col("c") >= k)
            full = written(full.select("anchors", "pos", "win", F.sqrt(F.greatest("d2", F.lit(0.0))).alias("d"), "score"))
            bounds = each.join(full, ["anchors", "pos", "win"], "left").groupBy("anchors").agg(F.max(F.coalesce("d", "outer")).alias("bound"))
            todo = written(todo.join(bounds, "anchors").where(F.col("least") - space.slack <= F.col("bound")).select("anchors", "block", "least", "most", "at"))
            if todo.isEmpty():
                return best
            known = full.groupBy("anchors").agg(F.collect_list(F.struct("pos", "win", "score")).alias("known"))
        now = todo.where(F.col("at") <= first + more).select("anchors", "block")
        q = asked.join(known, "anchors", "left") if known is not None else asked.withColumn("known", F.lit(None).cast("array<struct<pos:int,win:int,score:bigint>>"))
        met = now.join(q, "anchors").join(index.select("block", "ids", "labels", "v"), "block").drop("block")
        found = met.mapInArrow(lean(_scanned(space, k, low, high)), FOUND)
        best = written(_best(found if best is None else best.drop("place").unionByName(found), k))
        first, more = first + more, 4 * more


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label)
    whose is_anchor, a condition on vec_id, holds: for each of an anchor's first ``positives`` other rows of its label, the
    first ``negatives`` rows of other labels with low to high percent of the positive's score. Scores are inner products
    of floored components times 256, higher first, ties by smaller vec_id.

    Rows with a null label or vec_id, a null vector, or a null or non-finite component take no part. Shorter vectors count
    as if zeros followed. Rows that repeat a vec_id count each: none is the other's positive, and both can be found. An
    anchor without positives, and a positive with a score below 0 (there low to high percent is no range), give no row.
    An empty table gives none. Scores beyond 64 bits are an error. Other columns take no part."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), whole(F.col("embedding")).alias("v"), is_anchor.alias("is_anchor")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    space = space_of(rows)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if space is None:
        return vectors.sparkSession.createDataFrame([], out)
    index = blocks(rows.select("id", "label", "v"), space, BLOCK)
    anchors = blocks(rows.where("is_anchor").select("id", "label", "v"), space, ANCHORS, ranges=True)
    pairs = block_pairs(anchors, index)
    found = search(anchors, index, pairs, space, positives)
    wins = written(found.select("anchors", "pos", F.col("place").alias("win"), F.col("id").alias("positive_id"), "score", (F.col("d2") - space.most + 2.0 * F.col("score")).alias("norm")))
    asked = wins.groupBy("anchors").agg(F.collect_list(F.struct("pos", "win", "score", "norm")).alias("windows"))
    got = search(anchors.join(asked.withColumnRenamed("anchors", "block"), "block"), index, pairs, space, negatives, low, high)
    named = got.select("anchors", "pos", "win", "anchor_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(wins.withColumnRenamed("score", "positive_score"), ["anchors", "pos", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
