"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

1. Each text becomes a set of five-word shingles, a 128-bit digest of the set and a sketch of 100 bins. Texts of
   one set are one class from here on, so exact copies cost one row each and no pair.
2. Classes that share a band of the sketch share a bucket. In each bucket the member that meets most others over
   all its buckets is the hub, and every other member is compared with the hub alone: n - 1 pairs, not n * n.
3. Buckets whose members then lie in more than one component may still hide links. Their classes go through an
   exact join: shingles are put in order of rarity, and two classes of different components are compared only
   if a rare shingle of both stands where the number needed in common can still be reached. No cap is needed.
   The largest component on a shingle is compared with the rest alone, never within itself.
4. Every comparison is the exact intersection of full sets.

A pair of similarity s shares no band of 25 with 4 rows each with probability (1 - s^4)^25: 8e-9 at 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, lean, row_key, small_batches, written
from .components import components
from .shingles import WordHashes, band_keys, fast_sketch, shingle_sets

WIDTH, BANDS, ROWS = 5, 25, 4
PAIRS_A_SLICE = 1000


def _digests(x, ends) -> list[bytes]:
    return [xxhash.xxh3_128_digest(x[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    cache = WordHashes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, end, x, owner in shingle_sets(texts, WIDTH, cache):
            ends = np.searchsorted(owner, np.arange(end - first + 1))
            keys = band_keys(fast_sketch(x, owner, end - first, BANDS * ROWS), ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__row").slice(first, end - first),
                    batch.column("doc_id").slice(first, end - first),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(_digests(x, ends), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(end - first + 1) * BANDS, pa.int32()), pa.array(keys.ravel())),
                ],
                ["__row", "doc_id", "n", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    cache = WordHashes()
    for batch in batches:
        for first, end, x, owner in shingle_sets(batch.column("text").to_pylist(), WIDTH, cache):
            ends = np.searchsorted(owner, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_digests(x, ends), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))],
                ["digest", "shingles"],
            )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose full sets are similar enough. A set that more than PAIRS_A_SLICE pairs ask for
    as b is sent in several copies, each for a slice of them, so that no key is hot."""
    pairs = written(pairs.select("a", "b"))
    slices = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_SLICE).cast("int").alias("slices")).where("slices > 1")
    slices = broadcast_if_small(written(slices))
    left, right = (sets.select(F.col("digest").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    right = right.join(slices, "b", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    pairs = pairs.join(slices, "b", "left").withColumn("slice", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1))).cast("int"))
    both = pairs.select("a", "b", "slice").join(left, "a").join(right, ["b", "slice"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _hidden_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of the sets that lie in different components and can still be similar enough, by an exact
    prefix join: shingles rarest first, and only as far into each set as the first shared one must lie.

    On each shingle only the sets outside its largest component are compared with the others, so the copies of a
    large group never meet each other. A shingle of many sets is cut into slices, so that no key is hot, and there only
    sets of neighbouring size classes meet."""
    need = 100 + percent  # similar enough: need * common >= percent * (na + nb)
    each = sets.join(labels, "digest").select("digest", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    rare = each.groupBy("t").agg(F.count("*").alias("df"))
    ordered = each.join(rare, "t").groupBy("digest", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefix = written(ordered.select("digest", "label", "n", F.posexplode(F.slice("ts", 1, reach)).alias("at", "e")).where("e.df > 1").select("digest", "label", "n", "at", F.col("e.t").alias("t")))
    labels_of = prefix.groupBy("t", "label").agg(F.count("*").alias("c"))
    mixed = labels_of.groupBy("t").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("df"), F.count("*").alias("labels")).where("labels > 1")
    mixed = written(mixed.select("t", "main", F.ceil(F.col("df") / PAIRS_A_SLICE).cast("int").alias("slices")))
    # on a shingle in slices, sets whose sizes are near enough lie in the same or in neighbouring classes; 1.01 covers rounding
    width = 1.01 * math.log(100 / min(percent, 99))
    prefix = written(prefix.join(broadcast_if_small(mixed), "t").withColumn("class", F.when(F.col("slices") > 1, F.floor(F.log("n") / width)).otherwise(-1)))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("t", "slice", "class", "main", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "label", "n", "at")])

    a = side(prefix.where("label <> main").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))), "a")
    b = prefix.withColumn("slice", F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int"))
    b = b.withColumn("class", F.explode(F.when(F.col("slices") > 1, F.sequence(F.col("class") - 1, F.col("class") + 1)).otherwise(F.array(F.lit(-1).cast("bigint")))))
    b = side(b, "b").drop("main")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    once = (F.col("label_b") == F.col("main")) | (F.struct("n_a", "digest_a") < F.struct("n_b", "digest_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (need * left >= percent * (F.col("n_a") + F.col("n_b"))) & once
    pair = F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")
    return a.join(b, ["t", "slice", "class"]).where(fits).select(*pair).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """For each row of docs: __row (128 bits of doc_id and text), doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links reach, kept says whether it is the row's own. A text without words (or null) is
    linked with nothing. A text of fewer words than five is one shingle. Rows without doc_id take part in links,
    but their ids count only if a component has no other: then component_id is null and they are kept."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", row_key().alias("__row"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.mapInArrow(lean(_sketches), f"__row binary, doc_id {id_type}, n bigint, digest binary, bands array<bigint>"))
    classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("__row").alias("a_row"), F.max("n").alias("n"), F.any_value("bands").alias("bands")))

    buckets = classes.select("digest", F.explode("bands").alias("key"))
    shared = written(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    open_ = written(buckets.join(broadcast_if_small(shared), "key"))
    met = open_.groupBy("digest").agg(F.sum("size").alias("met"))
    hubs = open_.join(met, "digest").groupBy("key").agg(F.max_by("digest", F.struct("met", "digest")).alias("hub"))
    pairs = open_.join(broadcast_if_small(hubs), "key").where("digest <> hub").select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()
    size = classes.select("digest", "n")
    pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    members = broadcast_if_small(written(classes.join(open_.select("digest").distinct(), "digest", "left_semi").select(F.col("a_row").alias("__row"), F.col("digest").alias("of"))))
    texts = docs.join(members, "__row").select("text")
    sets = written(texts.mapInArrow(lean(_sets), "digest binary, shingles array<bigint>").dropDuplicates(["digest"]))
    links = written(_verified(pairs, sets, percent))

    labels = components(links)
    marked = written(open_.select("digest", "key").join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").select("digest", "key", F.coalesce("label", "digest").alias("label")))
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    unsure = written(marked.join(broadcast_if_small(mixed), "key", "left_semi").select("digest", "label").distinct())
    more = written(_verified(_hidden_pairs(sets, unsure, percent), sets, percent))
    if not more.isEmpty():
        labels = components(links.union(more))

    linked = labels.join(classes.select(F.col("digest").alias("node"), "first_id"), "node")
    lowest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = written(labels.join(lowest, "label").select(F.col("node").alias("digest"), "component_id", F.lit(True).alias("linked")))
    named = classes.select("digest", "first_id").join(broadcast_if_small(known), "digest", "left").select("digest", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    out = rows.select("__row", "doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("__row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest doc_id; all columns stay.
    Rows that repeat both id and text are one document and leave one row. Texts without words are all kept, once each.
    An empty table gives an empty table."""
    key = fresh(docs, "__row")
    found = near_duplicates(docs, percent).withColumnRenamed("__row", key)
    odd = written(found.groupBy(key).agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"))
    # those that go are few: beyond the bound of a broadcast, documents are shuffled once
    out = docs.select("*", row_key().alias(key)).join(broadcast_if_small(odd.where("NOT kept").select(key)), key, "left_anti")
    if not odd.where("kept").isEmpty():
        out = out.dropDuplicates([key])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
