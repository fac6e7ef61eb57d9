"""Similar texts by an exact set join with adaptive multi-match prefixes.

1. Texts of one set of word shingles are one class. Shingles are put in one order, rarer ones first: by how many there
   are in the shingle's hash bucket, and by the shingle itself. Any order gives the same links.
2. Two sets that have t shingles in common have l of them within the first n - t + l of both, for every l up to t. Each
   class takes its own l: a longer prefix meets more sets but asks for more common shingles before two are compared in
   full. The cost of each l is estimated from the bucket counts, and the cheapest is taken. A pair must share as many
   shingles as the smaller l of both, at places that its two sizes leave for them.
3. First every class is compared with one hub of each shingle of its prefix, so that large groups fall into components
   with a comparison a member. Then the pairs of different components that share enough of their prefixes are compared.
   On each shingle the largest component meets the others alone, never itself; frequent shingles are cut into slices,
   and there only sets of near sizes meet. Of shingles that many sets have (heavy ones), the l-th that two sets share
   is the l-th or a later one of each, so sets that share no others meet there alone. There is no cap.
4. Every comparison is the exact intersection of full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, lean, row_key, small_batches, written
from .components import components
from .near_dedup import _digests
from .shingles import WordHashes, shingle_sets

WIDTH = 4
#: Hash buckets of the shingle counts: a fixed size, one row a bucket and task.
BUCKETS = 1 << 20
#: Most l, and what a full comparison costs for each shingle of a set beside looking up one shingle.
MOST_MATCHES, VERIFY = 4, 0.25
#: Members of a shingle's slice, and pairs that one copy of a set serves.
SLICE = 1000
#: Bucket counts from which on a shingle's members are dealt to slices where prefixes are made.
HOT = 10_000
#: Sets from which on a shingle of different components is heavy.
HEAVY = 200
#: A number of prefixes holds a set's size and l below this, and above it how many others the prefix may meet.
LOW = 1 << 40


def bucket_of(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(20)).astype(np.int64) % BUCKETS


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with its set's size and digest; at a task's end one row with the counts of its shingles."""
    cache, total, last = WordHashes(), np.zeros(BUCKETS, np.int64), None
    names = ["row", "doc_id", "n", "digest", "counts"]
    for batch in batches:
        last = batch
        for first, end, x, owner in shingle_sets(batch.column("text").to_pylist(), WIDTH, cache):
            ends = np.searchsorted(owner, np.arange(end - first + 1))
            total += np.bincount(bucket_of(x), minlength=BUCKETS)
            own = batch.slice(first, end - first)
            none = pa.nulls(end - first, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(_digests(x, ends), pa.binary()), none], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, last.schema.field("doc_id").type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))], names)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """All tasks' counts added up: one number a bucket comes to the driver."""
    each = rows.where("counts IS NOT NULL").select(F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    out = np.zeros(BUCKETS, np.int64)
    found = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def matches_wanted(need: np.ndarray, cost: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set its l. cost: (sets, MOST_MATCHES), how many others the prefix of each l is expected to meet, each
    time they do. A pair that is compared has met l times at least, so at most cost / l are. need: the least overlap."""
    l = np.arange(1, MOST_MATCHES + 1)  # noqa: E741
    full = cost * (1 + VERIFY * n[:, None] / l)
    full[l[None, :] > need[:, None]] = np.inf
    return np.argmin(full, axis=1) + 1


def prefixes(x: np.ndarray, owner: np.ndarray, n_sets: int, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, place, l of each owner) of the prefixes of sets given as values x, ascending for each owner."""
    n = np.bincount(owner, minlength=n_sets)
    count = counts[bucket_of(x)]
    order = np.argsort(owner * (count.max(initial=0) + 1) + count, kind="stable")  # of equal counts, x ascends already
    x, count = x[order], count[order]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.arange(len(x)) - start[owner]
    need = -(-n * percent // 100)
    others = np.maximum(count - max(1.0, counts.sum() / BUCKETS), 0.0) + 0.1  # beside what lies in a bucket by chance
    run = np.concatenate([[0.0], np.cumsum(others)])
    cost = np.stack([run[start + np.minimum(n - need + l, n)] - run[start] for l in range(1, MOST_MATCHES + 1)], axis=1) if n_sets else np.zeros((0, MOST_MATCHES))
    wanted = matches_wanted(need, cost, n)
    taken = at < (n - need + wanted)[owner]
    return x[taken], owner[taken], at[taken], wanted


def _made_prefixes(percent: int, counts: np.ndarray):
    """(t, part, digest, nl, at) of each set's prefix, once a task for each set. part: -1, or the slice of a shingle that so
    many sets may have that its members must not meet in one task. nl: in one number size and l and, above them, the
    others that the prefix may meet (eighths of a logarithm). at: the shingle's place in the set."""
    by_chance = counts.sum() / BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            for first, end, x, owner in shingle_sets(batch.column("text").to_pylist(), WIDTH, cache):
                ends = np.searchsorted(owner, np.arange(end - first + 1))
                digests = _digests(x, ends)
                new = np.zeros(end - first, bool)
                for i, d in enumerate(digests):
                    if d not in seen:
                        new[i] = True
                        seen.add(d)
                if len(seen) > 300_000:
                    seen.clear()
                mine = new[owner]
                t, of, at, wanted = prefixes(x[mine], owner[mine], end - first, percent, counts)
                heat = 1 + counts[bucket_of(t)] // HOT
                low = np.array([int.from_bytes(d[:4], "little") for d in digests], np.int64)
                met = np.bincount(of, np.maximum(counts[bucket_of(t)] - by_chance, 0.0), end - first)
                nl = np.diff(ends) * (MOST_MATCHES + 1) + wanted + np.minimum(8 * np.log2(1 + met), 255).astype(np.int64) * LOW
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.view(np.int64)), pa.array(np.where(heat > 1, low[of] % heat, -1), pa.int32()), pa.array(digests, pa.binary()).take(pa.array(of)), pa.array(nl[of]), pa.array(at, pa.int32())],
                    ["t", "part", "digest", "nl", "at"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for first, end, x, owner in shingle_sets(batch.column("text").to_pylist(), WIDTH, cache):
            ends = np.searchsorted(owner, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(x, ends), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))], ["digest", "shingles"])


def near_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def least_common(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles similar sets of these sizes have in common at least."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def early_enough(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether a common shingle at these places is one of the first l that sets of these sizes must have in common, l the
    smaller of both: at places below n - t + l in each, t the least they have in common in all."""
    spare = F.least(a["l"], b["l"]) - least_common(a["n"], b["n"], percent)
    return (a["at"] < a["n"] + spare) & (b["at"] < b["n"] + spare)


def compared(pairs: DataFrame, sets: DataFrame, percent: int, short: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Every set is sent once for each SLICE of the pairs that ask for it,
    whichever side it is on, so no key is hot. short: sets are lists of shortened shingles, which may repeat; then a pair
    stays where as many of a's as needed occur in b."""
    pairs = written(pairs.select("a", "b"))
    for side in "ab":
        asked = pairs.groupBy(side).agg(F.ceil(F.count("*") / SLICE).cast("int").alias(f"of_{side}")).where(f"of_{side} > 1")
        pairs = pairs.join(broadcast_if_small(written(asked)), side, "left").na.fill(1, [f"of_{side}"])
    for side, other in ("ab", "ba"):
        slices = written(pairs.groupBy(side).agg(F.max(f"of_{side}").alias("slices")))
        own = sets.select(F.col("digest").alias(side), F.col("shingles").alias(f"s{side}")).join(broadcast_if_small(slices), side)
        own = own.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        pairs = pairs.withColumn("slice", F.pmod(F.xxhash64(other), F.col(f"of_{side}")).cast("int")).join(own, [side, "slice"]).drop("slice", f"of_{side}")
    if short:  # of a's shingles, those whose short form b has, however often it occurs
        once = F.array_distinct("sb")
        rare = F.size(F.array_except(F.col("sa"), once))  # different short forms that b lacks: each stands for one or more
        common = F.size("sa") - rare
        return pairs.where((100 * common >= percent * (F.size("sa") + F.size("sb") - common))).select("a", "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. First they are compared by 16 bits of each shingle, a quarter
    of what has to move: that finds as many in common or more, and so loses none. What is left is compared in full."""
    maybe = written(compared(pairs, sets.select("digest", F.transform("shingles", lambda x: (x.bitwiseAND(0xFFFF) - 0x8000).cast("smallint")).alias("shingles")), percent, short=True))
    return compared(maybe, sets, percent)


def early_heavy(heavy: Column, n: Column, spare: Column) -> Column:
    """The shingles of a set's heavy ones, (at, t) in their order, that early_enough takes."""
    return F.transform(F.filter(heavy, lambda x: x["at"] < n + spare), lambda x: x["t"])


def meetings(own: DataFrame, percent: int, where: Column | None = None, *more: str) -> DataFrame:
    """A row for each shingle on which two sets of different labels meet: both sides' columns with _a and _b.
    own: (t, digest, label, n, l, at, main, slices, class) and more; where: what else must hold."""

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("t", "slice", "class", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "label", "n", "l", "at", *more)], *(["main"] if x == "b" else []))

    a = side(own.where("label <> main").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))), "a")
    b = own.withColumn("slice", F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int"))
    b = b.withColumn("class", F.explode(F.when(F.col("slices") > 1, F.sequence(F.col("class") - 1, F.col("class") + 1)).otherwise(F.array(F.lit(-1).cast("bigint")))))
    b = side(b, "b")
    once = (F.col("label_b") == F.col("main")) | (F.col("digest_a") < F.col("digest_b"))
    of_a, of_b = ({c: F.col(f"{c}_{x}") for c in ("n", "l", "at")} for x in "ab")
    met = (F.col("label_a") != F.col("label_b")) & near_sizes("n_a", "n_b", percent) & once & early_enough(of_a, of_b, percent)
    return a.join(b, ["t", "slice", "class"]).where(met if where is None else met & where)


def heavy_meetings(heavy: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """meetings() on heavy shingles of the pairs that share enough of these alone. Of the shingles that such a pair
    shares, the l-th is at least the l-th heavy one of both sets, so only those places meet."""
    own = heavy.join(lists.select("digest", "heavy"), "digest").withColumn("rank", F.array_position(F.col("heavy.t"), F.col("t")))
    l, spare = F.least("l_a", "l_b"), F.least("l_a", "l_b") - least_common(F.col("n_a"), F.col("n_b"), percent)  # noqa: E741
    shared = F.size(F.array_intersect(*(early_heavy(F.col(f"heavy_{x}"), F.col(f"n_{x}"), spare) for x in "ab")))
    return meetings(own, percent, (F.least("rank_a", "rank_b") >= l) & (shared >= l), "heavy", "rank")


def crossing_pairs(open_: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different labels that share as many shingles (t) of their prefixes as similar ones must.
    open_: (t, digest, n, l, at); labels: (digest, label)."""
    own = open_.join(broadcast_if_small(labels), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    by_label = own.groupBy("t", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("t").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("df"), F.count("*").alias("labels")).where("labels > 1")
    mixed = written(mixed.select("t", "main", F.ceil(F.col("df") / SLICE).cast("int").alias("slices"), (F.col("df") > HEAVY).alias("is_heavy")))
    # on a shingle in slices, sets of near sizes lie in the same or in neighbouring classes; 1.01 covers rounding
    width = 1.01 * math.log(100 / min(percent, 99))
    own = written(own.join(broadcast_if_small(mixed), "t").withColumn("class", F.when(F.col("slices") > 1, F.floor(F.log("n") / width)).otherwise(-1)))

    def ends(met: DataFrame) -> DataFrame:
        return met.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b"), F.least("l_a", "l_b").alias("l"))

    light = ends(meetings(own.where("NOT is_heavy"), percent)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("l").alias("l"))
    heavy = own.where("is_heavy")
    if heavy.isEmpty():
        return light.where("shared >= l").select("a", "b")
    light = written(light)
    lists = written(heavy.groupBy("digest").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "t"))).alias("heavy")))
    both = light.where("shared < l")
    for x in "ab":
        both = both.join(lists.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("heavy").alias(f"heavy_{x}")), x)
    spare = F.col("l") - least_common(F.col("n_a"), F.col("n_b"), percent)
    more = F.size(F.array_intersect(*(early_heavy(F.col(f"heavy_{x}"), F.col(f"n_{x}"), spare) for x in "ab")))
    pairs = light.where("shared >= l").select("a", "b").union(both.where(F.col("shared") + more >= F.col("l")).select("a", "b"))
    return pairs.union(ends(heavy_meetings(heavy, lists, percent)).select("a", "b")).distinct()


def similar_texts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two texts are linked if 100 * intersection >= percent * union of their sets of 4-word shingles; component_id is the
    smallest doc_id that links reach, its own included. Fewer words than four are one shingle; texts without words
    (null, empty) are linked with nothing and are their own component. Rows that repeat id and text give a row each.
    Rows without doc_id take part in links; a component without any id has null. An empty table gives an empty one, and
    no column but doc_id and text counts. percent: 1 to 100."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", row_key().alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(docs.mapInArrow(lean(_classes), f"row binary, doc_id {kind}, n bigint, digest binary, counts array<bigint>"), row_group_bytes=16 << 20)
    counts = bucket_counts(made)
    rows = made.where("counts IS NULL").select("row", "doc_id", "n", "digest")
    classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("a_row")))

    each = docs.select("text").mapInArrow(lean(_made_prefixes(percent, counts)), "t bigint, part int, digest binary, nl bigint, at int").repartition("t", "part")
    same = Window.partitionBy("t", "part")
    each = each.groupBy("t", "part", "digest").agg(F.max("nl").alias("nl"), F.max("at").alias("at")).withColumn("members", F.count("*").over(same)).where("members > 1 OR part >= 0")
    # the hub of a shingle: the set whose prefix may meet most others, found where its members have met
    each = each.withColumn("hub", F.max(F.struct("nl", "digest", "at")).over(same))
    for x in ("", "hub."):
        low = F.col(f"{x}nl") % LOW
        each = each.withColumn(x.replace(".", "_") + "n", F.floor(low / (MOST_MATCHES + 1))).withColumn(x.replace(".", "_") + "l", low % (MOST_MATCHES + 1))
    hub = {"n": F.col("hub_n"), "l": F.col("hub_l"), "at": F.col("hub.at")}
    asks = (F.col("digest") != F.col("hub.digest")) & near_sizes("n", "hub_n", percent) & early_enough({c: F.col(c) for c in hub}, hub, percent)
    open_ = written(each.select("t", "digest", "at", "n", "l", F.when(asks, F.col("hub.digest")).alias("hub")))
    pairs = written(open_.where("hub IS NOT NULL").select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct())

    repeats = not rows.groupBy("row").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The full sets of those that pairs name, from the text of one row each."""
        ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
        members = broadcast_if_small(written(classes.join(ends, "digest", "left_semi").select(F.col("a_row").alias("row"))))
        sets = docs.join(members, "row", "left_semi").select("text").mapInArrow(lean(_sets), "digest binary, shingles array<bigint>")
        return written(sets.dropDuplicates(["digest"]) if repeats else sets)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs; the sets made for them are not kept."""
        sets = sets_of(pairs)
        links = written(similar(pairs, sets, percent))
        for table in (sets, pairs):
            forget(table)
        return links

    links = confirmed(pairs)
    labels = components(links)
    pairs = written(crossing_pairs(open_.select("t", "digest", "n", "l", "at"), labels.select(F.col("node").alias("digest"), "label"), percent))
    if not pairs.isEmpty():
        more = confirmed(pairs)
        if not more.isEmpty():
            labels = components(links.union(more))

    linked = labels.join(classes.select(F.col("digest").alias("node"), "first_id"), "node")
    lowest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = written(labels.join(lowest, "label").select(F.col("node").alias("digest"), "component_id", F.lit(True).alias("linked")))
    named = classes.select("digest", "first_id").join(broadcast_if_small(known), "digest", "left").select("digest", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
