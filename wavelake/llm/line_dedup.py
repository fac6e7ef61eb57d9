"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs) of one batch of documents: for each line key its 128-bit hash and the number of the
batch's documents that hold it. Runs are bucketed by hash into the same ranges and sorted within each, so that they meet
range by range in merge joins and nothing is shuffled but the new batch itself. A new batch merge-anti-joins the lines
that are known to be repeated and adds what is left as a run of level 0; merge joins of that run with all others tell
which lines are repeated now. When a level holds ``fanout`` runs, they are merged into one run of the next level. So a
line is rewritten a logarithmic number of times, and a batch never rewrites the whole history.

Runs live in a folder with a manifest, and a later session that opens the folder goes on with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, exists, fresh, lower_az, row_key, shared_folder, within, written

HASH = ["h1", "h2"]


def line_hashes(text: Column) -> Column:
    """array<struct<h1,h2>> of the lines' keys in order; null for a line whose key is empty. A key is the line
    without white space at its ends and with A-Z in lower case."""
    lines = F.split(lower_az(F.coalesce(text, F.lit(""))), "\n", -1)

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))

    return F.transform(lines, hashed)


def line_counts(docs: DataFrame, *keys: Column) -> DataFrame:
    """(keys, h1, h2, n_docs): in how many rows of docs each line key occurs. Counted before the shuffle, so a
    line that every document holds costs one row a task."""
    found = docs.select(*keys, F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("h")).where("h IS NOT NULL")
    return found.groupBy(*[c for c in found.columns if c != "h"], "h.h1", "h.h2").agg(F.count("*").alias("n_docs"))


class LineRuns:
    """The levelled runs in ``folder`` (a new one in the shared folder if not given; an old one is opened as it stands).
    ``min_docs``: in how many documents a line must occur to count as repeated. ``buckets``: hash ranges of a new
    folder; as many as shuffle partitions if not given."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2, folder: str | None = None, buckets: int | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be 1 or more, fanout 2 or more")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = (folder or f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.known: list[str] = []  # tables of repeated lines, which have no line in common
        self.version = 0
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # each bucket is one sorted file
        if exists(spark, f"{self.folder}/manifest"):
            self._open()

    def _open(self) -> None:
        kept = self.spark.read.parquet(f"{self.folder}/manifest")
        last = kept.agg(F.max("version").alias("v")).first().v
        for r in kept.where(F.col("version") == last).orderBy("at").collect():
            self.version, self.buckets = r.version, r.buckets
            if r.name is not None and not self.spark.catalog.tableExists(r.name):
                self.spark.sql(f"CREATE TABLE {r.name} (h1 BIGINT, h2 BIGINT, n_docs BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r.buckets} BUCKETS LOCATION '{self.folder}/{r.name}'")
            if r.level is None:
                if r.name is not None:
                    self.known.append(r.name)
                continue
            while len(self.levels) <= r.level:
                self.levels.append([])
            self.levels[r.level].append(r.name)

    def _save(self) -> None:
        """The manifest's next version: a session that stops before it is whole leaves the last one in force."""
        self.version += 1
        rows = [(None, self.buckets, None), *[(None, self.buckets, n) for n in self.known], *[(k, self.buckets, n) for k, level in enumerate(self.levels) for n in level]]
        self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, level int, buckets int, name string").coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")

    def _write(self, df: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        df.select(*HASH, "n_docs").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def repeated(self) -> DataFrame:
        """(h1, h2, n_docs) of the lines that the runs together know in min_docs documents or more; n_docs as it was
        when they got there."""
        out = self.spark.createDataFrame([], "h1 bigint, h2 bigint, n_docs bigint")
        for name in self.known:
            out = out.unionByName(self.spark.table(name))
        return out

    def unknown(self, counts: DataFrame) -> DataFrame:
        """counts without the lines that are known to be repeated: merge-anti-joins, range by range."""
        for name in self.known:
            counts = counts.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return counts

    def totals(self, name: str) -> DataFrame:
        """The lines of a run with their numbers in all runs together: merge joins, range by range."""
        out = self.spark.table(name)
        for level in self.levels:
            for other in level:
                if other != name:
                    out = out.join(self.spark.table(other).withColumnRenamed("n_docs", "more").hint("merge"), HASH, "left")
                    out = out.select(*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return out

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: a full merge join, range by range."""
        both = self.spark.table(a).hint("merge").join(self.spark.table(b).withColumnRenamed("n_docs", "more").hint("merge"), HASH, "full")
        return both.select(*HASH, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

    def add(self, counts: DataFrame) -> None:
        """One batch, as line_counts() gives it. Lines that are known to be repeated need no more counting."""
        run = self._write(self.unknown(counts))
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        self.known.append(self._write(self.totals(run).where(F.col("n_docs") >= self.min_docs)))
        old, k = [], 0
        while len(self.levels[k]) >= self.fanout:
            full, self.levels[k] = self.levels[k], []
            if k + 1 == len(self.levels):
                self.levels.append([])
            new = full[0]
            for other in full[1:]:
                old.append(new)
                new = self._write(self.merged(new, other))
            self.levels[k + 1].append(new)
            old, k = old + full[1:], k + 1
        self._save()
        for name in old:  # the manifest no longer names them
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_lines(docs: DataFrame, repeated: DataFrame, n_lines: str | None = None, n_dropped: str | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the repeated lines (h1, h2, n_docs) gone from text; all other columns stay. A null text stays null.
    n_lines and n_dropped name columns to add, which replace those of these names. Rows are matched by 128 bits of
    doc_id and text, so null or repeated ids are harmless: equal rows lose equal lines.

    Up to ``bound`` repeated lines go to every task. If there are more, the most frequent of them do, and the lines
    of the corpus that are none of these meet the rest in a shuffle, where no line is hot any more."""
    key, gone, total = fresh(docs, "__row"), fresh(docs, "__lost"), fresh(docs, "__n")
    lines = docs.select(row_key().alias("row"), F.posexplode(line_hashes(F.col("text"))).alias("at", "h")).where("h IS NOT NULL").select("row", "at", "h.h1", "h.h2")
    if within(repeated, bound):
        found = lines.join(F.broadcast(repeated.select(*HASH)), HASH, "left_semi")
    else:
        scale = F.floor(F.log2("n_docs") * 8)
        limit, total_ = None, 0
        for r in sorted(repeated.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
            total_ += r.n
            if total_ > bound:
                break
            limit = r.s
        often = scale >= F.lit(limit) if limit is not None else F.lit(False)
        hot = F.broadcast(repeated.where(often).select(*HASH))
        found = lines.join(hot, HASH, "left_semi").unionByName(lines.join(hot, HASH, "left_anti").join(repeated.where(~often).select(*HASH), HASH, "left_semi"))
    lost = found.groupBy(F.col("row").alias(key)).agg(F.collect_set("at").alias(gone))
    split = F.split(F.col("text"), "\n", -1)
    out = docs.select("*", row_key().alias(key)).join(lost, key, "left")
    out = out.withColumn(total, F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    at = F.array_except(F.sequence(F.lit(0), (F.col(total) - 1).cast("int")), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get(split, i)), "\n"))
    counts = [c.alias(name) for c, name in ((F.col(total), n_lines), (F.coalesce(F.size(gone).cast("long"), F.lit(0)), n_dropped)) if name]
    stay = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    return out.select(*[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in stay], *counts)


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 3, fanout: int = 2, n_lines: str | None = None, n_dropped: str | None = None, folder: str | None = None) -> DataFrame:
    """docs without the lines whose key occurs in min_docs rows or more (just so many count). The rows arrive in
    ``batches`` parts by a hash of id and text; each adds a run, and the last look at the runs decides for all of them.
    folder: runs of earlier tables, which count too, and to which these are added.

    Null and empty texts hold one empty line, which never counts as repeated. Each row is one document, also
    where rows or ids repeat. A text that loses all its lines becomes empty. No row is lost, and columns of any name
    stay, but for those named n_lines and n_dropped, which are replaced. An empty table gives an empty table."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))
    runs = LineRuns(docs.sparkSession, min_docs, fanout, folder)
    for b in range(batches):
        runs.add(line_counts(docs.where(part == b)))
    return drop_lines(docs, runs.repeated(), n_lines, n_dropped)
