"""What several operators share: words, case folding, and tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a table that may be broadcast (16 to 64 bytes a row).
BROADCAST_ROWS = 200_000
#: Most bytes of a column of any length in a table that may be broadcast.
BROADCAST_BYTES = 32_000_000
#: Rows of whole texts that go to a Python worker in one Arrow batch.
BATCH_ROWS = 1000
#: Most bytes of text that a Python worker turns into arrays at once.
PIECE_BYTES = 1_000_000


def lower_az(text: Column) -> Column:
    """A-Z to a-z, nothing else. All-ASCII text takes the faster lower()."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one will do if all run in
    one process; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, *partition_by: str, row_group_bytes: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation.
    row_group_bytes: for rows of long arrays, which readers hold a row group at a time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # an empty partitioned table has no file to tell its schema


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, wherever Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def forget(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more, and lets Spark drop the shuffles that it came from."""
    jvm = table.sparkSession.sparkContext._jvm
    files = table.inputFiles()
    if files:
        folder = shared_folder(table.sparkSession)
        name = files[0][files[0].index("/table-") :].split("/")[1]
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, wide: Column | None = None) -> DataFrame:
    """df marked for broadcast if it is counted and found within the bounds; else as it is, for a shuffled join.
    wide: a column of any length, whose bytes are added up too."""
    return F.broadcast(df) if within(df, rows, wide) else df


def within(df: DataFrame, rows: int = BROADCAST_ROWS, wide: Column | None = None) -> bool:
    """Whether df has at most so many rows, and wide at most BROADCAST_BYTES; it looks no further than so many rows."""
    found = df.select((F.lit(0) if wide is None else F.octet_length(wide)).alias("size")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return found.n <= rows and (found.size or 0) <= BROADCAST_BYTES


def fresh(df: DataFrame, name: str) -> str:
    """name, or one made from it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """128 bits that tell rows of (doc_id, text) apart; rows equal in both are one."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat_ws("\x00", *marked).cast("binary")))


def sampled(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """The rows of df, with __h, that have the ``rows`` smallest different values of the 64-bit hash h; of rows with
    one hash, one. How many hashes there are, counted first, sets a limit that about twice as many pass: what meets
    in one task to be put in order is then bounded by rows, however many tasks there are."""
    df = df.withColumn("__h", h)
    n = df.agg(F.approx_count_distinct("__h")).first()[0]
    limit = min((1 << 63) - 1, int((2 * rows + 100) / max(n, 1) * 2.0**64) - (1 << 63))
    near = df.where(F.col("__h") <= limit)
    last = near.select("__h").distinct().orderBy("__h").limit(rows).agg(F.max("__h")).first()[0]
    return near.where(F.col("__h") <= F.lit(last).cast("bigint")).dropDuplicates(["__h"])


def pieces(texts: list, limit: int = PIECE_BYTES):
    """(first, end) ranges of texts of about limit characters each, so that arrays made from them stay small."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches to BATCH_ROWS rows, unless the session has set a number of its own: a row here is a whole
    text, and Spark's default of 10,000 of them takes hundreds of megabytes beside the heap of each executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def lean(run):
    """run for mapInArrow, which gives the memory that its task has freed back to the system at its end: workers stay
    for later tasks, and else they would hold what the largest one needed."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return task


def map_texts(docs: DataFrame, fields: list[tuple[str, str]], start, key: Column | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs with columns computed from text, whole texts at a time. start() is called once a task and returns a
    function from a list of texts to a list of values for each of fields (name, Spark type). Columns of docs with
    these names are replaced (text itself may be one); all others stay. key: what the function gets as its second
    argument for each text. piece_bytes: about how much text the function gets at once."""
    small_batches(docs.sparkSession)
    names = [name for name, _ in fields]
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(kind).alias(name) for name, kind in fields]).schema
    arrow = to_arrow_schema(schema)
    has_key = key is not None

    def run(batches):
        compute = start()
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for first, end in pieces(texts, piece_bytes):
                part = batch.slice(first, end - first)
                own = texts[first:end]
                columns = compute(own, part.column("__key").to_pylist()) if has_key else compute(own)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(v, arrow.field(name).type) for name, v in zip(names, columns)]], [*kept, *names])

    keyed = [key.alias("__key")] if has_key else []
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("__text"), *keyed).mapInArrow(lean(run), schema)
