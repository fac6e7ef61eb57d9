"""Files of any size as byte ranges: a table of ranges is dealt to tasks, and each reads its own bytes alone.

Spark's binaryFile holds a whole file in one row, of at most 2 GiB. Here a file is (path, length), which that source
gives without reading it; what a scan walks is read through a window of a few kilobytes, so only the heads of chunks,
blocks and pages are touched; and samples come as ranges of whole frames, from as many tasks as there are ranges.

Paths without a scheme and file: paths are opened by Python, others by pyarrow's file systems (hdfs, s3, gs); a store
that only Spark can read needs open_files()."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a window reads at once.
WINDOW = 65_536
#: About how many bytes of ranges a task gives on together.
MOST_BYTES = 16_000_000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path or pattern names, without their contents; none is too long, and empty ones
    are not listed."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opened(path: str) -> BinaryIO:
    """The file for reading at any place."""
    local = re.fullmatch(r"(?:file:(?://(?:localhost)?)?)?(/.*)", path)
    if local:
        return open(unquote(local[1]) if path.startswith("file:") else path, "rb")
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class FileBytes:
    """A file that is sliced, searched and measured as bytes are, and holds one window of itself."""

    def __init__(self, path: str, length: int):
        self.file, self.length, self.start, self.window = opened(path), length, 0, b""

    def __len__(self) -> int:
        return self.length

    def read(self, start: int, stop: int) -> bytes:
        if not (self.start <= start and stop <= self.start + len(self.window)):
            if stop - start > WINDOW:
                self.file.seek(start)
                return self.file.read(stop - start)
            self.file.seek(start)
            self.start, self.window = start, self.file.read(min(WINDOW, self.length - start))
        return self.window[start - self.start : stop - self.start]

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, step = at.indices(self.length)
            own = self.read(start, stop) if stop > start else b""
            return own if step == 1 else own[::step]
        if not -self.length <= at < self.length:
            raise IndexError(at)
        at += self.length if at < 0 else 0
        return self.read(at, at + 1)[0]

    def find(self, what: bytes, start: int = 0, stop: int | None = None) -> int:
        stop = self.length if stop is None else min(stop, self.length)
        while start + len(what) <= stop:
            own = self.read(start, min(start + WINDOW, stop))
            if (at := own.find(what)) >= 0:
                return start + at
            start += len(own) - len(what) + 1
        return -1

    def close(self) -> None:
        self.file.close()


def read_ranges(ranges: DataFrame, path: str = "path", start: str = "start", stop: str = "stop", data: str = "data") -> DataFrame:
    """ranges with the bytes from start up to stop of the file at path; what lies past its end is missing, and null or
    empty ranges give null or no bytes. Every other column stays; a column of the name data is replaced. Each task opens
    the files of its own rows: repartition ranges for more tasks."""
    kept = [c for c in ranges.columns if c != data]
    schema = ranges.select(*[F.col(f"`{c}`") for c in kept]).schema.add(data, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, out, size = 0, [], 0
            last, file = None, None
            for i, (p, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (path, start, stop)))):
                if p is None or a is None or b is None:
                    out.append(None)
                else:
                    if p != last:
                        if file:
                            file.close()
                        last, file = p, opened(p)
                    file.seek(max(a, 0))
                    out.append(file.read(max(b - max(a, 0), 0)))
                    size += len(out[-1])
                if size >= MOST_BYTES or i + 1 == batch.num_rows:
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, data])
                    first, out, size = i + 1, [], 0
            if file:
                file.close()

    return ranges.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def pieces(rows: DataFrame, offset: Column, length: Column, step: Column | int, start: str = "start", stop: str = "stop") -> DataFrame:
    """rows, each once for every range of at most step bytes of the length bytes from offset, as (start, stop), dealt to
    as many tasks as the session has shuffle partitions. Rows without length give none."""
    step = step if isinstance(step, Column) else F.lit(step)
    cut = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((length - 1) / step)))
    out = rows.select("*", F.explode(cut).alias(start)).withColumn(start, offset + F.col(start) * step)
    out = out.withColumn(stop, F.least(F.col(start) + step, offset + length))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as rows are small and bytes are not
    return out.repartition(tasks, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.col(start)))
