"""Files as a sink: rows of (name, content) become files that appear when the job commits, and none if it fails."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files; None if it had no rows. Their names never go through the driver."""

    folder: str | None


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        """A task's files, in a folder of its own attempt."""
        system, root = _place(self.folder)
        own = f"{root}/_work-{self.job}/{uuid.uuid4().hex}"
        names = set()
        try:
            for row in rows:
                name, content = row[0], row[1]
                if not name or "/" in name or "\\" in name or name[0] in "._" or content is None:
                    raise ValueError(f"not a file to write: {name!r}")
                if name in names:
                    raise ValueError(f"two files have the name {name!r}")
                if not names:
                    system.create_dir(own, recursive=True)
                names.add(name)
                with system.open_output_stream(f"{own}/{name}") as out:
                    out.write(bytes(content))
        except BaseException:
            if names:
                system.delete_dir(own)
            raise
        return Written(own if names else None)

    def commit(self, messages: list[Written | None]) -> None:
        """Each task's folder gets its name: a rename a task, whatever the number of files."""
        system, root = _place(self.folder)
        for k, message in enumerate(m for m in messages if m and m.folder):
            system.move(message.folder, f"{root}/part-{k:05d}-{self.job}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Nothing of this job stays: also what lost tasks and second attempts have left."""
        system, root = _place(self.folder)
        work = f"{root}/_work-{self.job}"
        if system.get_file_info(work).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(work)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavelake_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder and never replaced")
        return FileWriter(self.options["path"])


def save_files(files: DataFrame, folder: str, name: str = "name", content: str = "content", partitions: int = 200) -> None:
    """Each row as a file <folder>/part-*/<name>. folder is one that all executors share, a path or a URI that pyarrow
    opens; open_files(spark, folder + "/part-*") reads what is there.

    Files show up when all tasks are done; if one fails for good, or a name is bad or comes twice, the job fails and
    leaves nothing. Rows of one name meet in one task for this, so names are spread over partitions tasks by their hash.
    A name is not empty, has no slash, and begins with neither dot nor underscore; a null name or content is an error.
    An empty table writes nothing. Earlier files of the folder stay, also those of equal names."""
    files.sparkSession.dataSource.register(Files)
    rows = files.select(F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{content}`").cast("binary").alias("content"))
    rows.repartition(partitions, "name").write.format("wavelake_files").option("path", folder).mode("append").save()
