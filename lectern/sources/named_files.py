"""A sink that writes every row as a file of its own name, each exactly once.

A task writes into a folder of its own; only when all tasks are done are the files
of those that were committed moved to their place. What killed, repeated or
speculative tasks left behind goes with the temporary folder, and a job that is
aborted leaves the folder as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.sources.delimited import file_system

WORK = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


def checked_name(name: str | None) -> str:
    """The name, if it is one of a file in the folder itself."""
    if not name or "/" in name or "\\" in name or "\0" in name or name.startswith(("_", ".")):
        raise ValueError(f"not the name of a file: {name!r}")
    return name


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return file_system(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        """The task's files, in a folder that no other attempt shares. A null content is an empty file."""
        files, root = self._at()
        folder = None
        for row in iterator:
            if folder is None:
                folder = f"{root}/{WORK}/{self.job}/{uuid.uuid4().hex}"
                files.create_dir(folder, recursive=True)
            content = row["content"]
            with files.open_output_stream(f"{folder}/{checked_name(row['name'])}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the tasks that were committed. Two rows of one name are refused before anything is moved."""
        files, root = self._at()
        folders = [m.folder for m in messages if m is not None and m.folder]
        made = [f for folder in folders for f in files.get_file_info(fs.FileSelector(folder))]
        names = [f.base_name for f in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"{len(names) - len(set(names))} names occur more than once")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.base_name != WORK:
                    (files.delete_file if f.is_file else files.delete_dir)(f.path)
        for f in made:
            files.move(f.path, f"{root}/{f.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = self._at()
        for at in (f"{root}/{WORK}/{self.job}", f"{root}/{WORK}"):
            if files.get_file_info(at).type == fs.FileType.Directory and (at.endswith(self.job) or not files.get_file_info(fs.FileSelector(at))):
                files.delete_dir(at)


class NamedFiles(DataSource):
    """Format ``named_files``: rows of (name, content); mode ``overwrite`` empties the folder first, ``append`` replaces files of the same names."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("rows need the columns name and content")
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Each row of (name, content) as a file under ``path``. Names are unique, and plain file names; an empty table leaves an empty folder."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append").option("path", path).save()
