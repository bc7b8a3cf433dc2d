"""A sink that writes one file a document.

Each task writes below a folder of its own attempt inside `_pending`; the commit moves the folders of the attempts that
succeeded into place, one rename a task, and marks the whole with `_SUCCESS`; an abort removes `_pending`. So a reader that waits
for `_SUCCESS` sees no half-written file, and lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NAME = "document_files"


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task's attempt filled, and its files."""

    folder: str
    files: int


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ".txt"), overwrite
        self.key, self.body = options.get("key", names[0]), options.get("body", names[-1])
        self.job = uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if re.match(r"\w+:", self.path) else f"file://{self.path}")

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = self._at()
        task = TaskContext.get()
        folder = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        made, n = f"{root}/_pending/{self.job}/{folder}", 0
        for row in rows:
            if not n:
                files.create_dir(made, recursive=True)
            # what a name cannot hold is written as its number
            name = re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):x}", str(row[self.key]))
            with files.open_output_stream(f"{made}/{name}{self.suffix}") as out:
                out.write((row[self.body] or "").encode())
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._at()
        if files.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.File:
            files.delete_file(f"{root}/_SUCCESS")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        files.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.files:
                files.move(f"{root}/_pending/{self.job}/{message.folder}", f"{root}/{message.folder}-{self.job[:8]}")
        self.abort(messages)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        files, root = self._at()
        if files.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_pending")


class DocumentFiles(DataSource):
    """Rows of a key and a text as files `<key><suffix>` below the option `path`, in a folder for each task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentFilesWriter(dict(self.options), schema.fieldNames(), overwrite)


def write_files(df: DataFrame, path: str, key: str = "doc_id", body: str = "body", suffix: str = ".txt") -> None:
    """Write `body` of each row to a file named by `key`, in place of what the folder held. Null texts make empty files; of rows
    that repeat a key in one task the last stays."""
    df.sparkSession.dataSource.register(DocumentFiles)
    df.select(key, body).write.format(NAME).option("key", key).option("body", body).option("suffix", suffix).mode("overwrite").save(path)
