"""One text file for each document, written by the tasks that hold the documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from casemill.rules.defaults import NO_KEY

#: The file that says that all documents are there, and the folder of attempts that are not committed.
DONE, ATTEMPTS = "_SUCCESS", "_attempts"


def file_system(path: str):
    """The file system of a path or address, and the path in it. It must be able to rename folders."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_name(key: str | None) -> str:
    """A key as the name of a file: what separates folders or makes readers skip a file is written as ``%XX``."""
    name = quote(NO_KEY if key is None else key, safe=" ()[]{}+,;=@!&'~$")
    return name.replace(".", "%2E", 1) if name.startswith(".") else name.replace("_", "%5F", 1) if name.startswith("_") else name


@dataclass
class Written(WriterCommitMessage):
    """The attempt of a task that counts."""

    folder: str
    part: str
    files: int


class DocumentWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own. The job moves the folders of the attempts that count to where
    readers look, one rename for a task, and drops all others: an attempt that failed, or ran twice, leaves no file there.
    What a task still writes after its job was given up stays in the folder of attempts, which readers skip."""

    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex
        store, root = file_system(path)
        from pyarrow import fs

        held = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        if not overwrite and any(info.base_name == DONE or not info.base_name.startswith("_") for info in held):
            raise ValueError(f"{path} already holds documents")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        task = TaskContext.get()
        part, seen, files = f"part-{task.partitionId():05d}", {}, 0
        folder = f"{root}/{ATTEMPTS}/{self.job}/{part}-{task.taskAttemptId()}"
        for batch in iterator:
            for key, text in zip(*(batch.column(n).to_pylist() for n in ("key", "text"))):
                name = file_name(key)
                seen[name] = again = seen.get(name, 0) + 1
                where = folder if again == 1 else f"{folder}/again-{again}"
                if files == 0 or again > 1:
                    store.create_dir(where, recursive=True)
                with store.open_output_stream(f"{where}/{name}{self.suffix}") as out:
                    out.write(f"{text or ''}\n".encode())
                files += 1
        return Written(folder, part, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        if self.overwrite:
            self._clear(store, root)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.files:
                store.move(m.folder, f"{root}/{m.part}")
        self._drop_attempts(store, root)
        with store.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_attempts(*file_system(self.path))

    def _drop_attempts(self, store, root) -> None:
        from pyarrow import fs

        for folder in (f"{root}/{ATTEMPTS}/{self.job}", f"{root}/{ATTEMPTS}"):
            if store.get_file_info(folder).type != fs.FileType.Directory:
                continue
            if folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder)):
                store.delete_dir(folder)

    @staticmethod
    def _clear(store, root) -> None:
        """What an earlier job has committed."""
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.type == fs.FileType.Directory:
                store.delete_dir(info.path)
            elif info.base_name == DONE:
                store.delete_file(info.path)


class TextDocuments(DataSource):
    """``key`` and ``text`` as ``<path>/part-<task>/<key><suffix>``; the sink ``text_documents``."""

    @classmethod
    def name(cls) -> str:
        return "text_documents"

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite, self.options.get("suffix", ".txt"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextDocuments)
