"""Image assets as a data source: ``df.write.format("lectern_assets").save(root)`` and ``spark.read.format("lectern_assets").load(root)``.

Rows are (path, bytes), paths relative to the root as :func:`catalog.assets` gives them. A task writes its files to a
staging folder below the root, and last a list of their names. Only when all tasks are done does the job's commit move the files in
place, list by list, so nothing of a job that fails is ever seen; its staging folder goes, and a task that is still running then
finds its job closed and removes what it wrote. Spark is sent one message a task, never names or bytes. Of a task that ran
twice only the run that Spark counts is moved.

The root is any place that pyarrow's file systems reach (local and shared folders, hdfs, s3, gs). Mode "append" overwrites
files of the same name and leaves others; with "overwrite" other assets below the root go when the job commits.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING, FOLDER = "_staging", "assets"


def place(root: str):
    """(file system, path) of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def safe_path(path: str) -> str:
    """A path below the assets' folder; anything else is refused."""
    clean = posixpath.normpath(path)
    if clean != path or not clean.startswith(FOLDER + "/") or "/../" in f"/{clean}/":
        raise ValueError(f"no path of an asset: {path!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: int
    size: int


class AssetWriter(DataSourceWriter):
    #: Files that the commit moves at a time.
    threads = 16

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex
        system, base = place(root)
        system.create_dir(self.staging(base), recursive=True)
        with system.open_output_stream(self.opened(base)) as out:
            out.write(b"")

    def staging(self, base: str) -> str:
        return posixpath.join(base, STAGING, self.job)

    def opened(self, base: str) -> str:
        """A file that is there as long as the job is open."""
        return posixpath.join(self.staging(base), "open")

    def write(self, iterator: Iterator) -> Written:
        system, base = place(self.root)
        name = uuid.uuid4().hex
        task = posixpath.join(self.staging(base), name)
        self._check(system, base, None)
        system.create_dir(task, recursive=True)
        names, size = [], 0
        try:
            for row in iterator:
                if row.path is None or row.bytes is None:
                    continue
                names.append(safe_path(row.path))
                with system.open_output_stream(f"{task}/{len(names) - 1}") as out:
                    out.write(bytes(row.bytes))
                size += len(row.bytes)
            with system.open_output_stream(f"{task}/list.json") as out:
                out.write(json.dumps(names).encode())
        except BaseException:
            self._drop(system, task)
            raise
        self._check(system, base, task)
        return Written(name, len(names), size)

    def _check(self, system, base: str, task: str | None) -> None:
        """Refuse to go on once the job is closed; what ``task`` wrote goes, and the job's folder that it may have made again."""
        from pyarrow import fs

        if system.get_file_info(self.opened(base)).type != fs.FileType.File:
            if task:
                self._drop(system, task)
                self._clear(system, base)
            raise RuntimeError("the job that this task belongs to is over")

    @staticmethod
    def _drop(system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self.opened(base)).type != fs.FileType.NotFound:
            system.delete_file(self.opened(base))
        self._drop(system, self.staging(base))
        whole = posixpath.join(base, STAGING)
        if not system.get_file_info(fs.FileSelector(whole, allow_not_found=True)):
            self._drop(system, whole)

    def commit(self, messages: list) -> None:
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        system, base = place(self.root)
        kept, made = set(), set()

        def move(source: str, target: str) -> None:
            system.move(source, target)

        with ThreadPoolExecutor(self.threads) as pool:
            for message in filter(None, messages):
                task = posixpath.join(self.staging(base), message.task)
                with system.open_input_stream(f"{task}/list.json") as file:
                    names = json.loads(file.read())
                targets = [posixpath.join(base, x) for x in names]
                for folder in {posixpath.dirname(x) for x in targets} - made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                if self.overwrite:
                    kept.update(targets)
                list(pool.map(move, [f"{task}/{k}" for k in range(len(targets))], targets))
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(posixpath.join(base, FOLDER), recursive=True, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path not in kept:
                    system.delete_file(info.path)
        self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*place(self.root))


class RunFolder(InputPartition):
    """The assets of one run."""


class AssetReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = place(self.root)
        found = system.get_file_info(fs.FileSelector(posixpath.join(base, FOLDER), allow_not_found=True))
        return [RunFolder(x.base_name) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.Directory] or [RunFolder(None)]

    def read(self, partition: RunFolder) -> Iterator[tuple]:
        from pyarrow import fs

        if partition.value is None:
            return
        system, base = place(self.root)
        folder = posixpath.join(base, FOLDER, partition.value)
        for info in sorted(system.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda x: x.path):
            if info.type == fs.FileType.File:
                with system.open_input_stream(info.path) as file:
                    yield posixpath.join(FOLDER, partition.value, posixpath.relpath(info.path, folder)), info.size, file.read()


class AssetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_assets"

    def schema(self) -> str:
        return "path string, size_bytes long, bytes binary"

    def _root(self) -> str:
        root = self.options.get("path")
        if not root:
            raise ValueError("the assets' root is missing: give it to load() or save()")
        return root

    def reader(self, schema) -> AssetReader:
        return AssetReader(self._root())

    def writer(self, schema, overwrite: bool) -> AssetWriter:
        missing = {"path", "bytes"} - set(schema.fieldNames())
        if missing:
            raise ValueError("the rows lack " + ", ".join(sorted(missing)))
        return AssetWriter(self._root(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    from ..deploy import ship

    ship(spark)
    spark.dataSource.register(AssetSource)
