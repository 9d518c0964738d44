"""Arrow (Feather) files as a Spark data source: ``spark.read.format("feather")`` and ``df.write.format("feather")``.

The schema comes from a file's footer, and the footer tells how many record batches a file has: a large file is read by several tasks,
each of which reads its own batches only. A task writes under a temporary name; its file gets its own name when the whole
job has succeeded, and goes when the job fails. All folders are reached through the file system their address names, so driver
and executors must share it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "feather"
SUFFIXES = (".feather", ".arrow")
#: Bytes of neighbouring record batches that one task reads, about.
PARTITION_BYTES = 64 << 20
#: Files of a job that is not done yet lie in this folder below the target.
PENDING = "_temporary"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; an address without a scheme is a local path."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path if len(path) == 1 else path.rstrip("/")
    return fs.FileSystem.from_uri(path)


def data_files(path: str) -> list[fs.FileInfo]:
    """The files to read at a path, in order: itself, or the Feather files below it, without hidden and unfinished ones."""
    system, root = open_path(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.File:
        return [found]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"nothing to read at {path}")
    inside = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda f: any(p[0] in "._" for p in posixpath.relpath(f.path, root).split("/"))
    return sorted((f for f in inside if f.type == fs.FileType.File and f.path.endswith(SUFFIXES) and not hidden(f)), key=lambda f: f.path)


@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``end`` of one file."""

    file: str
    first: int
    end: int


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, bytes_each: int):
        self.path, self.schema, self.bytes_each = path, schema, bytes_each

    def partitions(self) -> list[Batches]:
        system, _ = open_path(self.path)
        out = []
        for info in data_files(self.path):
            with system.open_input_file(info.path) as source, ipc.open_file(source) as file:
                count = file.num_record_batches
            each = max(1, int(self.bytes_each * count // max(1, info.size)))
            out += [Batches(info.path, low, min(count, low + each)) for low in range(0, count, each)]
        # Spark needs one part at least
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        system, _ = open_path(self.path)
        target = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as source, ipc.open_file(source) as file:
            for i in range(partition.first, partition.end):
                table = pa.Table.from_batches([file.get_batch(i)])
                yield from table.select(target.names).cast(target).to_batches()


@dataclass
class Written(WriterCommitMessage):
    pending: str
    name: str
    rows: int


class FeatherWriter(DataSourceArrowWriter):
    """Files appear in the target folder when all tasks have ended well; with ``overwrite`` the files there before go then."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, compression: str | None):
        self.path, self.schema, self.overwrite, self.compression = path, schema, overwrite, compression
        self.job = uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return posixpath.join(root, PENDING, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = open_path(self.path)
        schema = to_arrow_schema(self.schema)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.feather"
        # attempts of one task do not share a file
        pending = posixpath.join(self._pending(root), f"{uuid.uuid4().hex}-{name}")
        system.create_dir(self._pending(root), recursive=True)
        rows = 0
        options = ipc.IpcWriteOptions(compression=self.compression)
        with system.open_output_stream(pending) as sink, ipc.new_file(sink, schema, options=options) as writer:
            for batch in iterator:
                for part in pa.Table.from_batches([batch]).cast(schema).to_batches():
                    writer.write_batch(part)
                    rows += part.num_rows
        return Written(pending, name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        before = data_files(self.path) if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory else []
        for message in messages:
            if message is not None:
                system.move(message.pending, posixpath.join(root, message.name))
        for info in before:
            system.delete_file(info.path)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_path(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        """What attempts left behind that failed or came second."""
        if system.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(root))
        top = posixpath.join(root, PENDING)
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


class FeatherSource(DataSource):
    """Options: ``path``; ``partitionBytes`` (reading); ``compression`` lz4, zstd or none (writing)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        path = self.options["path"]
        files = data_files(path)
        if not files:
            raise ValueError(f"no Feather files at {path}; an empty folder needs a schema")
        system, _ = open_path(path)
        with system.open_input_file(files[0].path) as source, ipc.open_file(source) as file:
            return from_arrow_schema(file.schema)

    def reader(self, schema: StructType) -> FeatherReader:
        return FeatherReader(self.options["path"], schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FeatherWriter:
        compression = self.options.get("compression", "lz4")
        return FeatherWriter(self.options["path"], schema, overwrite, None if compression == "none" else compression)
