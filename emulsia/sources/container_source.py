"""Containers as a data source: spark.read.format("photo-container") and df.write.format("photo-container").

A read takes only what its schema names: path and size come from the listing, names from an archive's directory at its
end, the manifest from one range, and only `members` reads a whole file. So give the schema that is wanted. A write puts
each task's files under a folder of the job and moves them when all tasks are done; a task or a job that fails leaves none.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from emulsia.errors import ContainerError
from emulsia.sources import container

NAME = "photo-container"
SCHEMA = "path string, size long, names array<string>, manifest string, members map<string,binary>, error string"
ARROW = {"path": pa.string(), "size": pa.int64(), "names": pa.list_(pa.string()), "manifest": pa.string(), "members": pa.map_(pa.string(), pa.binary()), "error": pa.string()}
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 1024
#: The rows that a read hands on at once, fewer where they reach the bytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
MOVES_AT_ONCE = 8
_TEMPORARY = "_temporary-"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Names and sizes of some files of the folder."""

    names: list[str]
    sizes: list[int]


def looked_up(file, columns: list[str]) -> dict[str, object]:
    """What the columns ask of one archive, given as a file that can seek; an unreadable one has an error."""
    out: dict[str, object] = {}
    try:
        with zipfile.ZipFile(file) as z:
            names = z.namelist()
            out["names"] = names
            if "manifest.json" not in names:
                out["error"] = "manifest.json is missing"
            elif "manifest" in columns:
                out["manifest"] = z.read("manifest.json").decode()
            if "members" in columns:
                out["members"] = [(n, z.read(n)) for n in names if n != "manifest.json"]
    except (zipfile.BadZipFile, EOFError, OSError, ValueError) as e:  # a file of pyarrow says ValueError beyond its ends
        out = {"error": f"unreadable: {type(e).__name__}"}
    return out


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.zip")
        self.columns = schema.fieldNames()
        unknown = [c for c in self.columns if c not in ARROW]
        if unknown:
            raise ContainerError(f"a container has no columns {', '.join(unknown)}")

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths, some of them a partition."""
        fs, root = _filesystem(self.path)
        found = sorted((f.base_name, f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file and fnmatch.fnmatch(f.base_name, self.glob))
        out, total = [Files([], [])], 0
        for name, size in found:
            if out[-1].names and (total + size > PARTITION_BYTES or len(out[-1].names) >= PARTITION_FILES):
                out.append(Files([], []))
                total = 0
            out[-1].names.append(name)
            out[-1].sizes.append(size)
            total += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(self.path)
        schema = pa.schema([(c, ARROW[c]) for c in self.columns])
        opened = not {"path", "size"}.issuperset(self.columns)
        rows, held = [], 0
        for name, size in zip(partition.names, partition.sizes):
            path = posixpath.join(root, name)
            row: dict[str, object] = {}
            if opened:
                try:
                    with fs.open_input_file(path) as file:
                        row = looked_up(file, self.columns)
                except OSError as e:
                    row = {"error": f"unreadable: {type(e).__name__}"}
            row |= {"path": path, "size": size}
            rows.append({c: row.get(c) for c in self.columns})
            held += sum(len(data) for _, data in row.get("members") or []) + len(row.get("manifest") or "")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder in the job's, and a number of each of its files' names."""

    folder: str
    numbers: bytes


def numbered(name: str) -> bytes:
    """Eight bytes that tell most names apart."""
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


class ContainerWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, f"{_TEMPORARY}{uuid.uuid4().hex}"
        missing = {"path", "manifest", "members"} - set(schema.fieldNames())
        if missing:
            raise ContainerError(f"a container needs the columns {', '.join(sorted(missing))}")
        # only here: a task that still runs when the job was given up can't bring the folder back
        fs, root = _filesystem(self.path)
        fs.create_dir(posixpath.join(root, self.job))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        folder = posixpath.join(root, self.job, uuid.uuid4().hex)
        done: dict[str, bytes] = {}
        made = False
        try:
            for row in iterator:
                name = posixpath.basename(row["path"])
                if not name:
                    raise ContainerError("a container needs a name")
                if name in done:
                    raise ContainerError(f"two rows would be {posixpath.join(root, name)}")
                if not made:
                    fs.create_dir(folder, recursive=False)  # not with its parent: that of a job that was given up is gone
                    made = True
                done[name] = numbered(name)
                with fs.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(container.pack(row["manifest"], dict(row["members"] or {})))
        except BaseException:
            if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
                fs.delete_dir(folder)
            raise
        return Written(folder, b"".join(done.values()))

    def _twice(self, fs: pyarrow.fs.FileSystem, written: list[Written]) -> str | None:
        """A name that two tasks wrote: those with an equal number are compared."""
        found, counts = np.unique(np.frombuffer(b"".join(m.numbers for m in written), dtype=np.uint64), return_counts=True)
        equal = {n.tobytes() for n in found[counts > 1]}
        seen: set[str] = set()
        for m in written if equal else []:
            for name in self._names(fs, m.folder):
                if numbered(name) in equal:
                    if name in seen:
                        return name
                    seen.add(name)
        return None

    @staticmethod
    def _names(fs: pyarrow.fs.FileSystem, folder: str) -> list[str]:
        return [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.is_file]

    @staticmethod
    def _move(fs: pyarrow.fs.FileSystem, folder: str, root: str, names: list[str]) -> None:
        for name in names:
            fs.move(posixpath.join(folder, name), posixpath.join(root, name))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.path)
        written = [m for m in messages if m and m.numbers]
        twice = self._twice(fs, written)
        if twice is not None:
            self._drop(fs, root)
            raise ContainerError(f"two rows would be {posixpath.join(root, twice)}")
        old = {n for n in self._names(fs, root) if n.endswith(".zip")} if self.overwrite else set()
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for m in written:
                names = self._names(fs, m.folder)
                if len(names) * len(numbered("")) != len(m.numbers):
                    self._drop(fs, root)
                    raise ContainerError(f"files of a task are gone from {m.folder}")
                old.difference_update(names)
                list(pool.map(lambda some, folder=m.folder: self._move(fs, folder, root, some), [names[i::MOVES_AT_ONCE] for i in range(MOVES_AT_ONCE)]))
        for name in old:
            fs.delete_file(posixpath.join(root, name))
        self._drop(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_filesystem(self.path))

    def _drop(self, fs: pyarrow.fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, self.job)
        if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(folder)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ContainerWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, manifest (text) and error of the containers of a folder, without reading their members."""
    register(spark)
    return spark.read.format(NAME).schema("path string, size long, manifest string, error string").load(folder)
