"""Source trees and archives as ``(path, content)`` tables.

Spark's own file sources skip names that start with an underscore, so
``__init__.py`` would be lost; files are listed and read in tasks through Arrow's
file systems instead.
"""

from __future__ import annotations

import contextlib
import functools
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

_PATHS = "path string"
_FILES = "path string, content string, error string"
# Bytes of files a task reads when there are many.
_TASK_BYTES = 64 << 20
# What a file, archive or member that cannot be read raises.
_UNREADABLE = (
    OSError, ValueError, zipfile.BadZipFile, zlib.error, struct.error, RuntimeError,
    NotImplementedError, EOFError, KeyError,
)


def open_root(root: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a folder, its path there, and what full paths start with."""
    root = root.rstrip("/")
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root.removeprefix("file:")
    if "://" not in root:
        return fs.LocalFileSystem(), root, ""
    system, inner = fs.FileSystem.from_uri(root)
    return system, inner, root[: len(root) - len(inner)] if root.endswith(inner) else ""


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _list_files(spark: SparkSession, system: fs.FileSystem, inner: str, suffix: str) -> DataFrame:
    """``path``, ``size`` and ``error`` of the files with a suffix below a folder.

    Folders are listed level by level, a task for some folders of a level, so neither a deep
    tree nor many folders wait for one task.  A folder that cannot be listed gives a row with
    its error.
    """
    names = ["path", "folder", "size", "error"]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    infos = system.get_file_info(fs.FileSelector(path))
                    below = fs.FileType.Directory
                    rows = [(i.path, i.type == below, i.size, None) for i in infos]
                except OSError as error:
                    rows = [(path, False, None, _reason(error))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                types = [pa.string(), pa.bool_(), pa.int64(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    level, found = spark.createDataFrame([(inner,)], _PATHS), []
    while level.limit(1).count():
        listed = level.mapInArrow(look, "path string, folder boolean, size long, error string")
        listed = stored(listed, "listing")
        found.append(listed.where("NOT folder").drop("folder"))
        level = listed.where("folder").select("path").repartition("path")
    every = functools.reduce(DataFrame.unionByName, found)
    return every.where(F.col("error").isNotNull() | F.col("path").endswith(suffix))


def _spread(spark: SparkSession, files: DataFrame, *order: str) -> DataFrame:
    """The files over as many tasks as their bytes ask for, but no more than there are files."""
    bytes_, count = files.agg(F.sum("size"), F.count(F.lit(1))).first()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(count, max(usual, (bytes_ or 0) // _TASK_BYTES)))
    return files.repartition(tasks, *order)


def _read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as stream:
        return stream.read()


def _row(path: str, read: Callable[[], bytes], error: str | None = None) -> pa.RecordBatch:
    """One row: the text of a file, or why there is none."""
    content = None
    if error is None:
        try:
            content = read().decode("utf-8")
        except _UNREADABLE as problem:
            error = _reason(problem)
    columns = [pa.array([x], pa.string()) for x in (path, content, error)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "content", "error"])


def source_scan(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """``path``, ``content`` and ``error`` of every file with the suffix below a folder.

    A file or folder that cannot be read, or is not UTF-8, gives a row without content and
    the reason; the rest is read.
    """
    system, inner, prefix = open_root(root)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _row(prefix + path, functools.partial(_read, system, path), error)

    listed = _list_files(spark, system, inner, suffix)
    return _spread(spark, listed, "path").select("path", "error").mapInArrow(read, _FILES)


def _members(spark: SparkSession, system: fs.FileSystem, inner: str, suffix: str) -> DataFrame:
    """``path`` of each archive, ``member``, ``size`` and ``error``, from the archives' directories."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(path, None, None, error)]
                if error is None:
                    try:
                        with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                            infos = archive.infolist()
                        rows = [(path, i.filename, i.file_size, None) for i in infos if i.filename.endswith(suffix)]
                    except _UNREADABLE as problem:
                        rows = [(path, None, None, _reason(problem))]
                types = [pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "member", "size", "error"])

    archives = _spread(spark, _list_files(spark, system, inner, ".zip"), "path")
    schema = "path string, member string, size long, error string"
    return stored(archives.select("path", "error").mapInArrow(look, schema), "members")


def archive_scan(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """Members with the suffix of every ZIP archive below a folder.

    The archives' directories are read first, then the members spread over all tasks,
    whatever archive they are in.  Member names are only data: nothing is extracted to disk.
    A broken archive or member gives a row without content and the reason.
    """
    system, inner, prefix = open_root(root)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as last:
            now, archive = None, None
            for batch in batches:
                for path, member, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if member is None:
                        yield _row(prefix + path, bytes, error)
                        continue
                    if path != now:
                        last.close()
                        file = last.enter_context(system.open_input_file(path))
                        archive, now = last.enter_context(zipfile.ZipFile(file)), path
                    yield _row(f"{prefix}{path}/{member}", functools.partial(archive.read, member))

    members = _spread(spark, _members(spark, system, inner, suffix), "path", "member")
    members = members.select("path", "member", "error").sortWithinPartitions("path")
    return members.mapInArrow(read, _FILES)
