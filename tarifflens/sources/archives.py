"""A data source of price files: archives are planned from their directories, and members are read where they are needed.

    spark.dataSource.register(PriceFiles)
    spark.read.format("price_files").option("what", "rows").load("s3://bucket/in")

Planning reads each archive's central directory alone, and deals runs of members to partitions by their packed size.
A task opens the archive at its members' places, so an archive of many members is read by many tasks, and no
archive is held as a whole. Files are opened through pyarrow's file systems (local, HDFS, S3, Azure, GCS); for
stores that only Spark reads, files.expand takes rows (path, content).
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import BROKEN, IGNORED, MOST, READABLE, READERS, read_one

ENTRY = "archive string, entry_path string, group_key string, group_no int, member_no int"
#: Columns by what is read: one row for each entry with its size, the same with its text, or its table rows and a row with its text or error.
SCHEMAS = {
    "entries": f"{ENTRY}, size long, error string",
    "texts": f"{ENTRY}, size long, text string, error string",
    "rows": f"{ENTRY}, page int, row_idx int, cells array<string>, source string, text string, error string",
}
#: Packed bytes and members that a partition has at most, unless one member alone has more.
PARTITION_BYTES, PARTITION_MEMBERS = 32 << 20, 512


@dataclass(frozen=True)
class Member:
    """index: which entry of the archive's directory; None for a file that is no archive, or an archive that can't be read."""

    path: str
    entry_path: str
    group: str
    group_no: int
    member_no: int
    size: int
    packed: int
    index: int | None = None
    archive: bool = False
    error: str | None = None


class Run(InputPartition):
    def __init__(self, members: list[Member]):
        self.members = members


def members_of(path: str, archive: zipfile.ZipFile) -> list[Member]:
    """The members of an archive in the order of its import: groups as they first stand there, members of a group by name. Folders and system entries are left out."""
    groups: dict[str, list] = {}
    for index, entry in enumerate(archive.infolist()):
        parts = [p for p in entry.filename.replace("\\", "/").split("/") if p not in ("", ".")]
        if not entry.is_dir() and parts and not {p.lower() for p in parts} & IGNORED:
            groups.setdefault(parts[0] if len(parts) > 1 else "__root__", []).append((entry.filename, posixpath.join(*parts), index, entry))
    return [
        Member(path, name, group, number, k, entry.file_size, entry.compress_size, index, True)
        for number, (group, some) in enumerate(groups.items())
        for k, (_, name, index, entry) in enumerate(sorted(some, key=lambda m: m[0]))
    ]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], what: str, most: int, partition_bytes: int):
        self.paths, self.what, self.most, self.partition_bytes = paths, what, most, partition_bytes

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            store, inner = store_of(path)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            info = store.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                found = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
            elif info.type == fs.FileType.File:
                found = [info]
            else:
                raise FileNotFoundError(path)
            for f in sorted(found, key=lambda f: f.path):
                yield scheme + f.path, f.size

    def partitions(self) -> list[Run]:
        runs, now, room = [], [], self.partition_bytes

        def put(member: Member) -> None:
            nonlocal now, room
            if now and (member.packed > room or len(now) >= PARTITION_MEMBERS):
                runs.append(Run(now))
                now, room = [], self.partition_bytes
            now.append(member)
            room -= member.packed

        for path, size in self._files():
            if path.lower().endswith(".zip"):
                try:
                    with _archive(path) as z:
                        members = members_of(path, z)
                except BROKEN as e:
                    members = [Member(path, posixpath.basename(path), "__root__", 0, 0, size, 0, None, True, str(e) or type(e).__name__)]
            else:
                members = [Member(path, path, "__root__", 0, 0, size, size)]
            for member in members:
                put(member)
        return [*runs, Run(now)] if now or not runs else runs

    def _content(self, member: Member, archives: dict) -> bytes:
        if member.size > self.most:
            raise ValueError(f"over {self.most} bytes")
        if member.index is None:
            with _open(member.path) as stream:
                return stream.read()
        if member.path not in archives:
            for z in archives.values():
                z.close()
            archives.clear()
            archives[member.path] = _archive(member.path)
        z = archives[member.path]
        return z.read(z.infolist()[member.index])

    def read(self, partition: Run) -> Iterator[tuple]:
        archives: dict[str, zipfile.ZipFile] = {}
        for m in partition.members:
            place = (m.path if m.archive else None, m.entry_path, m.group, m.group_no, m.member_no)
            if self.what == "entries":
                yield *place, m.size, m.error
                continue
            error, found = m.error, []
            if error is None and posixpath.splitext(m.entry_path)[1].lower() in READABLE:
                try:
                    found = read_one(m.entry_path, self._content(m, archives), READERS)
                except (*BROKEN, RuntimeError, ValueError) as e:
                    error = str(e) or type(e).__name__
            elif error is None:
                error = "unsupported"
            if self.what == "texts":
                text = None
                for *_, text, failed in found:  # the last row has the text or the error
                    error = failed or error
                yield *place, m.size, text, error
            elif error is not None:
                yield *place, None, None, None, None, None, error
            else:
                for row in found:
                    yield *place, *row
        for z in archives.values():
            z.close()


def _open(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)


def _archive(path: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(_open(path))
    except pa.ArrowInvalid as e:  # the directory is looked for before the file's beginning
        raise zipfile.BadZipFile("File is not a zip file") from e


class PriceFiles(DataSource):
    """Options: path (or several, by line), what (entries, texts or rows), mostbytes of a member, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "price_files"

    def _what(self) -> str:
        what = self.options.get("what", "rows")
        if what not in SCHEMAS:
            raise ValueError(f"what must be one of {', '.join(SCHEMAS)}")
        return what

    def schema(self) -> str:
        return SCHEMAS[self._what()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].split("\n"), self._what(), int(self.options.get("mostbytes", MOST)), int(self.options.get("partitionbytes", PARTITION_BYTES)))


def read_files(spark: SparkSession, paths: str | list[str], what: str = "rows", **options) -> DataFrame:
    """The entries, texts or rows of files, folders (without their sub-folders) and archives."""
    spark.dataSource.register(PriceFiles)
    path = paths if isinstance(paths, str) else "\n".join(paths)
    return spark.read.format("price_files").options(what=what, **options).load(path)
