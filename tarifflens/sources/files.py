"""Readers of archives and office files. Each file is opened in one Python task; all later steps are native."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import Text, docx_rows, xlsx_rows

#: Entries that operating systems leave in archives, and the endings that readers take.
IGNORED = {"__macosx", ".ds_store"}
READABLE = {".pdf", ".docx", ".xlsx", ".xls"}
MEMBERS = "archive string, entry_path string, group_key string, group_no int, member_no int, content binary, error string"
#: The greatest member of an archive that is read, in bytes, and what a broken archive raises.
MOST = 256 << 20
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError)
GRID = "path string, page int, row_idx int, cells array<string>"
#: Characters of a document's text that are kept; rows of a file that are held, and put out at once.
TEXT, HELD, PUT_OUT = 50_000, 20_000, 4_096


def read_directory(spark: SparkSession, path: str | list[str], nested: bool = False) -> DataFrame:
    """Rows (path, content) of the files of a folder other than archives, by path, with or without its sub-folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", nested).load(path)
    return found.where(~F.lower("path").endswith(".zip")).orderBy("path").select("path", "content")


def route(path: Column) -> Column:
    """What takes a file: a reader by its ending, archive for ZIP files, unsupported for the rest."""
    kind = F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))
    return F.when(kind == "zip", "archive").when(kind.isin(*(x[1:] for x in sorted(READABLE))), kind).otherwise("unsupported")


def zip_members(files: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (archive, entry_path, group_key, group_no, member_no, content, error) of rows (path, content).

    Folders and system entries are left out. Groups count in the order in which they first stand in the archive, members
    of a group by name. A member that can't be read, or has over most bytes, has an error and no content; so has
    an archive as a whole, under its own name.
    """

    def entries(path: str, content: bytes) -> Iterator[tuple]:
        groups: dict[str, list] = {}
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for entry in z.infolist():
                parts = [p for p in entry.filename.replace("\\", "/").split("/") if p not in ("", ".")]
                if not entry.is_dir() and parts and not {p.lower() for p in parts} & IGNORED:
                    groups.setdefault(parts[0] if len(parts) > 1 else "__root__", []).append((entry.filename, parts, entry))
            for number, (group, members) in enumerate(groups.items()):
                for k, (_, parts, entry) in enumerate(sorted(members, key=lambda m: m[0])):
                    try:
                        if entry.file_size > most:
                            raise ValueError(f"over {most} bytes")
                        found, error = z.read(entry), None
                    except (*BROKEN, RuntimeError, ValueError) as e:
                        found, error = None, str(e) or type(e).__name__
                    yield path, posixpath.join(*parts), group, number, k, found, error

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in MEMBERS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for row in entries(path, content):
                        yield pd.DataFrame([row], columns=columns)
                except BROKEN as e:
                    yield pd.DataFrame([(path, posixpath.basename(path), "__root__", 0, 0, None, str(e) or type(e).__name__)], columns=columns)

    return files.select("path", "content").mapInPandas(members, MEMBERS)


def expand(files: DataFrame) -> DataFrame:
    """Rows like those of zip_members: the members of archives, and other files as they are, with no archive."""
    is_zip = F.lower("path").endswith(".zip")
    plain = files.where(~is_zip).select(
        F.lit(None).cast("string").alias("archive"), F.col("path").alias("entry_path"), F.lit("__root__").alias("group_key"), F.lit(0).alias("group_no"), F.lit(0).alias("member_no"), "content", F.lit(None).cast("string").alias("error")
    )
    return plain.unionByName(zip_members(files.where(is_zip)))


#: Readers by ending: of a file's bytes, rows (page, cells), and Text, pieces of its text. Without Text, the rows are its text.
#: Rows (page, cells, source), source being table or text, are of a page's two sources, of which one is taken; cells is None where a page has none.
#: PDF, XLS and OCR need libraries that are not here; a caller registers its own.
READERS: dict[str, Callable[[bytes], Iterator[tuple[int, list[str]] | Text]]] = {".docx": docx_rows, ".xlsx": xlsx_rows}


def read_one(path: str, content: bytes, readers: dict) -> Iterator[tuple]:
    """Rows (page, row_idx, cells, source, text, error) of a file: its table rows, and at the end one with its text (cut to TEXT) or its error and nothing else.

    Rows that a reader gives before it fails don't count. So a file of over HELD rows is read once to its end
    before its rows are put out from a second reading; no more are held.
    """
    read = readers.get(posixpath.splitext(path)[1].lower())
    if not read:
        yield None, None, None, None, None, "no reader for this ending"
        return
    rows, count, texts, room, told = [], 0, [], TEXT, False

    def note(piece: str) -> None:
        nonlocal room
        if room > 0:
            texts.append(piece[:room])
            room -= len(piece) + 1

    try:
        for found in read(content):
            if isinstance(found, Text):
                if not told:
                    told, room = True, TEXT
                    texts.clear()
                note(found)
                continue
            count += 1
            if count <= HELD:
                rows.append(found)
            elif rows:
                rows.clear()
            if not told:
                note(" ".join(found[1] or ()))
    except (*BROKEN, KeyError, ValueError, IndexError, RuntimeError) as e:
        yield None, None, None, None, None, str(e) or type(e).__name__
        return
    again = rows if count <= HELD else (x for x in read(content) if not isinstance(x, Text))
    yield from ((page, n, cells, source[0] if source else None, None, None) for n, (page, cells, *source) in enumerate(again))
    yield None, None, None, None, "\n".join(texts)[:TEXT], None


def read_all(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Rows (path, page, row_idx, cells, source, text, error) of rows (path, content), by the reader of each ending.

    A file has one row without cells, which has its text, or an error if it can't be read.
    """
    readers = {**READERS, **(readers or {})}

    def grids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = ((path, *row) for row in read_one(path, content, readers))
                while some := list(islice(rows, PUT_OUT)):
                    yield pd.DataFrame(some, columns=["path", "page", "row_idx", "cells", "source", "text", "error"]).astype({"page": "Int32", "row_idx": "Int32"})

    return files.select("path", "content").mapInPandas(grids, f"{GRID}, source string, text string, error string")


def read_grids(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Rows (path, page, row_idx, cells) of the files that can be read; see failures and unreadable for the others."""
    return read_all(files, readers).where("cells is not null").drop("source", "text", "error")


def failures(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Rows (path, warning) of files whose reader fails."""
    name = F.element_at(F.split("path", "/"), -1)
    found = read_all(files, readers).where("error is not null")
    return found.select("path", F.concat(F.lit("Failed to read "), name, F.lit(": "), F.col("error")).alias("warning"))


def unreadable(files: DataFrame) -> DataFrame:
    """Rows (path, warning) of files that no reader takes."""
    ending = F.lower(F.regexp_extract("path", "(\\.[^./\\\\]+)$", 1))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~ending.isin(*READABLE)).select("path", F.concat(F.lit("Skipped unsupported file: "), name).alias("warning"))
