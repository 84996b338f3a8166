"""Small office files and archives, to test the readers with."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archives import store_of
from .office import R_NS, S_NS, W_NS


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


#: Columns of files.
FILE = "path string, content binary"


def _file(path: str, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])


def docx(rows: list[list[str]], paragraphs: tuple[str, ...] = ()) -> bytes:
    """Paragraphs, and one table if there are rows."""
    cell = lambda c: f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    if rows:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"
    return _zip({"word/document.xml": f'<w:document xmlns:w="{W_NS[1:-1]}"><w:body>{body}</w:body></w:document>'})


def xlsx(rows: list[list[str]]) -> bytes:
    """One sheet with shared strings."""
    shared = sorted({c for r in rows for c in r})
    number = {c: n for n, c in enumerate(shared)}
    cell = lambda c, i, n: f'<c r="{chr(65 + i)}{n + 1}" t="s"><v>{number[c]}</v></c>' if c else f'<c r="{chr(65 + i)}{n + 1}"/>'
    body = "".join(f'<row r="{n + 1}">' + "".join(cell(c, i, n) for i, c in enumerate(r)) + "</row>" for n, r in enumerate(rows))
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{S_NS[1:-1]}" xmlns:r="{R_NS[1:-1]}"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S_NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S_NS[1:-1]}">' + "".join(f"<si><t>{escape(c)}</t></si>" for c in shared) + "</sst>",
    })


def office_files(grid: DataFrame, kind: str) -> DataFrame:
    """Rows (path, content), a file for each document of rows (doc_id, row_idx, cells)."""
    write = {"docx": docx, "xlsx": xlsx}[kind]

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, rows in zip(batch.column("doc_id"), batch.column("rows"), strict=True):
                yield _file(f"d{doc_id.as_py()}.{kind}", write(rows.as_py()))  # one document's rows as Python objects at a time

    rows = grid.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("rows"))
    return rows.mapInArrow(files, FILE)


def archives(files: DataFrame) -> DataFrame:
    """Rows (path, content), an archive for each of rows (path, content), the file in a folder beside entries to leave out."""

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                p = path.as_py()
                g = f"g{int(''.join(filter(str.isdigit, p))) % 3}"
                yield _file(f"{p}.zip", _zip({f"{g}\\{p}": content.as_py(), "__MACOSX/x": b"", f"{g}/.DS_Store": b"", f"{g}/": b""}))

    return files.select("path", "content").mapInArrow(zipped, FILE)


def save(files: DataFrame, folder: str) -> int:
    """Writes rows (path, content) as files of that name into a folder that the executors share; their number."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = store_of(folder)
        store.create_dir(inner)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with store.open_output_stream(f"{inner}/{path}") as out:
                    out.write(content)
            yield batch[["path"]]

    return files.mapInPandas(written, "path string").count()
