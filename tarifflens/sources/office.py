"""Pull parsers of DOCX and XLSX: parts are inflated and parsed piece by piece, and rows come out as they end.

A reader holds the file's own bytes, one piece of a part, and what is open: a row, the paragraphs around it, rows of tables
within the open table, and the workbook's shared strings, which cells refer to by number. Documents with a
document type, the only place where entities can be made, are refused.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.parsers import expat

#: Bytes of a part that are parsed at once; the most characters of shared strings that are kept.
PIECE, MOST_SHARED = 1 << 16, 256 << 20
#: Namespaces of the two formats.
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: The number formats that stand for dates or times without being spelt out.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Text(str):
    """What a reader yields beside its rows: a piece of the document's text."""


class Refused(ValueError):
    pass


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xad", "")).strip()


def parse(stream: BinaryIO, start: Callable, end: Callable, data: Callable, out: list) -> Iterator:
    """Whatever the handlers append to out, while stream is parsed piece by piece. Names are {namespace}local, as are those of attributes."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    name = lambda x: "{" + x if "}" in x else x

    def refuse(*_):
        raise Refused("document types are not allowed")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler = lambda tag, attributes: start(name(tag), {name(k): v for k, v in attributes.items()})
    parser.EndElementHandler = lambda tag: end(name(tag))
    parser.CharacterDataHandler = data
    try:
        while piece := stream.read(PIECE):
            parser.Parse(piece, False)
            yield from out
            out.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    yield from out


def _docx(stream: BinaryIO) -> Iterator[tuple[int, list[str]] | Text]:
    paragraphs, cells, rows, tables, out = [], [], [], [], []  # the open ones; a row is None where it isn't a table's own
    begun: list[list] = []  # paragraphs since the outermost open one began
    waiting: list[list] = []  # rows of tables within the outermost open one
    path: list[str] = []
    silent = 0

    def add(text: str) -> None:
        if not silent:
            for part in paragraphs:
                part.append(text)
            for part in cells:
                part.append(text)

    def start(tag: str, _: dict) -> None:
        nonlocal silent
        if tag in (W_NS + "tab", W_NS + "br", W_NS + "cr"):
            add("\n")
        if tag in (W_NS + "del", W_NS + "tab", W_NS + "br", W_NS + "cr"):
            silent += 1
        elif tag == W_NS + "p":
            paragraphs.append([])
            begun.append(paragraphs[-1])
        elif tag == W_NS + "tbl":
            tables.append([])
            if len(tables) > 1:
                waiting.append(tables[-1])
        elif tag == W_NS + "tr":
            rows.append([] if path and path[-1] == W_NS + "tbl" else None)
        elif tag == W_NS + "tc" and path and path[-1] == W_NS + "tr" and rows[-1] is not None:
            cells.append([])
        path.append(tag)

    def end(tag: str) -> None:
        nonlocal silent
        path.pop()
        if tag in (W_NS + "del", W_NS + "tab", W_NS + "br", W_NS + "cr"):
            silent -= 1
        elif tag == W_NS + "p":
            paragraphs.pop()
            if not paragraphs:
                out.extend(Text(t) for t in (clean("".join(parts)) for parts in begun) if t)
                begun.clear()
        elif tag == W_NS + "tc" and path and path[-1] == W_NS + "tr" and rows[-1] is not None:
            rows[-1].append(clean("".join(cells.pop())))
        elif tag == W_NS + "tr":
            row = rows.pop()
            if row and any(row):
                (out if len(tables) == 1 else tables[-1]).append((0, row))
        elif tag == W_NS + "tbl":
            tables.pop()
            if not tables:
                for some in waiting:
                    out.extend(some)
                waiting.clear()

    yield from parse(stream, start, end, add, out)


def docx_rows(content: bytes) -> Iterator[tuple[int, list[str]] | Text]:
    """Table rows with any text, page 0, a table within another after it; and the text of every paragraph. Deleted text is left out, breaks are spaces."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as stream:
        yield from _docx(stream)


def _elements(stream: BinaryIO, tag: str) -> Iterator[dict]:
    """The attributes of each element of that name."""
    out: list[dict] = []
    yield from parse(stream, lambda t, a: out.append(a) if t == tag else None, lambda t: None, lambda d: None, out)


def _shared(stream: BinaryIO) -> list[str]:
    """The shared strings; how they sound is left out."""
    out, parts, state = [], [], {"t": 0, "sound": 0, "room": MOST_SHARED}

    def start(tag: str, _: dict) -> None:
        state["t"] += tag == S_NS + "t"
        state["sound"] += tag == S_NS + "rPh"

    def end(tag: str) -> None:
        state["t"] -= tag == S_NS + "t"
        state["sound"] -= tag == S_NS + "rPh"
        if tag == S_NS + "si":
            out.append("".join(parts))
            parts.clear()
            state["room"] -= len(out[-1])
            if state["room"] < 0:
                raise Refused(f"over {MOST_SHARED} characters of shared strings")

    def data(text: str) -> None:
        if state["t"] and not state["sound"]:
            parts.append(text)

    return list(parse(stream, start, end, data, out))


def _is_date(code: str) -> bool:
    """Whether a spelt-out number format shows parts of a date or time."""
    return bool(re.search("[dmhysDMHYS]", re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]', "", code.split(";")[0])))


def _date_styles(stream: BinaryIO) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    spelt, found, out = set(DATE_FORMATS), set(), []
    state = {"in": False, "n": 0}

    def start(tag: str, a: dict) -> None:
        if tag == S_NS + "numFmt":
            (spelt.add if _is_date(a.get("formatCode", "")) else spelt.discard)(int(a["numFmtId"]))
        elif tag == S_NS + "cellXfs":
            state["in"] = True
        elif tag == S_NS + "xf" and state["in"]:
            if int(a.get("numFmtId", 0)) in spelt:
                found.add(state["n"])
            state["n"] += 1

    def end(tag: str) -> None:
        if tag == S_NS + "cellXfs":
            state["in"] = False

    list(parse(stream, start, end, lambda d: None, out))
    return found


def as_shown(value: str, kind: str, date: bool, since_1904: bool = False) -> str:
    """A stored value as text: whole numbers without a point, others in their shortest form, truth values and dates spelt out."""
    if kind == "b":
        return str(bool(int(value)))
    if kind not in ("", "n"):
        return value
    number = float(value) if set(value) & set(".eE") else int(value)
    if not date:
        return str(number)
    moment = timedelta(milliseconds=round(number * 86_400_000))
    if 0 <= number < 1:
        return str((datetime(1900, 1, 1) + moment).time())
    return str((datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) + timedelta(days=0 < number < 60)) + moment)


def _sheet(stream: BinaryIO, page: int, shared: list[str], dates: set[int], since_1904: bool) -> Iterator[tuple[int, list[str]]]:
    out, row, parts = [], [], []
    state = {"cell": {}, "v": 0, "t": 0, "width": 0}

    def column(reference: str) -> int:
        letters = re.match("[A-Z]*", reference).group()
        return sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(row)

    def start(tag: str, a: dict) -> None:
        if tag == S_NS + "dimension":
            state["width"] = column(a.get("ref", "").split(":")[-1]) + 1 if ":" in a.get("ref", "") else 0
        elif tag == S_NS + "c":
            state["cell"] = a
            parts.clear()
        state["v"] += tag == S_NS + "v"
        state["t"] += tag == S_NS + "t"

    def end(tag: str) -> None:
        state["v"] -= tag == S_NS + "v"
        state["t"] -= tag == S_NS + "t"
        if tag == S_NS + "c":
            a, value = state["cell"], "".join(parts)
            row.extend([""] * (column(a.get("r", "")) - len(row)))
            kind = a.get("t", "")
            if value and kind == "s":
                value = shared[int(value)]
            elif value and kind != "inlineStr":
                value = as_shown(value, kind, int(a.get("s", 0)) in dates, since_1904)
            row.append(clean(value))
        elif tag == S_NS + "row":
            if any(row):
                out.append((page, row + [""] * (state["width"] - len(row))))
            row.clear()

    def data(text: str) -> None:
        if state["t"] if state["cell"].get("t") == "inlineStr" else state["v"]:
            parts.append(text)

    yield from parse(stream, start, end, data, out)


def xlsx_rows(content: bytes) -> Iterator[tuple[int, list[str]] | Text]:
    """Rows with any text of every sheet, as wide as the sheet says it is, in the workbook's order; stored values as they are shown. The text is the sheets' names."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())

        def part(name: str, read: Callable, none):
            if name not in names:
                return none
            with z.open(name) as stream:
                return read(stream)

        links = part("xl/_rels/workbook.xml.rels", lambda s: {a.get("Id"): a.get("Target", "") for a in _relations(s)}, {})
        with z.open("xl/workbook.xml") as stream:
            sheets = list(_elements(stream, S_NS + "sheet"))
        with z.open("xl/workbook.xml") as stream:
            since_1904 = any(a.get("date1904") in ("1", "true") for a in _elements(stream, S_NS + "workbookPr"))
        yield Text(", ".join(s.get("name", "") for s in sheets))
        shared = part("xl/sharedStrings.xml", _shared, [])
        dates = part("xl/styles.xml", _date_styles, set())
        for n, sheet in enumerate(sheets):
            target = links[sheet.get(R_NS + "id")]
            with z.open(posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"xl/{target}")) as stream:
                yield from _sheet(stream, n, shared, dates, since_1904)


def _relations(stream: BinaryIO) -> Iterator[dict]:
    out: list[dict] = []
    yield from parse(stream, lambda t, a: out.append(a) if t.endswith("Relationship") else None, lambda t: None, lambda d: None, out)
