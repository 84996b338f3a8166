"""Readers of office files and archives: odd content, damage, memory, and how archives are dealt out."""

import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tarifflens.sources import archives, files, office, writers
from tarifflens.sources.office import R_NS, S_NS, W_NS, Text


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def word(body):
    return zipped({"word/document.xml": f'<w:document xmlns:w="{W_NS[1:-1]}"><w:body>{body}</w:body></w:document>'})


def split(found):
    found = list(found)
    return [r[1] for r in found if not isinstance(r, Text)], [str(r) for r in found if isinstance(r, Text)]


def t(x):
    return f"<w:r><w:t>{x}</w:t></w:r>"


def test_docx_rows_and_text():
    inner = f"<w:tbl><w:tr><w:tc><w:p>{t('in 1')}</w:p></w:tc></w:tr></w:tbl>"
    rows, texts = split(office.docx_rows(word(
        f"<w:p>{t('Price')}<w:del>{t('gone')}</w:del><w:r><w:br/></w:r>{t('list ')}<w:r><w:tab/></w:r>{t('2024')}</w:p><w:p/>"
        f"<w:tbl><w:tr><w:tc><w:p>{t('a')}</w:p><w:p>{t('b')}</w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p>{t(' ')}</w:p></w:tc></w:tr>"
        f"<w:tr><w:tc><w:p>{t('x')}</w:p>{inner}</w:tc></w:tr><w:sdt><w:tr><w:tc><w:p>{t('wrapped')}</w:p></w:tc></w:tr></w:sdt><w:tr><w:tc><w:p>{t('last')}</w:p></w:tc></w:tr></w:tbl>"
        f"<w:p>{t('out')}<w:pict><w:p>{t('box')}</w:p></w:pict></w:p>"
    )))
    assert rows == [["ab", ""], ["xin 1"], ["last"], ["in 1"]]
    assert texts == ["Price list 2024", "a", "b", "x", "in 1", "wrapped", "last", "outbox", "box"]


def test_documents_of_prose_have_text():
    assert split(office.docx_rows(writers.docx([], ("one", "two")))) == ([], ["one", "two"])
    found = list(files.read_one("x.DOCX", writers.docx([["a", "b"]], ("title",)), files.READERS))
    assert found == [(0, 0, ["a", "b"], None, None, None), (None, None, None, None, "title\na\nb", None)]


def book(sheets, shared="", styles="", workbook=""):
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{S_NS[1:-1]}" xmlns:r="{R_NS[1:-1]}">{workbook}<sheets>' + "".join(f'<sheet name="S{n}" r:id="r{n}"/>' for n in range(len(sheets))) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="/xl/s{n}.xml"/>' for n in range(len(sheets))) + "</Relationships>",
        **{f"xl/s{n}.xml": f'<worksheet xmlns="{S_NS[1:-1]}">{s}</worksheet>' for n, s in enumerate(sheets)},
        **({"xl/sharedStrings.xml": f'<sst xmlns="{S_NS[1:-1]}">{shared}</sst>'} if shared else {}), **({"xl/styles.xml": f'<styleSheet xmlns="{S_NS[1:-1]}">{styles}</styleSheet>'} if styles else {}),
    })


def test_xlsx_values():
    styles = '<numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/><numFmt numFmtId="165" formatCode="#,##0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs>'
    first = '<dimension ref="A1:E3"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1500</v></c><c r="D1"><v>12.50</v></c></row><row r="2"><c r="A2"/></row>'
    first += '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="1"><v>45413</v></c><c r="C3" s="2"><v>7</v></c><c r="D3" s="3"><v>0.5</v></c><c r="E3" t="e"><v>#N/A</v></c></row></sheetData>'
    second = '<sheetData><row><c t="inlineStr"><is><t>in </t><t>line</t></is></c><c t="str"><f>A1</f><v> x  y </v></c><c><v>1E3</v></c></row></sheetData>'
    shared = "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>sound</t></rPh></si>"
    rows, texts = split(office.xlsx_rows(book([first, second], shared, styles)))
    assert rows == [["rich", "", "1500", "12.5", ""], ["True", "2024-05-01 00:00:00", "7", "12:00:00", "#N/A"], ["in line", "x y", "1000.0"]]
    assert texts == ["S0, S1"]
    assert split(office.xlsx_rows(book(["<sheetData/>"]))) == ([], ["S0"])
    shifted = book(['<sheetData><row><c s="1"><v>0</v></c><c s="1"><v>2</v></c></row></sheetData>'], styles=styles, workbook='<workbookPr date1904="1"/>')
    assert split(office.xlsx_rows(shifted))[0] == [["00:00:00", "1904-01-03 00:00:00"]]


def test_damage_is_an_error_and_no_rows():
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa">]>' + "<w:document/>"
    good = writers.docx([["a"]])
    for content, part in ((zipped({"word/document.xml": bomb}), "document types"), (zipped({"x": ""}), "word/document.xml"), (b"no archive", "zip"), (word("<w:tbl><w:tr>"), "mismatched"), (good[: len(good) // 2], "zip")):
        (found,) = files.read_one("a.docx", content, files.READERS)
        assert found[:5] == (None,) * 5 and part in found[5]
    (found,) = files.read_one("a.xlsx", book(['<sheetData><row><c t="s"><v>7</v></c></row></sheetData>']), files.READERS)
    assert found[5] == "list index out of range"


def test_large_sheets_are_not_held(monkeypatch):
    monkeypatch.setattr(files, "HELD", 1_000)
    row = "".join(f'<c t="inlineStr"><is><t>{"word " * 8}{k}</t></is></c>' for k in range(6))
    content = book(["<sheetData>" + f"<row>{row}</row>" * 12_000 + "</sheetData>"])
    tracemalloc.start()
    n = sum(1 for _ in files.read_one("big.xlsx", content, files.READERS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 12_001
    assert peak < 3e6, peak  # all cells as Python objects take over 8 MB


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("in")
    price = lambda n: writers.docx([["Код", "Наименование услуги", "Цена"], [f"A{n}", f"blood count {n}", "1000"]], (f"list {n}",))
    (out / "many.zip").write_bytes(zipped({**{f"g{n % 3}\\d{n}.docx": price(n) for n in range(1_500)}, "__MACOSX/x": b"", "g1/": b"", "z/note.txt": b"x", "z/broken.docx": b"x"}))
    (out / "one.docx").write_bytes(price(9000))
    (out / "bad.zip").write_bytes(b"PK broken")
    return str(out)


def test_archives_are_dealt_out(spark, folder):
    entries = archives.read_files(spark, folder, "entries")
    whole = files.expand(spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:", "").alias("path"), "content"))
    place = ["archive", "entry_path", "group_key", "group_no", "member_no"]
    assert sorted(map(tuple, entries.select(*place).collect()), key=repr) == sorted(map(tuple, whole.select(*place).collect()), key=repr)
    rows = archives.read_files(spark, folder, "rows", partitionbytes=50_000)
    assert rows.rdd.getNumPartitions() > 5
    read = rows.where("cells IS NOT NULL").groupBy("entry_path").agg(F.max(F.get("cells", F.lit(1))).alias("name")).collect()
    assert len(read) == 1_501 and {r["name"] for r in read} == {f"blood count {n}" for n in (*range(1_500), 9000)}
    errors = {r["entry_path"]: r["error"] for r in rows.where("error IS NOT NULL").collect()}
    assert set(errors) == {"z/note.txt", "z/broken.docx", "bad.zip"} and errors["z/note.txt"] == "unsupported"
    texts = archives.read_files(spark, f"{folder}/one.docx", "texts").collect()
    assert [(r["text"].split("\n")[0], r["archive"]) for r in texts] == [("list 9000", None)]
    assert archives.read_files(spark, f"{folder}/many.zip", "texts", mostbytes=10).where("error like 'over 10 bytes'").count() > 1_000
    with pytest.raises(Exception, match="what must be one of"):
        archives.read_files(spark, folder, "cells").count()
