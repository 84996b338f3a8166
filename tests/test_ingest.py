"""From files to documents, items and warnings; sources that fail; scores against plain versions."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tarifflens.functions import text as T
from tarifflens.operators import history, ingest, recognition
from tarifflens.operators import pages as G
from tarifflens.sources import files, writers

HEAD = ["Код", "Наименование услуги", "Цена"]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture(scope="module")
def found(spark):
    price = lambda *rows: writers.xlsx([HEAD, *([f"A{n}", name, value] for n, (name, value) in enumerate(rows))])
    archive = zipped([
        ("north/Клиника 7 2024-05-01.xlsx", price(("blood count", "2000"), ("liver panel test", "40 usd"))), ("north/Клиника 7 2023-05-01.xlsx", price(("blood count", "1000"))),
        ("__MACOSX/x", b""), ("Клиника 8 прайс.docx", writers.docx([["only words in here"]])), ("south/broken.xlsx", b"no archive"), ("south/note.txt", b"text"), ("south/2999-01-01.xlsx", price(("blood cuont", "500"))), ("south/prose.docx", writers.docx([], ("Price list", "on request"))), ("south/empty.xlsx", writers.xlsx([])),
    ])
    rows = [("in/list.zip", archive), ("in/bad.zip", b"PK broken"), ("in/2022-01-01/east.xlsx", price(("urine test", "700"))), ("in/scan.pdf", b"%PDF")]
    services = spark.createDataFrame([(1, "blood count", ["cbc"], True), (2, "Liver panel", ["Liver panel test"], True), (3, "Urine test", [], False)], "service_id long, service_name string, synonyms array<string>, is_active boolean")
    partners = spark.createDataFrame([(77, " клиника 7 ")], "partner_id long, name string")
    rates = spark.createDataFrame([("USD", 500.0)], "currency string, rate double")
    return ingest.ingest(spark.createDataFrame(rows, "path string, content binary"), services, partners, rates=rates, today=datetime.date(2026, 1, 1))


def test_ingest_items(found):
    items = {(r["service_name_raw"], str(r["effective_date"])): r for r in found.items.collect()}
    old, new = items["blood count", "2023-05-01"], items["blood count", "2024-05-01"]
    assert (old["service_id"], old["partner_id"], old["is_active"], new["is_active"]) == (1, 77, False, True)
    assert new["verification_note"] == "exact matched; anomaly: price changed by 100% from previous version" and old["verification_note"] == "exact matched"
    usd = items["liver panel test", "2024-05-01"]
    assert (usd["service_id"], usd["price_resident"], usd["price_original"], usd["currency"]) == (2, 20000.0, 40.0, "USD")
    assert usd["verification_note"] == "synonym matched; currency converted from USD via api rate"
    assert items["urine test", "2022-01-01"]["verification_note"] == "service match required"
    late = items["blood cuont", "2999-01-01"]
    assert late["service_id"] is None and late["verification_note"].startswith("service review suggested (90.9") and late["verification_note"].endswith("%); price date is in the future")
    assert items["only words in here", "None"]["verification_note"] == "service match required; price missing or invalid"
    assert {n: items[n, "None"]["verification_note"] for n in ("prose", "empty")} == {"prose": "needs manual review", "empty": "needs manual review"}


def test_ingest_documents(found):
    docs = {r["source_path"]: r for r in found.documents.collect()}
    assert {p: r["parse_status"] for p, r in docs.items()} == {
        "north/Клиника 7 2023-05-01.xlsx": "processed", "north/Клиника 7 2024-05-01.xlsx": "needs_review", "Клиника 8 прайс.docx": "needs_review", "south/broken.xlsx": "error", "south/2999-01-01.xlsx": "needs_review",
        "south/prose.docx": "needs_review", "south/empty.xlsx": "needs_review",
        "in/2022-01-01/east.xlsx": "needs_review", "in/scan.pdf": "error",
    }
    assert [docs[f"north/Клиника 7 {x}.xlsx"]["doc_seq"] for x in ("2023-05-01", "2024-05-01")] == [1, 2] and docs["north/Клиника 7 2023-05-01.xlsx"]["raw_content"] == "A"
    assert (docs["south/prose.docx"]["raw_content"], docs["south/empty.xlsx"]["raw_content"], docs["south/broken.xlsx"]["raw_content"]) == ("Price list\non request", "A", None)
    assert docs["south/broken.xlsx"]["parse_log"].endswith("Failed to read broken.xlsx: File is not a zip file") and docs["north/Клиника 7 2023-05-01.xlsx"]["parse_log"] in (None, "")
    warnings = sorted(r["warning"] for r in found.warnings.collect())
    assert warnings == [
        "Failed to read bad.zip: File is not a zip file", "Failed to read broken.xlsx: File is not a zip file", "Failed to read scan.pdf: no reader for this ending",
        "Price date is in the future: 2999-01-01.xlsx -> 2999-01-01", "Skipped unsupported file: note.txt",
    ]
    assert {r["name"] for r in found.partners.collect()} >= {"Клиника 8", "south", "east"}
    assert [(r["archive"], r["n_documents"], r["status"]) for r in found.archives().collect()] == [("in/list.zip", 7, "error")] and found.stats().first()["documents"] == 9


def test_members_of_archives(spark):
    rows = [("a.zip", zipped([("g/z.txt", b"1"), ("x.txt", b"2"), ("g/b.txt", b"3"), ("g/", b""), (".DS_Store", b"")])), ("b.zip", b"broken")]
    found = files.zip_members(spark.createDataFrame(rows, "path string, content binary"))
    got = sorted((r["archive"], r["group_no"], r["member_no"], r["entry_path"], bytes(r["content"] or b""), r["error"]) for r in found.collect())
    assert got == [("a.zip", 0, 0, "g/b.txt", b"3", None), ("a.zip", 0, 1, "g/z.txt", b"1", None), ("a.zip", 1, 0, "x.txt", b"2", None), ("b.zip", 0, 0, "b.zip", b"", "File is not a zip file")]
    assert files.zip_members(spark.createDataFrame(rows[:1], "path string, content binary"), 0).where("error like 'over%'").count() == 3


def test_directory_leaves_archives_and_folders(spark, tmp_path):
    for name in ("b.xlsx", "a.docx", "c.ZIP"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.xlsx").write_bytes(b"x")
    assert [r["path"].rpartition("/")[2] for r in files.read_directory(spark, str(tmp_path)).collect()] == ["a.docx", "b.xlsx"]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence(spark):
    draw = random.Random(3)
    pairs = [("".join(draw.choices("abcde я", k=draw.randint(0, 70))), "".join(draw.choices("abcde я", k=draw.choice([0, 1, 5, 61, 62, 63, 70])))) for _ in range(60)]
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string").select("n", T.common_subsequence(F.col("a"), F.col("b")).alias("l")).collect()
    assert {r["n"]: r["l"] for r in rows} == {n: common(*p) for n, p in enumerate(pairs)}


def test_fuzzy_matches_as_all_pairs_do(spark):
    draw = random.Random(5)
    words = ["blood", "count", "liver", "panel", "general", "therapy", "x-ray", "of", "the", "chest", "knee", "joint"]
    names = sorted({" ".join(draw.choices(words, k=draw.randint(1, 5))) for _ in range(60)})

    def spoilt(s):
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(s) + 1)
            s = s[:at] + draw.choice(["", "q", "zz"]) + s[at + draw.randint(0, 1) :]
        return s

    raw = sorted({spoilt(draw.choice(names)) for _ in range(80)})
    services = spark.createDataFrame([(n, s, [], True) for n, s in enumerate(names)], "service_id long, service_name string, synonyms array<string>, is_active boolean")
    found = {r["raw_name"]: (r["service_id"], r["score"], r["status"]) for r in history.match_names(spark.createDataFrame([(r,) for r in raw], "raw_name string"), services).collect()}
    clean = lambda s: " ".join(s.split()).lower()
    for r in raw:
        exact = [n for n, s in enumerate(names) if clean(s) == clean(r)]
        if found[r][2] in ("exact", "none") and exact:
            assert found[r][2] == "none" or found[r][0] == min(exact)
            continue
        a = " ".join(sorted(r.split()))
        scores = [(200.0 * common(a, b) / (len(a) + len(b)), -n) for n, b in enumerate(" ".join(sorted(s.split())) for s in names) if a or b]
        best, n = max(scores)
        uncertain = found[r][2] == "none"
        assert uncertain and (best < 85 or len(clean(r)) < 4) or found[r] == (-n if best >= 92 else None, best, "fuzzy_auto" if best >= 92 else "fuzzy_review")


def test_pages(spark):
    rows = spark.createDataFrame([(1, 1, 0, ["a", "5"]), (1, 2, 0, ["b"])], "doc_id long, page int, row_idx int, cells array<string>")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page int")
    found = sorted((r["page"], r["cells"], r["source"]) for r in G.cascade(pages, rows.where("page = 1"), rows).where("source is not null").collect())
    assert found == [(1, ["a", "5"], 0), (2, ["b"], 1)] and G.cascade(pages, rows).where("source is null").first()["cells"] == ["[page 3]"]
    assert [r["batch"] for r in G.batch_pages(pages, -1).orderBy("page").collect()] == [0, 0, 0]
    assert G.by_key(rows, "doc_id", 1).count() == 1 and G.by_key(rows, "doc_id", 2).count() == 0


def test_pages_are_recognised_in_batches(spark):
    def pdf(content):
        """A provider's words: page 1 has a good table, page 2 a poor text, page 3 nothing."""
        for n in range(20):
            yield 1, [f"A{n}", f"blood count {n}", f"{1000 + n}"], "table"
        yield 1, ["words of the text layer"], "text"
        yield 2, ["urine test"], "text"
        yield 3, None, "text"

    services = spark.createDataFrame([(1, "blood count 3", None, True), (2, "knee scan", [], True)], "service_id long, service_name string, synonyms array<string>, is_active boolean")
    partners = spark.createDataFrame([], "partner_id long, name string")
    files_ = spark.createDataFrame([("in/list.pdf", b"%PDF")], "path string, content binary")
    today = datetime.date(2026, 1, 1)

    def run(answers):
        frame = spark.createDataFrame(answers, recognition.ANSWERS)
        return ingest.ingest(files_, services, partners, today=today, readers={".pdf": pdf}, answers=frame)

    def result(found):
        items = sorted((r["service_name_raw"], r["service_id"], r["price_resident"]) for r in found.items.collect())
        (doc,) = found.documents.collect()
        return items, doc["raw_content"], doc["parse_status"]

    first = run([])
    queue = sorted((r["page"], r["batch"], r["attempt"]) for r in first.queue.collect())
    assert queue == [(2, 0, 1), (3, 0, 1)]
    doc = first.queue.first()["doc_id"]
    batches = recognition.work(first.queue, files_.select(F.lit(doc).alias("doc_id"), "content")).collect()
    assert [(r["pages"], r["attempts"], bytes(r["content"])) for r in batches] == [([2, 3], [1, 1], b"%PDF")]
    before, failed = result(first), [(doc, 3, n, None, f"busy {n}") for n in (1, 2)]
    assert len(before[0]) >= 20 and "knee" not in before[1]

    good = [(doc, 2, 1, "knee scan\n 500", None), (doc, 3, 3, "Foot scan 700", None)]
    late, once = run([*failed, *good]), run([good[0], (doc, 3, 1, "Foot scan 700", None)])
    assert result(late) == result(once) and late.queue.count() == 0 and late.warnings.count() == 0
    assert result(late)[1].endswith("knee scan 500\nFoot scan 700") and result(late)[1].startswith("A0 blood count 0 1000")

    rows = spark.createDataFrame([(doc, p, n, cells, source) for n, (p, cells, source) in enumerate(pdf(b""))], "doc_id long, page int, row_idx int, cells array<string>, source string")
    told = lambda *answers: recognition.resolve(rows, spark.createDataFrame(list(answers), recognition.ANSWERS))
    waiting = told(*failed, good[0])
    assert [(r["page"], r["attempt"]) for r in waiting.queue.collect()] == [(3, 3)]
    assert [r["warning"] for r in waiting.warnings.collect()] == ["OCR failed for PDF page 3: busy 2"]
    given_up = told(*((doc, 3, n, None, "busy") for n in range(1, 6)), good[0])
    assert given_up.queue.count() == 0 and given_up.warnings.count() == 1


def test_ingest_of_folders_and_paths(spark, tmp_path):
    services = spark.createDataFrame([(1, "blood count", ["cbc"], True)], "service_id long, service_name string, synonyms array<string>, is_active boolean")
    partners = spark.createDataFrame([], "partner_id long, name string")
    price = writers.docx([HEAD, ["A1", "blood count", "1000"]], ("list",))
    (tmp_path / "one 2024-02-03.docx").write_bytes(price)
    (tmp_path / "two.txt").write_bytes(b"x")
    (tmp_path / "all.zip").write_bytes(zipped([("south/three.docx", price), ("broken.docx", b"x")]))
    folder = ingest.ingest_directory(spark, str(tmp_path), services, partners)
    assert [(r["file_name"], str(r["effective_date"])) for r in folder.documents.collect()] == [("one 2024-02-03.docx", "2024-02-03")]
    assert [r["warning"] for r in folder.warnings.collect()] == ["Skipped unsupported file: two.txt"]
    paths = ingest.ingest_paths(spark, str(tmp_path), services, partners)
    found = sorted((r["file_name"], r["parse_status"]) for r in paths.documents.collect())
    assert found == [("broken.docx", "error"), ("one 2024-02-03.docx", "processed"), ("three.docx", "processed")]
    assert sorted((r["service_id"], r["price_resident"]) for r in paths.items.collect()) == [(1, 1000.0)] * 2
    assert sorted(r["warning"].split(":")[0] for r in paths.warnings.collect()) == ["Failed to read broken.docx", "Skipped unsupported file"]
