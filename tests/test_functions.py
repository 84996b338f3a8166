"""Goldens of scalar functions and row parsing."""

import pytest
from pyspark.sql import functions as F

from tarifflens.functions import price as P
from tarifflens.functions import text as T
from tarifflens.operators import layout, rows


def run(spark, function, values):
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r[0] for r in frame.select("n", function(F.col("v")).alias("r")).orderBy("n").select("r").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (P.parse_price, {"16 600": 16600.0, "12,500": 12.5, "4900": 4900.0, "1,200": None, "3 500...": 3500.0, "-500": 500.0, "4800 —": 4800.0, "2 000 - 3 000": 2000.0, "16 600 тенге": 16600.0, "U1.2": None, "5": None, "U14.2": 14.2, "10000000000": None, "": None, None: None}),
        (T.is_section, {"Раздел 3.Дерматовенерология": True, "Блокада внутриносовая": True, "01.1 Консультативный прием": True, "1. Прием": True, "16 600": True, "U1.2 Прием": False, "16600": False, "": False, None: False}),
        (T.is_code_like, {"U1.2": True, "OT7.23": True, "КК5.2": False, "ABC": False, "12-ти": False, "": False, None: False}),
        (T.normalize_code, {"КК5.2": "KK5.2", "А 1?": "A1U"}),
        (P.detect_currency, {"$20": "USD", "100 евро": "EUR", "100 руб": "RUB", "Прием терапевта": "KZT", "Прием врача невролога": "EUR", "Перевязка труб": "RUB", None: "KZT"}),
        (lambda c: P.extract_date(c).cast("string"), {"Прайс 2024-01-15": "2024-01-15", "15.01.2024": "2024-01-15", "Клиника 1 2026": "2026-01-01", "2024-13-45": "2024-01-01", "abc": None}),
        (T.partner_name, {"Клиника 1 2026": "Клиника 1", "Прайс_Medline_2025": "Medline", "Alpha": "Alpha"}),
        (lambda c: T.truncate(c, 5), {"abcdef": "abcd?", "abcde": "abcde", "  ": None}),
        (T.clean, {" a  b­ ": "a b", None: ""}),
        (T.is_price_like, {"16 600": True, "1 200,50 тенге": True, "12a": False, "": False}),
        (P.format_money, {}),
    ],
)
def test_goldens(spark, function, cases):
    if cases:
        assert run(spark, function, list(cases)) == list(cases.values())


def test_similarity(spark):
    frame = spark.createDataFrame([("прием врача кардиолог", "прием врача кардиолога"), ("b a", "a b"), ("", ""), ("abc", "")], "a string, b string")
    found = [r[0] for r in frame.select(T.token_sort_ratio(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 2) for x in found] == [97.67, 100.0, 100.0, 0.0]


def test_change_note(spark):
    frame = spark.createDataFrame([(1000.0, 1600.0), (1000.0, 1500.0), (0.0, 5.0), (None, 5.0)], "p double, c double")
    assert [r[0] for r in frame.select(P.change_note(F.col("p"), F.col("c"))).collect()] == ["anomaly: price changed by 60% from previous version", None, None, None]


def test_price_reasons(spark):
    frame = spark.createDataFrame([(None, None, None), (100.0, 90.0, 100.0), (0.0, None, 0.0), (100.0, 120.0, 100.0)], "r double, n double, o double")
    assert [r[0] for r in frame.select(P.price_reasons(F.col("r"), F.col("n"), F.col("o"))).collect()] == [[P.MISSING], [P.LOWER], [P.NOT_POSITIVE], []]


def test_parse_rows(spark):
    grid = [
        ["U1.2", "Консультативный прием врача к.м.н.", "16 600"], ["01.1", "Консультативный прием врача д.м.н.", "16 600"], ["OT7.6", "Блокада внутриносовая", "3 500"],
        ["AL4.6", "Проведение специфической иммунотерапии", "год:-один аллерген", "149 700"], ["KRS.10", "Суточное мониторирование (12 ти канальный)", "16 800"], ["A1.1", "УЗИ сердца", "5 000", "6 000"],
    ]
    frame = spark.createDataFrame([("x", n, c) for n, c in enumerate(grid)], "doc_id string, row_idx int, cells array<string>")
    found = {r["row_idx"]: r for r in rows.parse_rows(frame, ["doc_id"]).collect()}
    assert sorted(found) == [0, 3, 4, 5]
    assert (found[0]["service_name_raw"], found[0]["service_code_source"], found[0]["price_resident"], found[0]["price_nonresident"]) == ("Консультативный прием врача к.м.н", "U1.2", 16600.0, None)
    assert (found[3]["service_name_raw"], found[3]["price_resident"]) == ("Проведение специфической иммунотерапии", 149700.0)
    assert (found[4]["price_resident"], found[4]["price_nonresident"], found[5]["price_resident"]) == (10.0, 12.0, 6000.0)


def test_header_hides_rows_above(spark):
    grid = [["A1.1", "УЗИ", "5 000"], ["Код", "Наименование услуги", "Цена"], ["A1.2", "УЗИ сердца", "6 000"]]
    frame = spark.createDataFrame([("x", n, c) for n, c in enumerate(grid)], "doc_id string, row_idx int, cells array<string>")
    assert [(r["row_idx"], r["price_resident"]) for r in rows.parse_rows(frame, ["doc_id"]).collect()] == [(2, 6000.0)]
    assert frame.select(rows.header_score(F.col("cells"))).collect()[1][0] == 7


def test_bands_follow_the_running_mean(spark):
    words = [(1, 0, "a", 0.0, 0.0), (1, 0, "b", 5.0, 3.0), (1, 0, "c", 9.0, 5.0), (1, 0, "d", 12.0, 7.5), (1, 0, " ", 1.0, 1.0)]
    frame = spark.createDataFrame([(*w, w[3] + 2) for w in words], "doc_id int, page int, text string, x0 double, y0 double, x1 double")
    assert {r["text"]: r["band"] for r in layout.band_rows(frame).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}


def test_continuations_merge(spark):
    data = [(n, c) for n, c in enumerate([["U1", "one"], ["U2", "two", "500"], ["U3", "three"], ["more of it"], ["U4", "four", "700"]])]
    frame = spark.createDataFrame([(1, 0, n, c) for n, c in data], "doc_id int, page int, band int, cells array<string>")
    found = [r["cells"] for r in layout.merge_continuations(frame).orderBy("row_idx").collect()]
    assert found == [["U1", "one"], ["U2", "two", "500"], ["U3", "three more of it"], ["U4", "four", "700"]]
