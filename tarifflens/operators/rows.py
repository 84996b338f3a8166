"""Rows of cells to codes, names and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.price import parse_price
from ..functions.text import EDGE, clean, contains_any, is_code_like, is_price_like, is_section, let, normalize_code, strip_noise

#: Words of header cells.
HEADER_HINTS = ("name", "наим", "услуг", "service", "price", "cost", "цена", "стоим", "code", "код", "tariff")
MORE_HINTS = ("наимен", "услуг", "ед.", "ед ", "измер", "кол-", "ндс")
NAME_HINTS = ("наимен", "услуг", "service", "name", "опис")
PRICE_HINTS = ("price", "cost", "цена", "стоим", "тариф", "ндс", "sum")
HEADER_ROWS = 50


def full_cells(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean), lambda c: c != "")


def header_score(cells: Column) -> Column:
    def worth(c: Column) -> Column:
        low = F.lower(clean(c))
        return F.when(contains_any(low, HEADER_HINTS), 2).otherwise(0) + F.when(contains_any(low, MORE_HINTS), 1).otherwise(0)

    return F.aggregate(cells, F.lit(0), lambda a, c: a + worth(c))


def pick_headers(grid: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, header_idx, header): the best-scoring of the first rows, the earliest of equals, if it scores two at least."""
    scored = grid.where(F.col("row_idx") < HEADER_ROWS).withColumn("score", header_score(F.col("cells"))).where("score >= 2")
    best = scored.groupBy(*by).agg(F.max_by(F.struct("row_idx", "cells"), F.struct("score", -F.col("row_idx"))).alias("b"))
    return best.select(*by, F.col("b.row_idx").alias("header_idx"), F.col("b.cells").alias("header"))


def hint_places(header: Column, hints) -> Column:
    """Positions of the header cells with one of the hints."""
    at = F.transform(header, lambda c, i: F.when(contains_any(F.lower(clean(c)), hints), i))
    return F.array_compact(at)


def extract_code(cells: Column) -> Column:
    """The first token that is a code; a dotted number counts, with a U in front, if the row has letters."""
    letters = F.exists(cells, lambda c: clean(c).rlike("\\p{L}"))
    tokens = F.flatten(F.transform(cells, lambda c: F.when(is_section(c) | (clean(c) == ""), F.array().cast("array<string>")).otherwise(F.split(F.btrim(clean(c), F.lit(EDGE)), "\\s+"))))

    def code(t: Column) -> Column:
        n = normalize_code(t)
        return F.when(letters & n.rlike("^\\d+(\\.\\d+)+$"), F.concat(F.lit("U"), n)).when(~is_price_like(n) & is_code_like(n), n)

    return F.get(F.array_compact(F.transform(tokens, code)), F.lit(0))


def price_values(cells: Column, header: Column) -> Column:
    """Prices in the header's price columns; if they hold none, in the columns after the name, or after the third or fourth."""
    header = F.coalesce(header, F.array().cast("array<string>"))
    in_columns = F.array_compact(F.transform(hint_places(header, PRICE_HINTS), lambda i: parse_price(F.get(cells, i))))
    names = hint_places(header, NAME_HINTS)
    wide = F.size(cells) >= 4
    start = F.when(F.size(header) == 0, F.when(wide, 3).otherwise(0)).when(F.size(names) > 0, F.array_max(names) + 1).when(wide, 4).otherwise(0)
    behind = F.array_compact(F.transform(cells, lambda c, i: F.when(i >= start, parse_price(c))))
    return F.when(F.size(in_columns) > 0, in_columns).otherwise(behind)


def extract_name(cells: Column, code: Column) -> Column:
    """The longest of the first six cells that can be a name, the first of equals; else what is left of the row."""

    def candidate(c: Column) -> Column:
        t = strip_noise(c)
        letters = F.length(F.regexp_replace(t, "[^\\p{L}\\p{N}]", ""))
        fits = ~is_price_like(c) & ~clean(c).rlike("^\\d+(\\.\\d+)?$") & ~F.coalesce(normalize_code(clean(c)) == code, F.lit(False)) & (t != "") & ~is_section(t) & (letters >= 3)
        return F.when(fits, t)

    options = F.array_compact(F.transform(F.slice(cells, 1, 6), candidate))
    longest = F.aggregate(options, F.lit("").cast("string"), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))

    def piece(c: Column) -> Column:
        t = strip_noise(c)
        tail = clean(F.regexp_replace(t, "^\\S+\\s*", ""))
        first = normalize_code(F.regexp_extract(t, "^\\S+", 0))
        cut = F.when(F.coalesce(t.startswith(code), F.lit(False)), clean(F.substring(t, F.length(code) + 1, F.length(t))))
        cut = cut.when(F.coalesce(first == code, F.lit(False)) | is_code_like(first), tail).otherwise(t)
        return F.when(F.coalesce(normalize_code(clean(c)) == code, F.lit(False)) | is_price_like(c) | (cut == "") | is_price_like(cut), F.lit(None)).otherwise(cut)

    rest = clean(F.array_join(F.array_compact(F.transform(cells, piece)), " "))
    rest = F.when((F.length(rest) >= 3) & ~rest.rlike("^[\\d\\s.,-]+$") & ~F.coalesce(rest == code, F.lit(False)), rest)
    return F.when(longest != "", longest).otherwise(rest)


def parsed(cells: Column, header: Column) -> Column:
    """Array of one struct (code, prices, name, raw), or of none where the row is empty, a section or without a name and prices. Each part is computed once."""

    def fields(x: Column) -> Column:
        return F.struct(x["code"], price_values(x["c"], x["header"]).alias("prices"), extract_name(x["c"], x["code"]).alias("name"), F.array_join(x["c"], " ").alias("raw"))

    def of_cells(c: Column) -> Column:
        row = let(F.struct(c.alias("c"), extract_code(c).alias("code"), header.alias("header")), fields)
        return F.when((F.size(c) > 0) & ~is_section(F.array_join(c, " ")), row)

    def kept(r: Column) -> Column:
        digit = F.coalesce(r["name"].rlike("^\\d"), F.lit(False))
        return r.isNotNull() & ~((F.size(r["prices"]) == 0) & (r["name"].isNull() | digit))

    return F.filter(F.array(let(full_cells(cells), of_cells)), kept)


def parse_rows(grid: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, row_idx, service_name_raw, service_code_source, price_resident, price_nonresident, raw_row) of rows (*by, row_idx, cells).

    Rows up to a header, section rows and rows without a name, or with one that is only a number, and
    without prices are left out. Empty cells are dropped before columns are counted.
    """
    rows = grid.join(pick_headers(grid, by), by, "left").where(F.col("header_idx").isNull() | (F.col("row_idx") > F.col("header_idx")))
    rows = rows.select(*by, "row_idx", F.explode(parsed(F.col("cells"), F.col("header"))).alias("r")).select(*by, "row_idx", "r.*")
    name = F.nullif(F.when(F.col("name").rlike("^\\d"), strip_noise(F.col("name"))).otherwise(F.col("name")), F.lit(""))
    return rows.select(
        *by, "row_idx", F.coalesce(name, "code", "raw").alias("service_name_raw"), F.col("code").alias("service_code_source"),
        F.get("prices", F.lit(0)).alias("price_resident"), F.get("prices", F.lit(1)).alias("price_nonresident"), F.col("raw").alias("raw_row"),
    )


def rowset_score(cells: Column) -> Column:
    """How much a row looks like one of a price table."""

    def of(c: Column) -> Column:
        joined, n = F.array_join(c, " "), F.size(c)
        single = F.when(n == 1, F.when(is_section(F.get(c, F.lit(0))), 1).otherwise(-2)).otherwise(0)
        score = n + F.when((n >= 2) & (n <= 6), 3).otherwise(0) + single - F.when(F.length(joined) > 180, 2).otherwise(0)
        score += F.when(F.exists(c, is_code_like), 2).otherwise(0) + F.when(F.exists(c, is_price_like), 1).otherwise(0) + F.when(is_section(joined), 1).otherwise(0)
        return F.when(n == 0, 0).otherwise(score)

    return let(full_cells(cells), of)


def first_by(frame: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
