"""Words with coordinates to rows and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, is_code_like, is_price_like, is_section

PAGE = ["doc_id", "page"]


def band_rows(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """words with band: a new one begins where y0 is off the running mean of the band by over tolerance. Blank words go."""
    word = F.struct("y0", "x0", "x1", "text")
    pages = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("ws"))

    def step(acc: Column, w: Column) -> Column:
        y = w["y0"].cast("double")
        same = (acc["n"] > 0) & (F.abs(y - acc["mean"]) <= tolerance)
        n = F.when(same, acc["n"] + 1).otherwise(1)
        mean = F.when(same, (acc["mean"] * acc["n"] + y) / (acc["n"] + 1)).otherwise(y)
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(n.alias("n"), mean.alias("mean"), band.alias("band"), F.concat(acc["out"], F.array(band)).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(-1).alias("band"), F.array().cast("array<int>").alias("out"))
    bands = F.aggregate("ws", start, step, lambda acc: acc["out"])
    return pages.select(*PAGE, F.explode(F.arrays_zip("ws", bands.alias("b"))).alias("z")).select(*PAGE, F.col("z.ws.*"), F.col("z.b").alias("band"))


def split_cells(words: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, cell_idx, cell): a new cell after a gap over 16, 1.8 median widths and 2.2 median gaps."""
    order = W.partitionBy(*by).orderBy("x0", "y0", "text")
    rows = words.withColumn("gap", F.col("x0") - F.lag("x1").over(order))
    whole = W.partitionBy(*by)
    width = F.percentile(F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), 0.5).over(whole)
    gap = F.coalesce(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).over(whole), F.lit(10.0))
    rows = rows.withColumn("cut", F.greatest(F.lit(16.0), width * 1.8, gap * 2.2))
    rows = rows.withColumn("cell_idx", F.sum(F.when(F.col("gap") > F.col("cut"), 1).otherwise(0)).over(order))
    text = F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "text"))), lambda w: w["text"])
    return rows.groupBy(*by, "cell_idx").agg(clean(F.array_join(text, " ")).alias("cell"))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_idx, cells) of rows (doc_id, page, band, cells): text that runs on joins the last cell before it that isn't a price.

    A row runs on if it has no code and no price, is no section and at most 120 characters long. The first
    three bands with more than one cell never do.
    """
    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("band", "cells"))).alias("rs"))

    def step(acc: Column, r: Column) -> Column:
        cells, text = r["cells"], clean(F.array_join(r["cells"], " "))
        last = F.element_at(acc, -1)
        target = F.array_max(F.transform(last, lambda c, i: F.when(~is_price_like(c), i)))
        joins = (F.size(acc) > 0) & target.isNotNull() & ~((r["band"] < 3) & (F.size(cells) > 1)) & ~is_section(text) & (F.length(text) <= 120)
        joins &= ~F.exists(cells, lambda c: is_code_like(c) | is_price_like(c))
        merged = F.transform(last, lambda c, i: F.when(i == target, clean(F.concat(c, F.lit(" "), text))).otherwise(c))
        return F.when(text == "", acc).when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(cells)))

    out = F.aggregate("rs", F.array().cast("array<array<string>>"), step)
    return pages.select(*PAGE, F.posexplode(out).alias("row_idx", "cells"))


def rows_from_words(words: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_idx, cells) of a page's words."""
    cells = split_cells(band_rows(words), [*PAGE, "band"]).where("cell <> ''")
    rows = cells.groupBy(*PAGE, "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "cell"))), lambda c: c["cell"]).alias("cells"))
    return merge_continuations(rows)


def islands(frame: DataFrame, by: list[str], value: str, most: float, *ties: str) -> DataFrame:
    """frame with island: a new one begins where value is over most above the one before it."""
    order = W.partitionBy(*by).orderBy(value, *ties)
    return frame.withColumn("_new", F.when(F.col(value) - F.lag(value).over(order) > most, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def cluster_positions(points: DataFrame, by: list[str], value: str, most: float = 8) -> DataFrame:
    """Rows (*by, position): the rounded mean of each island."""
    found = islands(points, by, value, most).groupBy(*by, "island").agg(F.bround(F.avg(value)).cast("long").alias("position"))
    return found.select(*by, "position")


def block_rows(blocks: DataFrame, most: float = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, page, row_idx, row_text): blocks in one row while each is at most so far below the one before. ties: columns that order blocks of one place before their text does."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", *ties, "text"))), lambda b: b["text"])
    found = islands(blocks, PAGE, "y0", most, "x0", *ties, "text")
    return found.groupBy(*PAGE, F.col("island").alias("row_idx")).agg(F.array_join(text, " | ").alias("row_text"))


def line_rows(lines: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """lines with row_idx, from 0 in each page. ties: columns that order lines of one place and text."""
    return lines.withColumn("row_idx", F.row_number().over(W.partitionBy(*PAGE).orderBy("y0", "x0", "text", *ties)) - 1)


def words_in_grid(words: DataFrame, x_cuts: DataFrame, y_cuts: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row, col, cell): a word belongs to the cell that its centre is in.

    x_cuts and y_cuts: rows (doc_id, page, n, lo, hi), a page's columns and rows; the range is tested within the page's equality join.
    """
    w = words.withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    at = w.join(x_cuts.select(*PAGE, F.col("n").alias("col"), "lo", "hi"), PAGE).where("cx >= lo and cx < hi").drop("lo", "hi")
    at = at.join(y_cuts.select(*PAGE, F.col("n").alias("row"), "lo", "hi"), PAGE).where("y0 >= lo and y0 < hi")
    text = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"])
    return at.groupBy(*PAGE, "row", "col").agg(F.array_join(text, " ").alias("cell"))


def anchor_text(text: Column, segments: Column) -> Column:
    """The pieces text[start:end] of segments, together."""
    return F.array_join(F.transform(segments, lambda s: F.when(s["end"] > s["start"], F.substring(text, s["start"] + 1, s["end"] - s["start"])).otherwise("")), "")


def pick_candidate(table_score: Column, text_score: Column, has_table: Column) -> Column:
    """Whether a page's table rows are taken rather than its text rows."""
    return has_table & (table_score > text_score) & ((table_score - text_score >= 20) | (text_score < 100))


def json_payload(text: Column) -> Column:
    """The outermost JSON object in an answer, code fences dropped; {} if it holds none."""
    body = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), "(?s)\\{.*\\}", 0)
    return F.when(F.try_parse_json(body).isNull(), "{}").otherwise(body) if hasattr(F, "try_parse_json") else F.coalesce(F.nullif(body, F.lit("")), F.lit("{}"))


def ocr_cells(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean), lambda c: c != "")
