"""Pages of rows: their sources, scores and choice, and how they become a document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layout import PAGE, ocr_cells, pick_candidate
from .rows import first_by, full_cells, rowset_score

#: The score from which a page's own rows are taken, and pages of a batch where no size is given.
ACCEPTED, BATCH = 120, 5


def coerce_words(raw: DataFrame) -> DataFrame:
    """raw with text, x0, y0, x1 and y1 of a word's type: top and bottom stand in for y0 and y1, zeros for what is missing."""
    has = {c.lower() for c in raw.columns}
    place = lambda *names: F.coalesce(*(F.col(n).cast("double") for n in names if n in has), F.lit(0.0))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in has else F.lit("")
    words = raw.withColumns({"text": text, "x0": place("x0"), "x1": place("x1"), "y0": place("y0", "top"), "y1": place("y1", "bottom")})
    return words.drop("top", "bottom")


def filter_grid(rows: DataFrame) -> DataFrame:
    """rows whose cells have a digit."""
    return rows.where(F.array_join("cells", " ").rlike("\\d"))


def table_rows(header: DataFrame, body: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_idx, cells): header rows, then body rows, by their n, without empty cells; both (doc_id, page, n, cells)."""
    parts = header.withColumn("part", F.lit(0)).unionByName(body.withColumn("part", F.lit(1)))
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("part", "n")) - 1
    return parts.select(*PAGE, n.alias("row_idx"), full_cells(F.col("cells")).alias("cells"))


def page_scores(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, page, score): how much the rows of a page look like those of a price table."""
    return rows.groupBy(*PAGE).agg(F.sum(rowset_score(F.col("cells"))).cast("long").alias("score"))


def choose_rows(tables: DataFrame, texts: DataFrame, accepted: int = ACCEPTED) -> DataFrame:
    """Rows (doc_id, page, takes_table, score, accepted), one for each page of either source: whose rows are taken, and whether they do without recognition."""
    t, x = page_scores(tables).withColumnRenamed("score", "t"), page_scores(texts).withColumnRenamed("score", "x")
    both = t.join(x, PAGE, "full").withColumn("has", F.col("t").isNotNull()).fillna(0, ["t", "x"])
    takes = pick_candidate(F.col("t"), F.col("x"), F.col("has"))
    score = F.when(takes, F.col("t")).otherwise(F.col("x"))
    return both.select(*PAGE, takes.alias("takes_table"), score.alias("score"), (score >= accepted).alias("accepted"))


def cascade(pages: DataFrame, *sources: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_idx, cells, source) of the first of sources that has any for a page; a page without rows has one that names it.

    pages: all (doc_id, page). sources: rows (doc_id, page, row_idx, cells), by priority; source counts from 0, and is null for a page's name.
    """
    every = [s.select(*PAGE, "row_idx", "cells").withColumn("source", F.lit(n)) for n, s in enumerate(sources)]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    best = rows.withColumn("best", F.min("source").over(W.partitionBy(*PAGE))).where("source = best").drop("best")
    named = pages.select(*PAGE).distinct().join(rows, PAGE, "left_anti")
    return best.unionByName(named.select(*PAGE, F.lit(0).alias("row_idx"), F.array(F.format_string("[page %d]", "page")).alias("cells"), F.lit(None).cast("int").alias("source")))


def flatten_pages(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, row_idx, cells): the pages of a document one after another."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "row_idx")) - 1
    return rows.select("doc_id", n.alias("row_idx"), "cells")


def batch_pages(pages: DataFrame, size: int) -> DataFrame:
    """pages with batch: so many pages of a document by number each, five where size isn't positive. pages: distinct (doc_id, page)."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1
    return pages.withColumn("batch", F.floor(n / (size if size > 0 else BATCH)).cast("int"))


def dump_lines(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, row_idx, cells) with line: page, number in the page from 1, and the cells that aren't empty."""
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("row_idx"))
    return rows.withColumn("line", F.format_string("%03d:%04d %s", "page", n, F.array_join(ocr_cells(F.col("cells")), " | ")))


def by_key(frame: DataFrame, key: str, value: Column | object) -> DataFrame:
    """The row with this key, or none; of several the one that sorts first."""
    return first_by(frame.where(F.col(key) == value), [key], *(F.col(c) for c in frame.columns if c != key))
