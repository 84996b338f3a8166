"""Pages that are read from two sources, and what is left to recognise: work in batches first, answers later.

A reader gives a page's rows from its tables and from its text layer. The better source is taken; pages whose rows look
too little like a price list are put out as batches of work. Recognition answers in its own time, page by page, and may
fail and be tried again; ingesting with the answers so far gives the documents as far as they go, so a provider
that fails twice leaves the same document as one that answers at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean
from .layout import PAGE
from .pages import ACCEPTED, BATCH, batch_pages, choose_rows
from .rows import first_by

#: Fixed value: how often a page is tried.
ATTEMPTS = 5
#: What recognition answers: for each attempt, a page's text or what went wrong.
ANSWERS = "doc_id long, page int, attempt int, text string, error string"


@dataclass(frozen=True)
class Pages:
    """rows (doc_id, row_idx, cells) and texts (doc_id, raw_content) of the documents; queue (doc_id, page, batch, attempt): what is to be recognised next; warnings (doc_id, page, warning)."""

    rows: DataFrame
    texts: DataFrame
    queue: DataFrame
    warnings: DataFrame


def last_answers(answers: DataFrame) -> DataFrame:
    """Rows (doc_id, page, tried, recognised, error), one for each page with an attempt: how many there were, the first text that any gave, and else the last error."""
    text = F.nullif(clean(F.col("text")), F.lit(""))
    good = F.min(F.when(text.isNotNull(), F.struct("attempt", text.alias("text"))))
    empty = F.bool_or(F.col("error").isNull())
    found = answers.groupBy(*PAGE).agg(F.max("attempt").alias("tried"), good.alias("good"), empty.alias("answered"), F.max(F.struct("attempt", "error")).alias("last"))
    return found.select(*PAGE, "tried", "answered", F.col("good.text").alias("recognised"), F.when(~F.col("answered"), F.col("last.error")).alias("error"))


def resolve(rows: DataFrame, answers: DataFrame | None = None, batch: int = BATCH, attempts: int = ATTEMPTS, accepted: int = ACCEPTED) -> Pages:
    """rows: (doc_id, page, row_idx, cells, source), source being table or text; a page without rows has one whose cells are null.

    A page has the rows of its better source, then, if these weren't enough and recognition has answered, one
    row with the answer, which is its text, too. A page that was tried so many times in vain isn't tried again, and
    leaves a warning; so does every error that is the last so far.
    """
    have = rows.where("cells IS NOT NULL")
    tables, texts = (have.where(F.col("source") == s).drop("source") for s in ("table", "text"))
    choice = choose_rows(tables, texts, accepted)
    taken = tables.join(choice.where("takes_table"), PAGE, "left_semi").unionByName(texts.join(choice.where("NOT takes_table"), PAGE, "left_semi"))
    answers = rows.sparkSession.createDataFrame([], ANSWERS) if answers is None else answers
    pages = rows.select(*PAGE).distinct().join(choice.select(*PAGE, "accepted"), PAGE, "left").join(last_answers(answers), PAGE, "left")
    poor = pages.where(~F.coalesce("accepted", F.lit(False)))

    said = poor.where("recognised IS NOT NULL").select(*PAGE, F.lit(1 << 30).alias("row_idx"), F.array("recognised").alias("cells"))
    every = taken.select(*PAGE, F.col("row_idx").cast("int"), "cells").unionByName(said.withColumn("row_idx", F.col("row_idx").cast("int")))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "row_idx")) - 1
    lines = taken.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row_idx", F.array_join("cells", " ").alias("line")))).alias("lines"))
    own = lines.select(*PAGE, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("own"))
    chunks = pages.join(own, PAGE, "left").select(*PAGE, F.coalesce(F.when(~F.coalesce("accepted", F.lit(False)), F.col("recognised")), "own").alias("chunk")).where("chunk IS NOT NULL")
    joined = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "chunk"))).alias("c"))
    content = joined.select("doc_id", F.array_join(F.transform("c", lambda x: x["chunk"]), "\n").alias("raw_content"))

    tried = F.coalesce("tried", F.lit(0))
    wanted = poor.where(~F.coalesce("answered", F.lit(False)) & (tried < attempts)).select(*PAGE, (tried + 1).alias("attempt"))
    queue = batch_pages(wanted, batch).select(*PAGE, "batch", "attempt")
    failed = poor.where("error IS NOT NULL").select(*PAGE, F.format_string("OCR failed for PDF page %d: %s", "page", "error").alias("warning"))
    return Pages(every.select("doc_id", n.alias("row_idx"), "cells"), content, queue, failed)


def work(queue: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows (doc_id, batch, pages, attempts, content): a batch of pages of one document each, for a provider; contents: (doc_id, content)."""
    batches = queue.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("page", "attempt"))).alias("p"))
    return batches.join(first_by(contents, ["doc_id"], F.length("content")), "doc_id").select("doc_id", "batch", F.col("p.page").alias("pages"), F.col("p.attempt").alias("attempts"), "content")
