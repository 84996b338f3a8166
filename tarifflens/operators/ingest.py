"""One call from files to documents, items and warnings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import text as T
from ..sources.archives import read_files
from ..sources.files import READABLE, TEXT, expand, read_all, read_directory
from ..sources.steps import Steps
from .history import active_versions, match_names, previous_prices
from .recognition import resolve
from .rows import parse_rows

#: Characters of an item's name, code and note that are kept; warnings in a document's log; note of an item that stands for a whole document.
NAME, CODE, NOTE, LOG = 500, 128, 1000, 5
MANUAL = "needs manual review"


def document_status(review: Column, content: Column, late: Column) -> Column:
    """review: whether any row waits for a person, null if there are no rows. Rows decide, and a date in the future; without rows, text waits and no text is an error."""
    readable = T.clean(F.coalesce(content, F.lit(""))) != ""
    return F.when(review.isNotNull(), F.when(review | late, "needs_review").otherwise("processed")).when(readable, "needs_review").otherwise("error")


def archive_totals(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (archive, n_documents, n_items, n_matched, status)."""
    counts = items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("service_id").alias("m"))
    has = lambda s: F.bool_or(F.col("parse_status") == s)
    status = F.when(has("error"), "error").when(has("needs_review"), "needs_review").otherwise("processed")
    rows = documents.where("archive is not null").join(counts, "doc_id", "left")
    return rows.groupBy("archive").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_matched"), status.alias("status"))


@dataclass(frozen=True)
class Ingested:
    """partners: the new ones (partner_id, name). documents, items and warnings as ingest describes them; queue: pages to recognise (doc_id, page, batch, attempt); archives and stats are derived."""

    partners: DataFrame
    documents: DataFrame
    items: DataFrame
    warnings: DataFrame
    queue: DataFrame | None = None
    steps: Steps | None = None

    def delete_steps(self) -> None:
        """Deletes the tables between steps that these tables are read from; to be called once they are saved."""
        if self.steps is not None:
            self.steps.delete()

    def archives(self) -> DataFrame:
        return archive_totals(self.documents, self.items)

    def stats(self) -> DataFrame:
        """One row (partners, documents, items, matched): what is new."""
        total = self.items.agg(F.count("*").alias("items"), F.count("service_id").alias("matched"))
        return self.partners.agg(F.count("*").alias("partners")).join(self.documents.agg(F.count("*").alias("documents"))).join(total)


def _doc_id() -> Column:
    return F.xxhash64(F.coalesce("archive", F.lit("")), F.col("entry_path"))


def _named(entries: DataFrame, partners: DataFrame) -> DataFrame:
    """entries with doc_id, name, ending, partner, partner_id and effective_date."""
    name = F.element_at(T.path_parts(F.col("entry_path")), -1)
    rows = entries.withColumn("name", name).withColumn("ending", T.suffix(F.col("name"))).withColumn("stem", T.stem(F.col("name")))
    own = T.partner_name(F.col("name"))
    outer = F.when(F.col("group_key") != "__root__", F.col("group_key")).otherwise(T.stem(F.col("archive")))
    partner = F.when(F.col("archive").isNull() | (own != F.col("stem")), own).otherwise(outer)
    folder = F.when(F.col("archive").isNull(), F.element_at(T.path_parts(F.col("entry_path")), -2))
    rows = rows.withColumns({"doc_id": _doc_id(), "partner": partner, "effective_date": F.coalesce(P.extract_date(F.col("stem")), P.extract_date(folder))})
    known = partners.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("partner_id").alias("known_id"))
    rows = rows.join(known, F.lower(F.trim("partner")) == F.col("k"), "left").drop("k")
    return rows.withColumn("partner_id", F.coalesce("known_id", F.xxhash64(F.lower(F.trim("partner")))))


def ingest(files: DataFrame, services: DataFrame, partners: DataFrame, history: DataFrame | None = None, rates: DataFrame | None = None, today: date | None = None, readers: dict | None = None, first_seq: int = 1, answers: DataFrame | None = None) -> Ingested:
    """Reads, parses, matches, versions and checks files (path, content), archives among them.

    services: (service_id, service_name, synonyms, is_active). partners: (partner_id, name). history: items
    (item_id, partner_id, service_id, doc_seq, effective_date, price) of earlier calls. rates:
    (currency, rate) as a service answers them; what it lacks has a fixed rate. first_seq: the first number in a
    partner's order of documents.

    documents: (doc_id, archive, partner_id, doc_seq, file_name, source_path, file_format, effective_date, parse_status,
    parse_log, raw_content). items: (item_id, doc_id, partner_id, doc_seq, service_name_raw,
    service_code_source, service_id, price_resident, price_nonresident, price_original, currency, is_verified,
    verification_note, effective_date, is_active). warnings: (archive, path, n, warning). A document's log has the last
    warnings up to its own in the order of its import; files that no reader takes give a warning alone,
    those that can't be read a document without items, and those with text but no rows an item that stands for them.
    Of pages that a reader gives from two sources the better is taken; what is left to recognise is in queue, and
    answers (doc_id, page, attempt, text, error) are what recognition said of earlier queues.
    """
    members = _named(expand(files), partners)
    usable = members.where(F.col("ending").isin(*READABLE) & F.col("error").isNull())
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("name"))
    read = read_all(usable.select(key.alias("path"), "content"), readers).withColumn("doc_id", F.split("path", "/")[0].cast("long"))
    return _ingest(members.drop("content"), read, services, partners, history, rates, today, first_seq, answers)


def ingest_paths(spark: SparkSession, paths: str | list[str], services: DataFrame, partners: DataFrame, history: DataFrame | None = None, rates: DataFrame | None = None, today: date | None = None, first_seq: int = 1, answers: DataFrame | None = None) -> Ingested:
    """ingest of files, folders and archives by their paths: members of one archive are read by many tasks."""
    entries = _named(read_files(spark, paths, "entries").drop("size"), partners)
    read = read_files(spark, paths, "rows").withColumn("doc_id", _doc_id())
    taken = entries.where(F.col("ending").isin(*READABLE) & F.col("error").isNull()).select("doc_id")
    return _ingest(entries, read.join(taken, "doc_id", "left_semi"), services, partners, history, rates, today, first_seq, answers)


def _ingest(members: DataFrame, read: DataFrame, services: DataFrame, partners: DataFrame, history: DataFrame | None, rates: DataFrame | None, today: date | None, first_seq: int, answers: DataFrame | None) -> Ingested:
    now = F.lit(today).cast("date") if today else F.current_date()
    steps = Steps(members.sparkSession)
    shared = steps.keep
    entries, read = shared(members), shared(read)
    usable = entries.where(F.col("ending").isin(*READABLE) & F.col("error").isNull())
    pages = resolve(read.where("source IS NOT NULL").select("doc_id", "page", "row_idx", "cells", "source"), answers)
    grid = read.where("cells IS NOT NULL AND source IS NULL").select("doc_id", "row_idx", "cells").unionByName(pages.rows)
    parsed = shared(parse_rows(grid, ["doc_id"]).where(F.trim("service_name_raw") != ""))
    plain = read.where("cells IS NULL AND error IS NULL AND source IS NULL").select("doc_id", "text").join(pages.texts, "doc_id", "left")
    texts = plain.select("doc_id", F.substring(F.coalesce("raw_content", "text"), 1, TEXT).alias("raw_content"))
    recognised = pages.warnings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "warning"))), lambda x: x["warning"]).alias("recognised"))
    failed = read.where("error IS NOT NULL").select("doc_id", F.col("error").alias("failed"))

    # Items before versions.
    names = shared(parsed.select(F.col("service_name_raw").alias("raw_name")).distinct())
    matched = shared(match_names(names, services))
    rows = parsed.join(matched, F.col("service_name_raw") == F.col("raw_name"), "left").withColumn("currency", P.detect_currency(F.col("raw_row")))
    rows = P.with_rates(rows, rates)
    resident, nonresident = P.to_kzt(F.col("price_resident"), F.col("rate")), P.to_kzt(F.col("price_nonresident"), F.col("rate"))
    rows = rows.withColumns({"price_original": F.col("price_resident"), "price_resident": resident, "price_nonresident": nonresident})
    rows = rows.withColumns({"price": P.current_price(*(F.col(c) for c in ("price_resident", "price_nonresident", "price_original"))), "item_id": F.xxhash64("doc_id", "row_idx")})
    order = W.partitionBy("partner_id").orderBy(F.col("archive").asc_nulls_first(), "group_no", "member_no", "entry_path")
    numbered = shared(usable.withColumn("doc_seq", F.row_number().over(order) - 1 + first_seq))
    about = numbered.select("doc_id", "partner_id", "doc_seq", "effective_date", "stem")
    rows = shared(rows.join(about, "doc_id"))
    versions = rows.select("item_id", "partner_id", "service_id", "doc_seq", "effective_date", "price")
    if history is not None:
        versions = versions.unionByName(history.select(*versions.columns))
    rows = rows.join(previous_prices(versions), "item_id", "left").join(active_versions(versions).select("item_id", "active"), "item_id")

    late = F.coalesce(F.col("effective_date") > now, F.lit(False))
    prices = [F.col(c) for c in ("price_resident", "price_nonresident", "price_original")]
    percent = F.concat(F.lit("("), F.col("score").cast("string"), F.lit("%)"))
    how = F.when(F.col("status") == "fuzzy_review", F.concat(F.lit("service review suggested "), percent)).when(F.col("service_id").isNull(), "service match required")
    how = how.when(F.col("status") == "fuzzy_auto", F.concat(F.lit("auto matched "), percent)).otherwise(F.concat("status", F.lit(" matched")))
    moved = P.change_note(F.col("previous_price"), F.col("price"))
    converted = F.when(F.col("currency") != "KZT", F.concat(F.lit("currency converted from "), "currency", F.lit(" via "), "rate_source", F.lit(" rate")))
    note = T.join_notes(how, F.array_join(P.price_reasons(*prices), "; "), converted, F.when(late, "price date is in the future"), moved)
    review = (F.col("status") == "fuzzy_review") | P.needs_review(F.col("service_id"), *prices) | moved.isNotNull()
    rows = rows.withColumn("review", F.coalesce(review, F.lit(True))).select(
        "item_id", "doc_id", "partner_id", "doc_seq", T.truncate(F.col("service_name_raw"), NAME).alias("service_name_raw"), T.truncate(F.col("service_code_source"), CODE).alias("service_code_source"), "service_id",
        "price_resident", "price_nonresident", "price_original", F.when(F.coalesce(*prices).isNotNull(), F.col("currency")).alias("currency"), F.lit(False).alias("is_verified"),
        T.truncate(note, NOTE).alias("verification_note"), "effective_date", F.col("active").alias("is_active"), "review",
    )
    rows = shared(rows)

    # Documents: what their rows say of them, and the last warnings.
    counts = rows.groupBy("doc_id").agg(F.bool_or("review").alias("review"))
    docs = numbered.join(counts, "doc_id", "left").join(texts, "doc_id", "left").join(failed, "doc_id", "left").join(recognised, "doc_id", "left")
    late_warning = F.when(late, F.concat(F.lit("Price date is in the future: "), "name", F.lit(" -> "), F.col("effective_date").cast("string")))
    own = F.concat(F.coalesce("recognised", F.array().cast("array<string>")), F.array(F.when(F.col("failed").isNotNull(), F.concat(F.lit("Failed to read "), "name", F.lit(": "), "failed")), late_warning))
    own = F.array_compact(own)
    status = document_status(F.col("review"), F.col("raw_content"), late)
    docs = docs.withColumns({"own": own, "parse_status": status})
    skipped = F.when(F.col("error").isNotNull(), F.concat(F.lit("Failed to read "), "name", F.lit(": "), "error")).otherwise(F.concat(F.lit("Skipped unsupported file: "), "name"))
    place = ["archive", "group_no", "member_no", "entry_path"]
    told = docs.select(*place, "own").unionByName(entries.join(usable.select("doc_id"), "doc_id", "left_anti").select(*place, F.array(skipped).alias("own")))
    line = W.partitionBy(F.coalesce("archive", F.lit(""))).orderBy("group_no", "member_no", "entry_path")
    # The last warnings up to a place stand with the last places that have any, so a few rows are enough.
    last = told.where(F.size("own") > 0).withColumn("log", F.flatten(F.collect_list("own").over(line.rowsBetween(1 - LOG, 0))))
    last = last.withColumn("log", F.expr(f"slice(log, greatest(size(log) - {LOG - 1}, 1), {LOG})"))
    logged = docs.join(last.select("archive", "entry_path", "log").withColumnsRenamed({"archive": "_archive", "entry_path": "_entry"}), F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("entry_path") == F.col("_entry")), "left")
    logged = logged.withColumn("log", F.last("log", ignorenulls=True).over(line))
    documents = logged.select(
        "doc_id", "archive", "partner_id", "doc_seq", F.col("name").alias("file_name"), F.col("entry_path").alias("source_path"), F.replace("ending", F.lit("."), F.lit("")).alias("file_format"),
        "effective_date", "parse_status", F.array_join("log", "\n").alias("parse_log"), "raw_content",
    )
    warnings = told.select("archive", F.col("entry_path").alias("path"), F.posexplode("own").alias("n", "warning"))

    whole = logged.where((F.col("parse_status") != "error") & F.col("review").isNull())
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in rows.dtypes}
    stand_in = {
        "item_id": F.xxhash64("doc_id", F.lit(-1)), "doc_id": F.col("doc_id"), "partner_id": F.col("partner_id"), "doc_seq": F.col("doc_seq"), "effective_date": F.col("effective_date"), "is_active": F.lit(True),
        "service_name_raw": T.truncate(F.col("stem"), NAME), "is_verified": F.lit(False), "verification_note": F.lit(MANUAL),
    }
    items = rows.unionByName(whole.select(*(stand_in[c].alias(c) if c in stand_in else x for c, x in empty.items()))).drop("review")
    fresh = entries.where(F.col("known_id").isNull() & F.col("partner").isNotNull()).groupBy("partner_id").agg(F.min("partner").alias("name"))
    return Ingested(fresh, documents, items, warnings, pages.queue, steps)


def ingest_directory(spark: SparkSession, folder: str, services: DataFrame, partners: DataFrame, **more) -> Ingested:
    """ingest of the files of a folder other than archives, without its sub-folders."""
    return ingest(read_directory(spark, folder), services, partners, **more)
