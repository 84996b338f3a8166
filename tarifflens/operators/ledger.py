"""Kept tables of imports, and events about them: the state is what the events make of the imports.

Imports and batches of events are partitions of Parquet tables under an id that the caller gives: saving one again replaces
its own partition, and a marker that is written last tells which are whole, so that repeating a call adds
nothing and one that dies leaves nothing to be seen. Nothing is changed in place; `current` applies the events.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price as P
from .ingest import Ingested, archive_totals
from .rows import first_by

#: Columns of each kind of event; seq orders the events of all kinds.
EVENTS = {
    "reviews": "seq long, item_id long, service_name_raw string, service_code_source string, price_resident double, price_nonresident double, price_original double, currency string",
    "matches": "seq long, item_id long, service_id long, create_name string, create_category string, create_code string, note string",
    "deletions": "seq long, doc_id long, archive string",
}
TABLES = ("partners", "documents", "items", "warnings")
#: Notes of items that a person has settled.
VERIFIED, MATCHED = "manual verified", "manual matched"


def _folder(name: str) -> str:
    return "i" + hashlib.sha256(name.encode()).hexdigest()[:24]


def _put(frame: DataFrame, path: str, part: str) -> None:
    frame.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _done(spark: SparkSession, out: str, kind: str, name: str, part: str) -> None:
    _put(spark.createDataFrame([(kind, name)], "kind string, name string"), f"{out}/done/{kind}", part)


def save(found: Ingested, out: str, import_id: str) -> None:
    """Keeps what an ingest found. Saving it again under the same id changes nothing; it can be seen once all of it is there."""
    part = _folder(import_id)
    for name in TABLES:
        _put(getattr(found, name), f"{out}/{name}", part)
    _done(found.documents.sparkSession, out, "import", import_id, part)


def record(events: DataFrame, out: str, kind: str, batch_id: str) -> None:
    """Keeps a batch of events of a kind of EVENTS; columns that are missing are null. Recording it again changes nothing."""
    wanted = [x.split() for x in EVENTS[kind].split(", ")]
    columns = [(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted]
    part = _folder(batch_id)
    _put(events.select(*columns), f"{out}/{kind}", part)
    _done(events.sparkSession, out, kind, batch_id, part)


def _whole(spark: SparkSession, out: str, table: str, kind: str) -> DataFrame:
    done = spark.read.parquet(f"{out}/done/{kind}").select("part")
    return spark.read.parquet(f"{out}/{table}").join(done, "part", "left_semi").drop("part")


def load(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of whole imports: partners, documents, items and warnings. A partner that several imports found is there once, by its least spelling."""
    tables = {name: _whole(spark, out, name, "import") for name in TABLES}
    tables["partners"] = tables["partners"].groupBy("partner_id").agg(F.min("name").alias("name"))
    return tables


def events(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The events of a kind in whole batches; none where none has been recorded."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/done/{kind}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], EVENTS[kind])
    return _whole(spark, out, kind, kind)


@dataclass(frozen=True)
class State:
    documents: DataFrame
    items: DataFrame
    services: DataFrame

    def archives(self) -> DataFrame:
        return archive_totals(self.documents, self.items)


def _resolved(matches: DataFrame, services: DataFrame, reviews: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches that name a service, with its id, and the services that they make; items: (item_id, own, until), its name and the event that deletes it.

    A name stands for the service of that name in any case, of the least id. Where there is none, the first event to
    name it makes one; its id follows from the name, so that two tables of events make the same.
    """
    known = services.groupBy(F.lower("service_name").alias("k")).agg(F.min("service_id").alias("known"))
    name = F.nullif(F.trim("create_name"), F.lit(""))
    of = matches.join(items, "item_id").where("until IS NULL OR seq < until")
    named = of.where("service_id IS NULL").withColumn("name", name).where("name IS NOT NULL").withColumn("k", F.lower("name")).join(known, "k", "left")
    made = first_by(named.where("known IS NULL"), ["k"], F.col("seq"))
    # Its item's name, as reviews before it left it, is a synonym.
    before = made.select("k", "item_id", F.col("seq").alias("at")).join(reviews.select("item_id", "seq", F.trim("service_name_raw").alias("later")), "item_id").where("seq < at AND later <> ''")
    before = before.groupBy("k").agg(F.max_by("later", "seq").alias("later"))
    made = made.join(before, "k", "left").withColumn("raw", F.coalesce("later", "own"))
    new = made.select(
        F.xxhash64("k").alias("service_id"), F.col("name").alias("service_name"), F.col("create_category").alias("category"), F.col("create_code").alias("icd_code"),
        F.when(F.col("raw") != F.col("name"), F.array("raw")).otherwise(F.array().cast("array<string>")).alias("synonyms"), F.lit(True).alias("is_active"),
    )
    by_id = of.where("service_id IS NOT NULL").join(services.select("service_id"), "service_id", "left_semi").select("seq", "item_id", "service_id", "note")
    by_name = named.select("seq", "item_id", F.coalesce("known", F.xxhash64("k")).alias("service_id"), "note")
    return by_id.union(by_name), new


def _deleted(documents: DataFrame, deletions: DataFrame) -> DataFrame:
    """Rows (doc_id, seq) of the events that delete documents: one for each event about a document, and one for each document of a deleted archive, however many events delete that."""
    archives = deletions.where("archive IS NOT NULL").groupBy("archive").agg(F.min("seq").alias("seq"))
    by_archive = documents.select("doc_id", "archive").join(archives, "archive").select("doc_id", "seq")
    return deletions.where("doc_id IS NOT NULL").select("doc_id", "seq").union(by_archive)


def current(documents: DataFrame, items: DataFrame, services: DataFrame, reviews: DataFrame, matches: DataFrame, deletions: DataFrame) -> State:
    """documents (doc_id, archive, parse_status, ...), items and services (service_id, service_name, category, icd_code, synonyms, is_active) after all events.

    A review sets an item's name (unless blank), code, prices and currency (null without a price), verifies it, and its
    document is processed. A match sets the service, by id or by name, and verifies the item; its document is processed
    if no item of it waits for a person then. Deleting a document takes its items, deleting an archive its
    documents. Events about items, services, documents or archives that aren't there change nothing.
    """
    gone = _deleted(documents, deletions).groupBy("doc_id").agg(F.min("seq").alias("until"))
    settled, new = _resolved(matches, services, reviews, items.select("item_id", "doc_id", F.col("service_name_raw").alias("own")).join(gone, "doc_id", "left"))
    documents, items = documents.join(gone, "doc_id", "left_anti"), items.join(gone, "doc_id", "left_anti")

    fields = ("service_code_source", "price_resident", "price_nonresident", "price_original", "currency")
    name = F.nullif(F.trim("service_name_raw"), F.lit(""))
    reviewed = reviews.groupBy("item_id").agg(F.max(F.struct("seq", *fields)).alias("r"), F.max(F.when(name.isNotNull(), F.struct("seq", name.alias("name")))).alias("named"))
    matched = settled.groupBy("item_id").agg(F.max(F.struct("seq", "service_id", "note")).alias("m"))
    joined = items.join(reviewed, "item_id", "left").join(matched, "item_id", "left")

    r, m = F.col("r").isNotNull(), F.col("m").isNotNull()
    priced = F.coalesce("r.price_resident", "r.price_nonresident", "r.price_original").isNotNull()
    code = F.when(F.col("r.service_code_source") != "", F.trim("r.service_code_source"))
    changed = {c: F.when(r, F.col(f"r.{c}")).otherwise(F.col(c)) for c in fields[1:4]}
    changed["service_code_source"] = F.when(r, code).otherwise(F.col("service_code_source"))
    changed["currency"] = F.when(r, F.when(priced, F.col("r.currency"))).otherwise(F.col("currency"))
    changed["service_name_raw"] = F.coalesce("named.name", "service_name_raw")
    changed["service_id"] = F.coalesce("m.service_id", "service_id")
    changed["is_verified"] = F.col("is_verified") | r | m
    last = F.when(m & (~r | (F.col("m.seq") > F.col("r.seq"))), F.coalesce(F.nullif(F.col("m.note"), F.lit("")), F.lit(MATCHED))).when(r, VERIFIED)
    changed["verification_note"] = F.coalesce(last, "verification_note")
    after = joined.select(*(changed.get(c, F.col(c)).alias(c) for c in items.columns), r.alias("r"), m.alias("m"))

    waits = P.item_needs_review(*(F.col(c) for c in ("is_verified", "service_id", "price_resident", "price_nonresident", "price_original", "verification_note")))
    about = after.groupBy("doc_id").agg(F.bool_or("r").alias("r"), F.bool_or("m").alias("m"), F.bool_or(F.coalesce(waits, F.lit(True))).alias("waits"))
    status = F.when(F.col("r") | (F.col("m") & ~F.col("waits")), "processed").otherwise(F.col("parse_status"))
    told = documents.join(about, "doc_id", "left").select(*(F.coalesce(status, "parse_status").alias(c) if c == "parse_status" else F.col(c) for c in documents.columns))
    return State(told, after.drop("r", "m"), services.select(*new.columns).union(new))
