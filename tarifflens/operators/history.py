"""Matching to a catalogue, versions of prices, and corrections as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, looks_uncertain, ratio, stem, token_sorted
from .qgrams import candidates
from .rows import first_by
from .versions import active_versions, previous_prices  # noqa: F401

AUTO, REVIEW = 92, 85


def choices(services: DataFrame) -> DataFrame:
    """Rows (label, service_id, source, ordinal): names and synonyms of active services, in the order in which equals are settled."""
    active = services.where("is_active")
    names = active.select(F.col("service_name").alias("label"), "service_id", F.lit("service").alias("source"), F.lit(0).alias("ordinal"))
    others = active.select("service_id", F.posexplode("synonyms").alias("n", "label")).select(clean(F.col("label")).alias("label"), "service_id", F.lit("synonym").alias("source"), (F.col("n") + 1).alias("ordinal"))
    return names.union(others.where("label <> ''"))


def match_names(names: DataFrame, services: DataFrame) -> DataFrame:
    """Rows (raw_name, service_id, score, status) for the distinct raw_name of names.

    Equal labels settle a name by an equality join. The rest meet the labels with which they share a rare q-gram
    (qgrams) and differ by no more edits than the score allows; these pairs are scored, by the longest common
    subsequence. No match is lost.
    """
    wanted = names.select("raw_name").where("raw_name is not null").distinct()
    listed = choices(services)
    key = lambda c: F.lower(clean(F.col(c)))
    exact = wanted.where(~looks_uncertain(F.col("raw_name"))).join(listed.withColumn("k", key("label")), key("raw_name") == F.col("k"))
    exact = first_by(exact, ["raw_name"], F.col("service_id"), F.col("ordinal"))
    exact = exact.select("raw_name", "service_id", F.lit(100.0).alias("score"), F.when(F.col("source") == "synonym", "synonym").otherwise("exact").alias("status"))
    rest = wanted.where(~looks_uncertain(F.col("raw_name"))).join(exact, "raw_name", "left_anti").withColumn("x", token_sorted(F.col("raw_name")))
    labels = listed.withColumn("y", token_sorted(F.col("label"))).where("y <> ''")
    rest = rest.where("x <> ''")
    met = candidates(rest.select("x").distinct(), labels.select("y").distinct(), REVIEW / 100)
    near = met.withColumn("score", ratio(F.col("x"), F.col("y"))).where(F.col("score") >= REVIEW)
    pairs = rest.join(near, "x").join(labels, "y")
    scored = first_by(pairs, ["raw_name"], F.col("score").desc(), F.col("service_id"), F.col("ordinal"))
    fuzzy = scored.select(
        "raw_name", F.when(F.col("score") >= AUTO, F.col("service_id")).alias("service_id"), "score", F.when(F.col("score") >= AUTO, "fuzzy_auto").otherwise("fuzzy_review").alias("status")
    )
    found = exact.union(fuzzy)
    none = wanted.join(found, "raw_name", "left_anti").select("raw_name", F.lit(None).cast("long").alias("service_id"), F.lit(None).cast("double").alias("score"), F.lit("none").alias("status"))
    return found.union(none)


def apply_reviews(items: DataFrame, events: DataFrame) -> DataFrame:
    """items as the latest review event of each leaves them; events: (item_id, seq, service_name_raw, price_resident, price_nonresident)."""
    last = first_by(events, ["item_id"], F.col("seq").desc()).select("item_id", *(F.col(c).alias(f"new_{c}") for c in ("service_name_raw", "price_resident", "price_nonresident")), F.lit(True).alias("reviewed"))
    joined, done = items.join(last, "item_id", "left"), F.col("reviewed").isNotNull()
    changed = {
        "service_name_raw": F.when(done, F.coalesce(F.nullif(F.trim("new_service_name_raw"), F.lit("")), "service_name_raw")).otherwise(F.col("service_name_raw")),
        "price_resident": F.when(done, F.col("new_price_resident")).otherwise(F.col("price_resident")),
        "price_nonresident": F.when(done, F.col("new_price_nonresident")).otherwise(F.col("price_nonresident")),
        "is_verified": done | F.col("is_verified"),
        "verification_note": F.when(done, "manual verified").otherwise(F.col("verification_note")),
    }
    return joined.withColumns(changed).select(*items.columns)


def apply_matches(items: DataFrame, events: DataFrame, services: DataFrame) -> DataFrame:
    """items with the service of their latest match event; events: (item_id, seq, service_id, service_name). A name is looked up whatever its case."""
    byname = services.groupBy(F.lower("service_name").alias("k")).agg(F.min("service_id").alias("named"))
    last = first_by(events, ["item_id"], F.col("seq").desc()).join(byname, F.lower("service_name") == F.col("k"), "left")
    last = last.select("item_id", F.coalesce("service_id", "named").alias("matched"))
    joined, done = items.join(last, "item_id", "left"), F.col("matched").isNotNull()
    return joined.withColumns({"service_id": F.coalesce("matched", "service_id"), "is_verified": done | F.col("is_verified"), "verification_note": F.when(done, "manual matched").otherwise(F.col("verification_note"))}).select(*items.columns)


def without_deleted(items: DataFrame, documents: DataFrame) -> DataFrame:
    """items whose document isn't among the deleted ones."""
    return items.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The first of each key of new that existing lacks."""
    return first_by(new, [key], F.col(order)).join(existing.select(key), key, "left_anti")


def placeholder_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, service_name_raw, verification_note): one for each readable document (doc_id, file_name, parse_status) without items."""
    none = documents.where("parse_status <> 'error'").join(items.select("doc_id"), "doc_id", "left_anti")
    return none.select("doc_id", stem(F.col("file_name")).alias("service_name_raw"), F.lit("needs manual review").alias("verification_note"))


def load_catalogue(sheet: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (row_no, service_name, category, icd_code, synonyms) of a sheet (row_no, name, category, and code where there is one) whose names existing (service_name) lacks.

    Rows without a name are left out, the first of equal names counts, and the category is the only synonym.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in sheet.columns else F.lit(None).cast("string")
    rows = sheet.select("row_no", text("name").alias("service_name"), text("category").alias("category"), text("code").alias("icd_code")).where("service_name is not null")
    return insert_if_absent(rows, existing, "service_name", "row_no").withColumn("synonyms", F.array_compact(F.array("category")))


#: How the columns of a catalogue's sheet are called.
CATALOGUE = {"name": ("Name_ru",), "category": ("Специальность", "Specialty", "specialty"), "code": ("TarificatrCode", "TariffCode", "tariff_code")}


def catalogue_sheet(grid: DataFrame) -> DataFrame:
    """Rows (row_no, name, category, code) of a sheet's rows (row_idx, cells), the first of which has the headings; fails without them."""
    head = grid.groupBy().agg(F.min_by("cells", "row_idx").alias("head"), F.min("row_idx").alias("first"))
    spelt = F.transform("head", lambda h: F.trim(h))

    def at(names: tuple[str, ...]):
        return F.coalesce(*(F.nullif(F.array_position(spelt, n), F.lit(0)) for n in names), F.raise_error(F.concat(F.lit("missing heading, one of "), F.lit(", ".join(names)))).cast("bigint"))

    placed = head.select("first", *(at(names).cast("int").alias(c) for c, names in CATALOGUE.items()))
    cell = lambda c: F.nullif(F.trim(F.get("cells", F.col(c) - 1)), F.lit(""))
    return grid.join(F.broadcast(placed)).where("row_idx > first").select(F.col("row_idx").alias("row_no"), *(cell(c).alias(c) for c in CATALOGUE))


def drafts_with_items(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """Drafts of a review with the items that they are about; drafts about none are left out."""
    return drafts.join(items, "item_id")


def nested_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents (doc_id, name, ...), name being the partner's, with items: an array of structs (item_id, name), by name; empty where there are none."""
    item = F.struct("name", "item_id")
    nested = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.expr("cast(array() as array<struct<item_id: bigint, name: string>>)")
    as_item = F.transform("items", lambda i: F.struct(i["item_id"].cast("bigint").alias("item_id"), i["name"].alias("name")))
    return documents.withColumnRenamed("name", "partner_name").join(nested, "doc_id", "left").withColumn("items", F.coalesce(as_item, none))
