"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, lexical_search, license_scan, line_dedup, minhash_dedup, mixing, packing, pseudonyms, quality, simhash_dedup, token_prefixes, vector_codes
from .common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edits(table(spark, sf_dir, "documents"))
    prints = (fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"))
    more = (fingerprints.shingle_count(F.col("sketch")).alias("n_shingles_est"), fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"))
    return found.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next", *more)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least=1).select("doc_id", "text", "n_lines", "n_dropped")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), pseudonyms.SAMPLE_KEY).select("doc_id", "text", "n_found", "n_changed")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefixes.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two thirds of the ids, by a hash, count as seen before; the rest, and rows without an id, arrive.
    docs = table(spark, sf_dir, "documents")
    old = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0, F.lit(False))
    found = exact_dedup.with_arrivals(docs.where(old & F.col("doc_id").isNotNull()), docs.where(~old | F.col("doc_id").isNull()))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ALL = (
    *(op1_fingerprints, op2_quality, op3_license_scan, op4_mixing, op5_line_dedup, op6_pii_pseudonyms, op7_simhash_dedup),
    *(op8_token_counts, op9_packing, op10_exact_dedup, op11_minhash_dedup, op12_vector_codes, op13_lexical_search),
)
QUERIES = {f.__name__: f for f in ALL}

ORACLES = {
    "op3_license_scan": license_scan.SCAN_SQL,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))""",
    "op12_vector_codes": vector_codes.COMPRESS_SQL,
    "op13_lexical_search": lexical_search.SEARCH_SQL,
}
